"""Scans, cell-table operators and sinks."""
