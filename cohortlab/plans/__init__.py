"""Whole jobs and the tables behind each figure."""
