"""Models as DataFrame jobs: fit on a table, add score columns to a table."""
