"""Registered queries over the given tables, with the SQL each one must equal."""

from cohortlab.queries import cohorts, labels, models, ranking, sheets, sources, statistics  # noqa: F401
from cohortlab.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
