"""Column names: normalisation, lookup by fragment, artefact removal."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def statistics_name(name: str) -> str:
    return name.strip().replace(" ", "_").lower().strip('"')


def welfare_name(name: str) -> str:
    return name.strip().replace(" ", "_").lower().replace("-", "_")


def workbook_name(name: str) -> str:
    return name.strip().lower()


def rename_all(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def find_column(columns: Iterable[str], fragments: Iterable[str], max_length: int | None = None) -> str | None:
    """First column whose name holds any fragment (and is shorter than ``max_length``)."""
    wanted = tuple(fragments)
    for name in columns:
        if any(f in name for f in wanted) and (max_length is None or len(name) < max_length):
            return name
    return None


def find_count_column(columns: Iterable[str], fragments: Iterable[str]) -> str:
    """As :func:`find_column`, with the last column as the fallback."""
    names = list(columns)
    return find_column(names, fragments) or names[-1]


def rename_last(df: DataFrame, name: str) -> DataFrame:
    """The value is the last column by position; give it ``name``."""
    return df.withColumnRenamed(df.columns[-1], name)


def digit_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c.isdigit()]


def drop_artefacts(df: DataFrame, key: str = "birth_region_standardized") -> DataFrame:
    """Drop unnamed columns and every region-like column except the key."""
    extra = [c for c in df.columns if "unnamed" in c.lower() or ("region" in c.lower() and c != key)]
    return df.drop(*extra)
