"""Reshape, distinct and union operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.names import digit_columns
from cohortlab.operators import repeats


def melt_years(df: DataFrame, value: str, year: str = "year") -> DataFrame:
    """One row per digit-named column; the other columns identify the row."""
    years = digit_columns(df.columns)
    ids = [c for c in df.columns if c not in years]
    return df.unpivot(ids, years, year, value).withColumn(year, F.col(year).cast("int"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keep one row of each group of equal rows.

    Rows of a few numbers and short texts collapse before the shuffle as they are. Wider ones are told apart by digests first, and only those whose
    digest may have come twice are shuffled whole: see :mod:`cohortlab.operators.repeats`.
    """
    if repeats.narrow(df):
        return df.dropDuplicates()
    once, maybe = repeats.split_by_digest(df)
    return once.unionAll(maybe.dropDuplicates())


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one. Rows whose digest came once aren't shuffled."""
    rows = df if repeats.narrow(df) else repeats.split_by_digest(df)[1]
    groups = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def stack_columns(base: DataFrame, others: list[DataFrame], key: str = "row_id") -> DataFrame:
    """Put the columns of several frames side by side, matched by an explicit row id."""
    return reduce(lambda a, b: a.join(b, key, "inner"), others, base)


def metrics_long(table: DataFrame, name: str = "model") -> DataFrame:
    """Wide metric table to (model, metric, value)."""
    metrics = [c for c in table.columns if c != name]
    return table.unpivot([name], metrics, "metric", "value")
