"""Preferred-measure selection: keep the preferred rows, or the fallback rows if none are preferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.predicates import matches


def prefer_measure(df: DataFrame, column: str, preferred: str, fallback: str | None = None) -> DataFrame:
    """Row form. The choice is made once for the whole table, by a scalar subquery."""
    wanted = matches(F.col(column), preferred)
    if fallback is None:
        return df.filter(wanted)
    any_wanted = df.agg(F.coalesce(F.bool_or(wanted), F.lit(False))).scalar()
    return df.filter(F.when(any_wanted, wanted).otherwise(matches(F.col(column), fallback)))


def candidate_means(
    df: DataFrame, keys: list[str], value: str, column: str, preferred: str, fallback: str | None = None, keep: Column | None = None
) -> DataFrame:
    """Per group the mean over the preferred rows and over the fallback rows, side by side.

    ``keep`` marks the rows that enter a mean; ``_seen`` (a preferred row exists) looks at every row.
    The aggregate is plain, so it also runs on a stream.
    """
    used = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    is_preferred = matches(F.col(column), preferred)
    is_fallback = matches(F.col(column), fallback) if fallback else F.lit(False)
    return df.groupBy(*keys).agg(
        F.bool_or(is_preferred).alias("_seen"),
        F.avg(F.when(is_preferred & used, F.col(value))).alias("_preferred"),
        F.avg(F.when(is_fallback & used, F.col(value))).alias("_fallback"),
    )


def choose_measure(groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The preferred means if any group saw a preferred row, else the fallback means."""
    any_seen = groups.agg(F.coalesce(F.bool_or("_seen"), F.lit(False))).scalar()
    chosen = F.when(any_seen, F.col("_preferred")).otherwise(F.col("_fallback"))
    complete = groups.na.drop(how="any", subset=keys)
    return complete.select(*keys, chosen.alias(value)).filter(F.col(value).isNotNull())


def preferred_group_mean(
    df: DataFrame, keys: list[str], value: str, column: str, preferred: str, fallback: str | None = None, keep: Column | None = None
) -> DataFrame:
    """Group mean over the selected measure: the source is scanned once, only the group table is read again."""
    return choose_measure(candidate_means(df, keys, value, column, preferred, fallback, keep), keys, value)
