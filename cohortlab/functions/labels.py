"""Label harmonisation: dictionary joins and ordered rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import BROADCAST_MAX_ROWS


def label_map(spark, mapping: Mapping[str, str]) -> DataFrame:
    """Lookup table with lower-cased keys; its size is known, so the hint is checked here."""
    rows = list({k.lower(): v for k, v in mapping.items()}.items())
    table = spark.createDataFrame(rows, "map_key string, map_value string")
    return F.broadcast(table) if len(rows) <= BROADCAST_MAX_ROWS else table


def map_keep(df: DataFrame, label: str, lookup: DataFrame, out: str) -> DataFrame:
    """Look the lower-cased label up; an unmapped label passes through with its case."""
    joined = df.join(lookup, F.lower(F.col(label)) == F.col("map_key"), "left")
    return joined.withColumn(out, F.coalesce("map_value", label)).drop("map_key", "map_value")


def map_default(df: DataFrame, label: str, lookup: DataFrame, out: str, default: str = "Other") -> DataFrame:
    """Look the trimmed, lower-cased label up; an unmapped label becomes ``default``."""
    joined = df.join(lookup, F.lower(F.trim(F.col(label))) == F.col("map_key"), "left")
    return joined.withColumn(out, F.coalesce("map_value", F.lit(default))).drop("map_key", "map_value")


def map_rules(col: Column, rules: Sequence[tuple[Iterable[str], str]], default: str) -> Column:
    """Ordered rules: the first one with a fragment inside the lower-cased text wins."""
    text = F.lower(F.coalesce(col, F.lit("")))
    case = None
    for fragments, value in rules:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | text.contains(fragment)
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return F.lit(default) if case is None else case.otherwise(default)
