"""Group aggregates and the composite score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.parsing import nan_to_null
from cohortlab.functions.scalars import weighted_sum
from cohortlab.operators.quantiles import exact_quantiles

REGION = "birth_region_standardized"


def _value(name: str) -> Column:
    return nan_to_null(F.col(name).cast("double"))


def _complete_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=keys)


def group_mean(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean per group; missing values are skipped and rows with a missing key are left out."""
    return _complete_keys(df, keys).groupBy(*keys).agg(*[F.avg(_value(c)).alias(c) for c in columns])


def group_sum(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sum per group; a group without a value sums to 0."""
    total = F.coalesce(F.sum(_value(column)), F.lit(0.0))
    return _complete_keys(df, keys).groupBy(*keys).agg(total.alias(column))


def _ordered(pick: Callable[[Column, Column], Column]) -> Callable[[str, str], Column]:
    def build(column: str, order: str) -> Column:
        return pick(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))

    return build


PLAIN: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(_value(c)),
    "sum": lambda c: F.coalesce(F.sum(_value(c)), F.lit(0.0)),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "std": lambda c: F.stddev_samp(_value(c)),
    "var": lambda c: F.var_samp(_value(c)),
    "count": lambda c: F.count(c),
    "nunique": lambda c: F.count_distinct(F.col(c)),
}
ORDERED = {"first": _ordered(F.min_by), "last": _ordered(F.max_by)}


def aggregate_by_region(
    df: DataFrame,
    columns: list[str],
    functions: dict[str, str] | None = None,
    region: str = REGION,
    order: str | None = None,
) -> DataFrame:
    """One row per region; mean by default, or a named function per column.

    ``first`` and ``last`` need ``order``, the column that says which row comes first.
    """
    functions = functions or dict.fromkeys(columns, "mean")
    rows = _complete_keys(df, [region])
    medians = [c for c, f in functions.items() if f == "median"]
    parts = []
    for column, name in functions.items():
        if name in PLAIN:
            parts.append(PLAIN[name](column).alias(column))
        elif name in ORDERED:
            if order is None:
                raise ValueError(f"{name} needs an order column")
            parts.append(ORDERED[name](column, order).alias(column))
        elif name != "median":
            raise ValueError(f"unknown aggregate {name}")
    result = rows.groupBy(region).agg(*parts) if parts else rows.select(region).distinct()
    if medians:
        tall = exact_quantiles(rows, medians, [0.5], [region])
        wide = tall.groupBy(region).agg(
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in medians]
        )
        result = result.join(wide, region, "left")
    return result.select(region, *functions)


def aggregate_by_region_and_year(
    df: DataFrame, columns: list[str], region: str = REGION, year: str = "year"
) -> DataFrame:
    return group_mean(df, [region, year], columns)


def composite_score(
    df: DataFrame, columns: list[str], weights: dict[str, float] | None = None, region: str = REGION
) -> DataFrame:
    """Region means, min-max scaled over the regions (0 for a constant column) and summed by weight."""
    weights = weights or dict.fromkeys(columns, 1.0 / len(columns))
    means = aggregate_by_region(df, columns, region=region)
    edges = means.agg(
        F.struct(
            *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]
        ).alias("edges")
    ).scalar()
    normed = {}
    for c in columns:
        low, high = edges.getField(f"min_{c}"), edges.getField(f"max_{c}")
        normed[f"{c}_norm"] = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))
    scored = means.withColumns(normed)
    total = weighted_sum([F.col(f"{c}_norm") for c in columns], [weights[c] for c in columns])
    return scored.withColumn("integration_score", total)


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, exact median, sample deviation, minimum and maximum of each column, one row per column."""
    made = [
        F.struct(
            F.lit(c).alias("column"), F.avg(_value(c)).alias("mean"), F.stddev_samp(_value(c)).alias("std"),
            F.min(_value(c)).alias("min"), F.max(_value(c)).alias("max"),
        )
        for c in columns
    ]
    base = df.agg(F.array(*made).alias("rows")).select(F.inline("rows"))
    middle = exact_quantiles(df, columns, [0.5]).select("column", F.col("value").alias("median"))
    return base.join(middle, "column", "left").select("column", "mean", "median", "std", "min", "max")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class."""
    counts = _complete_keys(df, [label]).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("rate", F.col("n") / total)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct values per column (NULL not counted) and whether there is more than one.

    Each column is de-duplicated on its own (value, column) key before counting.
    """
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    found = cells.groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))
    return found.withColumn("varies", F.col("n_distinct") > 1)
