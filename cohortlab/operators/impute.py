"""Imputation, scaling and outlier clipping.

Statistics come from one aggregate over all columns and enter the projection as a one-row scalar
subquery, so each operator is a statistics scan and a map-only pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortlab.functions.parsing import nan_to_null
from cohortlab.operators.quantiles import medians
from cohortlab.session import broadcast_if_small


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    skip = set(exclude or [])
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def _number(name: str) -> Column:
    return nan_to_null(F.col(name).cast("double"))


def _one_row(df: DataFrame, columns: list[str], **stats: Callable[[Column], Column]) -> Column:
    """Struct column holding ``<stat>_<column>`` for every column, from one aggregate."""
    made = [fn(_number(c)).alias(f"{stat}_{c}") for c in columns for stat, fn in stats.items()]
    return df.agg(F.struct(*made).alias("stats")).scalar()


def fill_missing(df: DataFrame, strategy: str = "mean", exclude: list[str] | None = None) -> DataFrame:
    """Fill numeric columns with their mean, exact median, or (any other strategy) 0.

    The filled columns are doubles.
    """
    columns = numeric_columns(df, exclude)
    if not columns:
        return df
    if strategy == "mean":
        stats = _one_row(df, columns, mean=F.avg)
        fill = {c: stats.getField(f"mean_{c}") for c in columns}
    elif strategy == "median":
        fill = {c: F.lit(v).cast("double") for c, v in medians(df, columns).items()}
    else:
        fill = {c: F.lit(0.0) for c in columns}
    return df.withColumns({c: F.coalesce(_number(c), fill[c]) for c in columns})


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column stays as it is, an unknown column is ignored."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    stats = _one_row(df, columns, min=F.min, max=F.max)
    scaled = {}
    for c in columns:
        low, high = stats.getField(f"min_{c}"), stats.getField(f"max_{c}")
        scaled[c] = F.when(high > low, (_number(c) - low) / (high - low)).otherwise(_number(c))
    return df.withColumns(scaled)


def clip_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Clip to mean ± threshold · sample deviation; NULL stays NULL, a constant column is left alone."""
    if column not in df.columns:
        return df
    stats = _one_row(df, [column], mean=F.avg, std=F.stddev_samp)
    mean, reach = stats.getField(f"mean_{column}"), threshold * stats.getField(f"std_{column}")
    value = _number(column)
    clipped = F.when(value.isNull(), value).otherwise(F.least(F.greatest(value, mean - reach), mean + reach))
    return df.withColumn(column, F.when(reach > 0, clipped).otherwise(value))


def fit_standard(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column of the training rows (a deviation of 0 becomes 1)."""
    row = train.agg(
        *[F.avg(_number(c)).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(_number(c)).alias(f"std_{c}") for c in columns],
    ).first()
    return {c: (row[f"mean_{c}"] or 0.0, row[f"std_{c}"] or 1.0) for c in columns}


def apply_standard(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (_number(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: n / (classes · class size)."""
    counts = class_counts(df, label)
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("weight", totals.getField("rows") / (totals.getField("classes") * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(broadcast_if_small(weights), label)


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    if not row["pos"]:
        raise ValueError("no positive row")
    return row["neg"] / row["pos"]
