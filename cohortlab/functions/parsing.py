"""Tolerant text-to-number parsing. Bad text becomes NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

# Whole-cell markers that mean "missing".
MISSING_MARKERS = ("..", "-", "N/A", "")


def missing_to_null(col: Column) -> Column:
    return F.when(~col.isin(*MISSING_MARKERS), col)


def clean_missing(df: DataFrame) -> DataFrame:
    """Missing markers to NULL on every text column and NaN to NULL on every floating one."""
    fixed = {}
    for field in df.schema:
        if isinstance(field.dataType, StringType):
            fixed[field.name] = missing_to_null(F.col(f"`{field.name}`"))
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            fixed[field.name] = nan_to_null(F.col(f"`{field.name}`"))
    return df.withColumns(fixed) if fixed else df


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def tolerant_number(col: Column, drop: str | None = " ") -> Column:
    """Remove ``drop`` (a regular expression) and parse; anything else is NULL."""
    text = col.cast("string")
    if drop:
        text = F.regexp_replace(text, drop, "")
    # A Java type suffix ("12d") is not a number here.
    return nan_to_null(F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double")))


def count_or_zero(col: Column) -> Column:
    """Counts: any run of white space is a thousands separator; unreadable cells count as 0."""
    return F.coalesce(tolerant_number(col, r"[\s ]+"), F.lit(0.0))


def tolerant_year(col: Column) -> Column:
    return tolerant_number(col, None).try_cast("int")
