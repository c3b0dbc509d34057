"""Workbooks as one long cell table ``(path, sheet, sheet_pos, row_idx, col_idx, value)``.

Choosing files, sheets and header rows are group aggregates over the cells, so any number of
workbooks is handled by the same few shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.labels import label_map, map_default
from cohortlab.functions.parsing import count_or_zero, missing_to_null, tolerant_year
from cohortlab.functions.predicates import is_total
from cohortlab.operators.aggregate import group_sum
from cohortlab.session import broadcast_if_small
from cohortlab.sources.settings import (
    COUNT_FRAGMENTS, COUNT_TOTALS, FILE_EXCLUDED, FILE_FRAGMENTS, NATIONALITIES, NATIONALITY_FRAGMENTS,
    NATIONALITY_MAX_LENGTH, REGION, SHEET_FRAGMENTS, SHEET_PREFERRED, YEAR_FRAGMENTS,
)

CELL_SCHEMA = "path string, sheet string, sheet_pos int, row_idx int, col_idx int, value string"


def holds_any(text: Column, fragments: Iterable[str]) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | text.contains(fragment)
    return hit


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def select_files(cells: DataFrame, kind: str) -> DataFrame:
    """Rows of the files whose lower-cased name fits the kind of count."""
    name = F.lower(base_name(F.col("path")))
    return cells.filter(holds_any(name, FILE_FRAGMENTS[kind]) & ~holds_any(name, FILE_EXCLUDED[kind]))


def file_year(path: Column) -> Column:
    """First four-digit token of the path between white space, ``_``, ``.`` and ``-``."""
    tokens = F.filter(F.split(path, r"[\s_.\-]+"), lambda t: t.rlike("^[0-9]{4}$"))
    return F.get(tokens, F.lit(0)).cast("int")


def select_sheets(cells: DataFrame) -> DataFrame:
    """Keep one sheet per file: the first preferred match, else the last match, else the first sheet."""
    sheet = F.lower("sheet")
    match = holds_any(sheet, SHEET_FRAGMENTS)
    preferred = match & holds_any(sheet, SHEET_PREFERRED)
    rank = F.when(preferred, 0).when(match, 1).otherwise(2)
    order = F.when(match & ~preferred, -F.col("sheet_pos")).otherwise(F.col("sheet_pos"))
    best = cells.groupBy("path").agg(F.min(F.struct(rank.alias("r"), order.alias("o"), F.col("sheet").alias("s"))).alias("_best"))
    chosen = broadcast_if_small(best.select("path", F.col("_best.s").alias("sheet")))
    return cells.join(chosen, ["path", "sheet"], "left_semi")


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, header_idx): first row with a nationality cell among other cells, else row 0."""
    text = F.lower(F.trim("value"))
    rows = cells.filter(F.col("value").isNotNull()).groupBy("path", "sheet", "row_idx").agg(
        F.count("*").alias("_filled"), F.count_if(holds_any(text, NATIONALITY_FRAGMENTS)).alias("_hits")
    )
    is_header = (F.col("_filled") > 1) & (F.col("_hits") > 0) & (F.col("_hits") < F.col("_filled"))
    found = F.min(F.when(is_header, F.col("row_idx")))
    return rows.groupBy("path", "sheet").agg(F.coalesce(found, F.lit(0)).alias("header_idx"))


def named_cells(cells: DataFrame) -> DataFrame:
    """Cells below the header with their column's name: (path, row_idx, name, col_idx, value)."""
    headed = cells.join(broadcast_if_small(header_rows(cells)), ["path", "sheet"])
    names = headed.filter((F.col("row_idx") == F.col("header_idx")) & F.col("value").isNotNull())
    names = names.groupBy("path", F.lower(F.trim("value")).alias("name")).agg(F.min("col_idx").alias("col_idx"))
    body = headed.filter(F.col("row_idx") > F.col("header_idx"))
    return body.join(broadcast_if_small(names), ["path", "col_idx"]).select("path", "row_idx", "name", "col_idx", "value")


def column_roles(named: DataFrame) -> dict[str, str | None]:
    """Names of the nationality, count and year columns over all files, from one aggregate.

    The first fitting name in (path, column) order wins; the count falls back to the last name to
    appear.
    """
    names = named.groupBy("name").agg(F.min(F.struct("path", "col_idx")).alias("seen"))
    name = F.col("name")
    is_year = holds_any(name, YEAR_FRAGMENTS)
    is_nation = holds_any(name, NATIONALITY_FRAGMENTS) & (F.length(name) < NATIONALITY_MAX_LENGTH)
    row = names.agg(
        F.min_by(name, F.when(is_nation, F.col("seen"))).alias("nationality"),
        F.min_by(name, F.when(holds_any(name, COUNT_FRAGMENTS), F.col("seen"))).alias("count"),
        F.max_by(name, F.when(~is_year, F.col("seen"))).alias("last"),
        F.min_by(name, F.when(is_year, F.col("seen"))).alias("year"),
    ).first()
    return {"nationality": row["nationality"], "count": row["count"] or row["last"], "year": row["year"]}


def harmonise_counts(cells: DataFrame, kind: str, mapping: Mapping[str, str] = NATIONALITIES) -> DataFrame:
    """(year, region, count) of one kind of count from a cell table."""
    named = named_cells(select_sheets(select_files(cells, kind))).withColumn("value", missing_to_null(F.col("value")))
    roles = column_roles(named)
    if roles["nationality"] is None:
        raise ValueError("no nationality column")
    wide = named.groupBy("path", "row_idx").agg(
        *[F.max(F.when(F.col("name") == roles[r], F.col("value"))).alias(f"_{r}") for r in ("nationality", "count", "year")]
    )
    target = f"mv_{kind}_count"
    year = F.coalesce(tolerant_year(F.col("_year")), file_year(F.col("path")))
    rows = wide.withColumns({"year": year, target: count_or_zero(F.col("_count"))})
    rows = rows.filter((F.col("year") > 0) & F.col("_nationality").isNotNull())
    rows = rows.filter(~is_total(F.col("_nationality"), COUNT_TOTALS))
    rows = map_default(rows, "_nationality", label_map(cells.sparkSession, mapping), REGION)
    return group_sum(rows.filter(F.col(REGION) != "Other"), ["year", REGION], target)


def load_counts(spark: SparkSession, path: str, kind: str, mapping: Mapping[str, str] = NATIONALITIES) -> DataFrame:
    """Counts from an extracted cell table stored as Parquet."""
    return harmonise_counts(spark.read.schema(CELL_SCHEMA).parquet(path), kind, mapping)
