"""Wide-by-year welfare CSV with an optional title line and a footer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.labels import map_rules
from cohortlab.functions.names import digit_columns, find_column, rename_all, welfare_name
from cohortlab.functions.parsing import clean_missing, tolerant_number, tolerant_year
from cohortlab.operators.aggregate import group_mean
from cohortlab.operators.merge import TOTAL_COHORT
from cohortlab.operators.reshape import melt_years
from cohortlab.sources.settings import REGION, WELFARE_REGION_FRAGMENTS, WELFARE_RULES
from cohortlab.sources.titled import scan_by_name


def scan_titled(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Rows of every file at ``path`` by column name; each file may have a title line, a footer and years of its own."""
    return scan_by_name(spark, path, sep, encoding, header="year")


def harmonise_welfare(raw: DataFrame) -> DataFrame:
    """(year, region, welfare_amount_avg): melt the years, map the region, average everything."""
    rows = rename_all(clean_missing(raw), welfare_name)
    if digit_columns(rows.columns):
        rows = melt_years(rows, "welfare_amount_total")
    elif "year" in rows.columns:
        rows = rows.withColumn("year", tolerant_year(F.col("year")))
    else:
        raise ValueError("neither a year column nor a column per year")
    source = find_column(rows.columns, WELFARE_REGION_FRAGMENTS)
    region = map_rules(F.col(source), WELFARE_RULES, "Other") if source else F.lit(TOTAL_COHORT)
    rows = rows.withColumn(REGION, region)
    rows = rows.withColumn("welfare_amount_avg", tolerant_number(F.col("welfare_amount_total")))
    return group_mean(rows, ["year", REGION], ["welfare_amount_avg"])


def load_welfare(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    return harmonise_welfare(scan_titled(spark, path, sep, encoding))
