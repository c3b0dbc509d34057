"""Statistical CSV: one lazy scan with early filters, harmonised and averaged per (year, region)."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.labels import label_map, map_keep
from cohortlab.functions.names import rename_all, rename_last, statistics_name
from cohortlab.functions.parsing import tolerant_number, tolerant_year
from cohortlab.functions.predicates import is_total, keep_matching
from cohortlab.operators.aggregate import group_mean
from cohortlab.operators.measure import preferred_group_mean
from cohortlab.sources.settings import BIRTH_REGIONS, INDICATORS, REGION, STATISTICS_FILTERS, STATISTICS_TOTALS
from cohortlab.sources.titled import scan_by_name

KEYS = ["year", REGION]


def scan_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text, a header line per file; every column is read as text, by its name in its own file.

    In a store that only Spark's readers open, all files must have the same header, or the scan fails.
    """
    try:
        return scan_by_name(spark, path, sep, encoding)
    except pa.ArrowInvalid:
        return spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, enforceSchema=False)


def harmonised_rows(raw: DataFrame, indicator: str, mapping: Mapping[str, str] = BIRTH_REGIONS) -> tuple[DataFrame, str, Column]:
    """(rows with typed year and value and the mapped region, value name, which rows enter the mean)."""
    name = INDICATORS.get(indicator, ("value", None, None))[0]
    rows = rename_last(keep_matching(rename_all(raw, statistics_name), STATISTICS_FILTERS), name)
    rows = rows.withColumns({name: tolerant_number(F.col(name)), "year": tolerant_year(F.col("year"))})
    rows = map_keep(rows, "region_of_birth", label_map(raw.sparkSession, mapping), REGION)
    return rows, name, ~is_total(F.col("region_of_birth"), STATISTICS_TOTALS)


def harmonise_statistics(raw: DataFrame, indicator: str, mapping: Mapping[str, str] = BIRTH_REGIONS) -> DataFrame:
    """(year, region, value): filters, measure choice, label mapping, mean per group.

    The measure fallback is decided once for the whole source.
    """
    rows, name, ordinary = harmonised_rows(raw, indicator, mapping)
    _, preferred, fallback = INDICATORS.get(indicator, ("value", None, None))
    if preferred and "observations" in rows.columns:
        return preferred_group_mean(rows, KEYS, name, "observations", preferred, fallback, ordinary)
    return group_mean(rows.filter(ordinary & F.col(name).isNotNull()), KEYS, [name])


def load_statistics(
    spark: SparkSession, path: str, indicator: str, mapping: Mapping[str, str] = BIRTH_REGIONS, sep: str = ",",
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """Scan and harmonise; an empty result is an error."""
    table = harmonise_statistics(scan_delimited(spark, path, sep, encoding), indicator, mapping)
    if table.isEmpty():
        raise ValueError(f"no usable row in {path}")
    return table
