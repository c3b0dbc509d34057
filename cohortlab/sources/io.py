"""Optional sources and sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def optional_source(spark: SparkSession, path: str, load: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> DataFrame | None:
    """The loaded source, or None if its path does not exist. Any other failure is raised."""
    try:
        return load(spark, path, *args, **kwargs)
    except FileNotFoundError:
        return None
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise


def scan_transactions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled transactions with an explicit schema: CSV with a header line, or Parquet."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.csv(path, schema=schema, header=True)


def save_table(df: DataFrame | None, path: str, kind: str = "csv") -> str:
    """Write a table (overwriting an older one) without an index column."""
    if df is None:
        raise ValueError("nothing to save")
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown kind {kind}")
    return path


def save_bucketed(df: DataFrame, name: str, keys: list[str], path: str, buckets: int = 64) -> str:
    """Write a table, bucketed and sorted by ``keys``; a null key stops the job.

    Each bucket is one file: the rows are first dealt to tasks by the same hash that names buckets.
    """
    known = [F.when(F.col(f"`{k}`").isNotNull(), F.col(f"`{k}`")).otherwise(F.raise_error(F.lit(f"a null in key {k}"))) for k in keys]
    rows = df.withColumns(dict(zip(keys, known, strict=True))).repartition(buckets, *keys)
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name


def save_for_merge(sources: dict[str, DataFrame], keys: list[str], name: str, folder: str, buckets: int = 64) -> list[str]:
    """Write sources as bucketed tables ``name_source``, and ``name_keys`` with every key of any of them.

    :func:`cohortlab.operators.merge.merge_stored` merges them, as often as wanted, without a shuffle. Returns the sources' tables.
    """
    tables = [save_bucketed(df, f"{name}_{part}", keys, f"{folder}/{part}", buckets) for part, df in sources.items()]
    spark = next(iter(sources.values())).sparkSession
    # Read as plain files: a union of bucketed scans may be taken for one that is dealt by the keys already.
    held = reduce(DataFrame.unionAll, [spark.read.parquet(f"{folder}/{part}").select(*keys) for part in sources]).distinct()
    save_bucketed(held, f"{name}_keys", keys, f"{folder}/keys", buckets)
    return tables
