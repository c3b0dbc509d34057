"""Query registry and small helpers shared by the query modules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder that nothing uses yet."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def order_year() -> Column:
    return F.year("o_orderdate")


def order_years(orders: DataFrame) -> list[int]:
    """All years found in the column ``year``: a handful."""
    return sorted(r[0] for r in orders.select("year").where("year is not null").distinct().collect())
