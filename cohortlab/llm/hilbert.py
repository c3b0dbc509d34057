"""Hilbert-curve ordering of documents by several metadata columns, cut into runs of equal length.

Each dimension is quantised at its own approximate quantiles into 2^bits cells; text dimensions by their first bytes, which
keeps their order. The cells of a row give its index on the Hilbert curve, so a run of the order is compact in every
dimension and files can be pruned by any of them. Exact ranks come in two levels: ranges of the order are cut at quantiles,
numbered inside, and offset by the counts of the ranges before. The order goes on by bits of the text's and the id's
hash, so rows of one cell, or copies of one text, never need to share a range.

Law: ``rows``. Rank r of N goes to shard floor(r * shards / N): counts are at most one apart.

Cases: a null text has size 1 and the checksum of an empty one; a null dimension takes the first cell; equal rows are
ordered at will; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.session import bucket_count, durable

BITS = 6
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of rows of ``cells`` (rows x dimensions, each below 2^bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ordered_number(df: DataFrame, name: str) -> Column:
    """The column as a double that keeps its order: texts by their first six bytes."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return column.cast("timestamp").cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.encode(column.cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def curve_column(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> Column:
    """Curve index of each row of ``df``; the cuts of each dimension are 2^bits - 1 quantiles."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [ordered_number(df, d) for d in dimensions]
    row = df.agg(*[F.percentile_approx(n, shares, 10_000).alias(f"c{i}") for i, n in enumerate(numbers)]).first()
    cuts = [np.unique(np.array(row[i] or [], dtype=float)) for i in range(len(dimensions))]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        cells = []
        for c, s in zip(cuts, columns, strict=True):
            values = np.nan_to_num(s.to_numpy(dtype=float, na_value=np.nan), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            cells.append((np.searchsorted(c, values, "left") << bits) // (len(c) + 1))  # few values are spread over the whole side
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return index(*numbers)


def global_rank(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Add ``rank``, the exact place of each row in the order of the long ``key`` and ``ties``."""
    n = bucket_count(df.sparkSession)
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), "left").astype(np.int32))

    ranged = df.withColumn("range", range_of(key))
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = durable(counts.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key, *ties)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(base), "range").withColumn("rank", F.col("base") + F.col("inside")).drop("range", "base", "inside")


def hilbert_shards(docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        curve_column(docs, dimensions, bits).alias("curve"))
    salt = F.shiftleft(F.pmod("text_crc32", F.lit(256)), 8) + F.pmod(F.xxhash64("doc_id"), F.lit(256))
    stored = durable(rows.withColumn("place", F.shiftleft("curve", 16) + salt))
    n = stored.count()
    ranked = global_rank(stored, "place", ["text_crc32", "doc_id"])
    whole = F.expr(f"(rank * {shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", whole).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_ranges(placed: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Least and greatest value of each dimension in each shard, to prune shards by."""
    least = [f(f"`{d}`").alias(f"{name}_{d}") for d in dimensions for name, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *least)
