"""Connected components of a link table, and a bounded filter for ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import collect_garbage, durable, release

FILTER_BITS = 24
_BITMAP_BITS = 32_768  # of what bitmap_construct_agg returns


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``a, b`` links; ``comp`` is the smallest node of its component.

    Each round takes the least label among a node and its neighbours, then the label's own label; stars end in two rounds,
    chains in a number that grows as the logarithm of their length.
    """
    edges = durable(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    while True:
        labels = last.select("node", "comp")
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), F.lit(None).cast("long").alias("was"), "comp")
        own = labels.select("node", F.col("comp").alias("was"), "comp")
        step = near.unionByName(own).groupBy("node").agg(F.max("was").alias("was"), F.min("comp").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = durable(step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("comp")))
        release(last)
        collect_garbage(links.sparkSession)
        last = step
        if step.where(F.col("was") != F.col("comp")).isEmpty():
            release(edges)
            return step.select("node", "comp")


def filter_bits(values: int, each: int, least: int, most: int) -> int:
    """Logarithm of the size of a filter with about ``each`` bits for each of ``values``, within bounds."""
    return max(least, min(most, (each * max(values, 1) - 1).bit_length()))


def id_filter(ids: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """One bit per value of ``id mod 2^bits`` that occurs: a filter of at most 2 MB, sized by the ids. An exact join must follow it."""
    bits = filter_bits(ids.count(), 16, 12, FILTER_BITS) if bits is None else bits
    cells = ids.select(F.pmod(F.col(column), F.lit(1 << bits)).cast("long").alias("cell")).where("cell is not null")
    packed = cells.groupBy(F.floor(F.col("cell") / _BITMAP_BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % _BITMAP_BITS).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in packed.collect():
        at = row["part"] * _BITMAP_BITS // 8
        held = np.packbits(np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little"))
        out[at : at + len(held)] = held[: len(out) - at]
    return out


def may_hold(filter_bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id can be among those of the filter."""
    cell = ids & (len(filter_bits) * 8 - 1)
    return (filter_bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
