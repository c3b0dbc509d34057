"""Exact histogram of encoded lengths, and what its suffix sums answer for any context limit.

Documents are counted by length, so a hot length is one row after the partial counts. Sums over the distinct lengths
have two levels, inside ranges of lengths and over one row per range; no task holds all lengths.

Cases: a null or empty text has length 0; repeated rows count each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm import tokens
from cohortlab.llm.frames import map_rows
from cohortlab.session import durable

RANGE = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text."""
    path = path or tokens.default_path()

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "n_tokens": tokens.encoder(path).lengths(batch.column("text"))}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), count, "doc_id long, n_tokens long")


def length_table(lengths: DataFrame, width: int = RANGE) -> DataFrame:
    """One row per distinct length, with prefix and suffix sums.

    ``length, n_docs, docs_longer, tokens_up_to, truncated_total, share_up_to, next_length``. A limit L from ``length``
    to the next length keeps ``tokens_up_to + L * docs_longer`` tokens; see :func:`limit_totals`.
    """
    counts = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    counts = durable(counts.withColumn("range", F.floor(F.col("length") / width)).withColumn("n_tokens", F.col("length") * F.col("n_docs")))
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("length").alias("low"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    ranges = ranges.select(
        "range", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"), F.lead("low").over(Window.orderBy("range")).alias("next_low"))
    inside = Window.partitionBy("range").orderBy("length")
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    rows = counts.join(ranges, "range")
    longer = F.coalesce(F.sum("n_docs").over(down), F.lit(0)) + F.col("docs_after")
    upto = F.sum("n_docs").over(up) + F.col("docs_before")
    tokens_up = F.sum("n_tokens").over(up) + F.col("tokens_before")
    rows = rows.select(
        "length", "n_docs", longer.alias("docs_longer"), tokens_up.alias("tokens_up_to"), upto.alias("docs_up_to"),
        F.coalesce(F.lead("length").over(inside), F.col("next_low")).alias("next_length"))
    return rows.select(
        "length", "n_docs", "docs_longer", "tokens_up_to", (F.col("tokens_up_to") + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
        (F.col("docs_up_to") / (F.col("docs_up_to") + F.col("docs_longer"))).alias("share_up_to"), "next_length")


def limit_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, truncated_total, docs_longer, tokens_up_to`` for each context limit."""
    asked = table.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    covers = (F.col("limit") >= F.col("length")) & ((F.col("limit") < F.col("next_length")) | F.col("next_length").isNull())
    whole = table.agg(F.min("length").alias("low"), F.max(F.struct("length", (F.col("docs_longer") + F.col("n_docs")).alias("x"))).alias("top"),
                      F.sum("n_docs").alias("all"))
    found = asked.join(table, covers, "left").join(whole)
    longer = F.coalesce(F.col("docs_longer"), F.when(F.col("low").isNotNull(), F.col("all")), F.lit(0))
    kept = F.coalesce(F.col("tokens_up_to"), F.lit(0))
    return found.select("limit", (kept + F.col("limit") * longer).alias("truncated_total"), longer.alias("docs_longer"), kept.alias("tokens_up_to"))


def quantile_length(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of all documents don't exceed."""
    return table.where(F.col("share_up_to") >= share).agg(F.min("length").alias("length"))
