"""Repeated lines removed across documents, answered as compressed keep bitmaps. DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys are compared by 128 bits of
hash. Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold are common: all their lines go,
except those in the document with the greatest id. Only hashes, ids and positions are shuffled, never lines.

The hashes are range-partitioned and each range is sorted by hash, then document in descending order, then position, so
a stream over a range meets the document that keeps a key first and every later one after it. A key with more than a
quarter of a range's fair share of lines is hot. There are at most four hot keys a range, whatever the data: they are
found through counts of hash cells, counted per document with map-side partial aggregates, and their few totals
are broadcast to the lines instead of moving the lines to one task.

The bitmap of a document is run-length encoded: lengths of alternating runs of kept and dropped lines, kept first;
lines after the last run are kept. Only documents that lose a line have one.

Cases: a null or empty text is one empty line, which is never common; rows that agree in id and text are one document and get
the same answer; rows that share an id but not the text are two documents, and both keep their lines if their id is the
greatest; a null id is less than every other; a very long text is split in its own task, and its lines are spread over
the ranges like any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import bucket_count, durable

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
HOT_SHARE = 4
CELLS_PER_RANGE = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_key, pos, h1, h2`` of every line whose key is long enough."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(lines: DataFrame, ranges: int, total: int) -> DataFrame:
    """``h1, h2`` of the keys with more than ``total / (4 * ranges)`` lines: fewer than ``4 * ranges`` rows."""
    limit = max(1, total // (HOT_SHARE * ranges))
    cell = F.pmod("h1", F.lit(CELLS_PER_RANGE * ranges))
    cells = lines.groupBy(cell.alias("cell")).count().where(F.col("count") > limit).select("cell")
    inside = lines.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi")
    return inside.groupBy("h1", "h2").count().where(F.col("count") > limit).select("h1", "h2")


def _hot_drops(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    held = lines.join(F.broadcast(hot), ["h1", "h2"])
    totals = held.select("h1", "h2", "doc_id", "text_key").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))
    common = totals.where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_id")
    return held.join(F.broadcast(common), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_id"))).select("doc_id", "text_key", "pos")


def _swept_drops(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    rest = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    of_key = Window.partitionBy("h1", "h2")
    stream = of_key.orderBy(F.col("doc_id").desc_nulls_last(), "text_key", "pos")
    by_doc = of_key.orderBy(F.col("doc_id").desc_nulls_last(), "text_key")
    seen = rest.withColumn("first_id", F.first("doc_id").over(stream)).withColumn("place", F.dense_rank().over(by_doc))
    return seen.withColumn("n_docs", F.max("place").over(of_key)).where(
        (F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text_key", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text_key, n_dropped, keep_runs`` of each distinct document that loses a line."""
    lines = durable(hashed_lines(docs, min_chars))
    ranges = bucket_count(docs.sparkSession)
    hot = durable(hot_keys(lines, ranges, lines.count()))
    drops = _swept_drops(lines, hot, min_docs).unionByName(_hot_drops(lines, hot, min_docs))
    of_doc = Window.partitionBy("doc_id", "text_key")
    runs = drops.distinct().withColumn("run", F.col("pos") - F.row_number().over(of_doc.orderBy("pos")))
    runs = runs.groupBy("doc_id", "text_key", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("gone"))
    before = F.coalesce(F.lag(F.col("start") + F.col("gone")).over(of_doc.orderBy("start")), F.lit(0))
    runs = runs.withColumn("kept", F.col("start") - before)
    ordered = F.array_sort(F.collect_list(F.struct("start", "kept", "gone")))
    return runs.groupBy("doc_id", "text_key").agg(F.sum("gone").alias("n_dropped"), ordered.alias("runs")).select(
        "doc_id", "text_key", "n_dropped", F.flatten(F.transform("runs", lambda r: F.array(r["kept"], r["gone"]))).alias("keep_runs"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row, ``kept`` being the array of lines left."""
    flags = F.flatten(F.transform("keep_runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marks = bitmaps.select(F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_key"), F.col("n_dropped").alias("gone"), flags.alias("flags"))
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("text_key") == F.col("mark_key")), "left")
    kept = F.filter(_lines(F.col("text")), lambda _, i: F.coalesce(F.get("flags", i), F.lit(True)))
    return joined.select(
        "doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, without its repeated lines."""
    kept = kept_lines(docs, keep_bitmaps(docs, min_chars, min_docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.array_join("kept", "\n").alias("text"))
