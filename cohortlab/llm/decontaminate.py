"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only.

A document holds an item when at least ``threshold`` of the item's distinct five-word shingles are among its own. Items
are partitioned by size, in powers of two; the size of a partition sets how many of its smallest shingle hashes an item's
MinHash sketch keeps. With s shingles and at most m = s - ceil(threshold * s) missing, a sketch of k > m hashes meets every
document that holds the item at least k - m times: no item is lost, and documents of any length meet it in the same
way. Documents that meet a sketch often enough are candidates; their shingles are then compared with the item's as text.

Words are runs without white space (0x20, 0x09-0x0D), with A-Z lower-cased. An item of fewer words is one shingle.

Cases: null and wordless texts and items match nothing; repeated rows of an id count as one document or item with the
shingles of all its rows in the search, each row compared by itself, and the best row counts; null ids are ids; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import durable

SIZE = 5
THRESHOLD = 0.8
_SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Lower-cased words; null and wordless texts have none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, r"[ \t-\r]+", -1), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, repeated ones included."""
    run = lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), run)).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, size: Column | int) -> Column:
    """Distinct runs of ``size`` words as text."""
    size = F.lit(size) if isinstance(size, int) else size
    run = lambda i: F.array_join(F.slice(words, i, size), " ")
    found = F.when((F.size(words) >= size) & (size > 0), F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), run))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``item_id, size, hash, least``: the sketch of every item, and how often a document must meet it."""
    each = items.select("item_id", "size", "shingles", F.size("shingles").alias("n"))
    missing = F.col("n") - F.ceil(F.col("n") * F.lit(threshold))
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    keep = F.least(F.col("n"), upper - F.ceil(upper * F.lit(threshold)) + 1)
    hashed = F.sort_array(F.array_distinct(F.transform("shingles", lambda s: s["hash"])))
    sketch = each.select("item_id", "size", "n", F.slice(hashed, F.lit(1), keep.cast("int")).alias("sketch"), missing.alias("missing"))
    return sketch.select("item_id", "size", F.explode("sketch").alias("hash"), (F.size("sketch") - F.col("missing")).alias("least"))


def find(docs: DataFrame, items: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` for every document that holds an item."""
    words = words_of(F.col("text"))
    item_words = items.select("item_id", words.alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.lit(size), F.size("w")))
    texts = item_words.select("item_id", "size", shingle_texts(F.col("w"), F.col("size")).alias("texts"))
    pieces = F.transform("texts", lambda t: F.struct(t.alias("text"), _text_hash(t, size).alias("hash")))
    shingled = durable(texts.select("item_id", "size", pieces.alias("shingles")))
    sizes = sorted(r[0] for r in shingled.select("size").distinct().collect())
    sketches = _sketches(shingled, threshold)
    rows = docs.select("doc_id", words.alias("w"))
    hashes = F.concat(*[shingle_hashes(F.col("w"), k) for k in sizes]) if sizes else F.array().cast("array<bigint>")
    met = rows.select("doc_id", F.explode(hashes).alias("hash")).join(sketches.select("hash", "item_id", "least"), "hash")
    met = met.groupBy("doc_id", "item_id", "least").agg(F.count_distinct("hash").alias("met")).where(F.col("met") >= F.col("least"))
    candidates = durable(met.select("doc_id", "item_id"))
    return _verify(docs, shingled, candidates, threshold)


def _text_hash(text: Column, size: int) -> Column:
    """The hash that :func:`shingle_hashes` gives the words of a shingle's text."""
    words = F.split(text, " ", -1)
    by_size = F.xxhash64(F.lit(1), F.get(words, F.lit(0)))
    for k in range(2, size + 1):
        by_size = F.when(F.size(words) == k, F.xxhash64(F.lit(k), *[F.get(words, F.lit(j)) for j in range(k)])).otherwise(by_size)
    return by_size


def _verify(docs: DataFrame, items: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    ids = candidates.select(F.col("doc_id").alias("candidate")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi").select("doc_id", words_of(F.col("text")).alias("w"))
    pairs = candidates.withColumnsRenamed({"doc_id": "candidate", "item_id": "wanted"})
    wanted = pairs.join(items, F.col("wanted").eqNullSafe(F.col("item_id"))).select(
        "candidate", "item_id", "size", F.transform("shingles", lambda s: s["text"]).alias("texts"))
    both = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("candidate")))
    mine = shingle_texts(F.col("w"), F.col("size"))
    shared = both.select("doc_id", "item_id", F.size(F.array_intersect("texts", mine)).cast("long").alias("n_shared"), F.size("texts").cast("long").alias("n_item"))
    best = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold))).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, each_row: bool = False) -> DataFrame:
    """The documents that hold no item, with all their columns.

    With ``each_row`` a row is judged by its own text, named by a digest, also where ids are null or repeated; without, all
    rows of an id are one document.
    """
    name = F.unhex(F.sha2(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8"), 256)) if each_row else docs["doc_id"]
    bad = find(docs.select(name.alias("doc_id"), "text"), items, size, threshold).select(F.col("doc_id").alias("found")).distinct()
    return docs.join(bad, name.eqNullSafe(bad["found"]), "left_anti")
