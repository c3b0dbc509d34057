"""Registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import (
    alignment, conversation_trie, decontaminate, group_matrix, hilbert, lengths, line_dedup, packing, pairwise_quality, passages, quality_rules, training_order, url_intervals,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.risk_controlled(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op2_training_order(spark: SparkSession, sf: str) -> DataFrame:
    return training_order.training_order(training_order.store_sequences(_table(spark, sf, "documents")))


def op3_pairwise_quality(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise_quality.score_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op4_collinear_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf, "documents")).drop("key")


def op5_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.length_table(lengths.encoded_lengths(_table(spark, sf, "documents")))


def op6_group_matrix_join(spark: SparkSession, sf: str) -> DataFrame:
    return group_matrix.join_groups(_table(spark, sf, "documents"))


def op7_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.hilbert_shards(_table(spark, sf, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op10_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_intervals.judge(_table(spark, sf, "pages"), url_intervals.rule_table(spark, URL_RULES))


def op11_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf, "documents"))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    kept = line_dedup.kept_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    convs, turns = conversation_trie.head_swap(_table(spark, sf, "conversations"))
    return conversation_trie.trie_nodes(convs, turns)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '')"
OP9_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p, w FROM iw WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS t FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM dw, (SELECT DISTINCT k FROM s) WHERE len(w) >= k),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS t FROM d),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN s USING (k, t) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8)"""
OP10_SQL = """
WITH r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
f AS (SELECT p.*, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1"""
OP12_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

_ALL = [
    op1_quality_rules, op2_training_order, op3_pairwise_quality, op4_collinear_passages, op5_length_histogram, op6_group_matrix_join, op7_hilbert_shards, op8_best_fit_packing,
    op9_benchmark_decontamination, op10_url_rules, op11_tokenizer_alignment, op12_line_dedup,
    op13_conversation_trie,
]
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op9_benchmark_decontamination": OP9_SQL, "op10_url_rules": OP10_SQL, "op12_line_dedup": OP12_SQL}
