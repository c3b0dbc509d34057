"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose measure is above a cutoff. For each stratum (language) and rule the cutoffs of a fixed
ladder are tested from the loosest on: a cutoff is certified when the exact (Clopper-Pearson) upper bound of the share
of good documents that it rejects is at most ``risk / number of rules``, and the first that fails ends the ladder, which
needs no further correction. The confidence is divided over all strata and rules (Bonferroni). So with probability
``1 - delta`` no stratum loses more than ``risk`` of its good documents to the rules together. Of the certified cutoffs the
loosest is taken that rejects as many documents labelled bad as the strictest certified one. A stratum with too few labels
certifies nothing and loses nothing.

Cases: a null or empty text has no words, so its base check fails; a null language is a stratum of its own; labels that are
null or without a document count for nothing; repeated rows are judged each, repeated labels count each; without labels no
rule rejects; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import text_stats
from cohortlab.llm.frames import map_rows
from cohortlab.session import durable

RISK, DELTA = 0.05, 0.05
LADDERS: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02],
    "exclaim_rate": [1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
}


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), "text")

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "stratum": batch.column("stratum"), **text_stats.counts(batch.column("text"))}

    return map_rows(rows, count, "doc_id long, stratum string, " + text_stats.SCHEMA)


def measures() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"), "exclaim_rate": share("n_exclaim", "n_words"), "upper_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from its largest term down."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - _sum(n - k - 1, n, 1 - p)
    return _sum(k, n, p)


def _sum(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p) if k else 0.0
        k -= 1
    return min(1.0, total)


def choose_cutoff(ladder: list[float], n_good: int, good_rejected: list[int], bad_rejected: list[int], risk: float, delta: float) -> float | None:
    """The loosest certified cutoff that rejects as many bad documents as the strictest certified one, or none."""
    certified = 0
    while certified < len(ladder) and n_good and binomial_tail(good_rejected[certified], n_good, risk) <= delta:
        certified += 1
    if not certified or not bad_rejected[certified - 1]:
        return None
    return next(c for c, b in zip(ladder, bad_rejected, strict=False) if b == bad_rejected[certified - 1])


def certify(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labels: ``stratum, n_good`` and a cutoff per rule (null: it rejects nothing)."""
    marks = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    measured = stats.where(~base_failed()).select("doc_id", "stratum", *[m.alias(r) for r, m in measures().items()])
    labelled = measured.join(marks, "doc_id")
    steps = [F.struct(F.lit(r).alias("rule"), _steps(F.col(r), ladder).alias("steps")) for r, ladder in LADDERS.items()]
    counts = durable(labelled.select("stratum", "good", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "good", "s.rule", "s.steps").agg(F.count("*").alias("n")))
    tests = max(1, counts.select("stratum").distinct().count()) * len(LADDERS)

    def certify_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, object] = {"stratum": key[0]}
        for rule, ladder in LADDERS.items():
            mine = rows[rows["rule"] == rule]
            good, bad = mine[mine["good"]], mine[~mine["good"]]
            above = lambda part: [int(part.loc[part["steps"] >= len(ladder) - i, "n"].sum()) for i in range(len(ladder))]  # noqa: B023, E731
            out["n_good"] = int(good["n"].sum())
            out[rule] = choose_cutoff(ladder, out["n_good"], above(good), above(bad), risk / len(LADDERS), delta / tests)
        return pd.DataFrame([out])[["stratum", "n_good", *LADDERS]].astype({r: float for r in LADDERS})

    return counts.groupBy("stratum").applyInPandas(certify_one, "stratum string, n_good long, " + ", ".join(f"{r} double" for r in LADDERS))


def _steps(value: Column, ladder: list[float]) -> Column:
    """How many cutoffs of the ladder the value is above: the lowest ones, at its end."""
    return sum((F.when(value > c, 1).otherwise(0) for c in ladder), F.lit(0))


def apply_rules(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The counts with ``base_failed``, ``kept`` and ``rejected_by``, the rules that reject a row."""
    cuts = cutoffs.select(F.col("stratum").alias("at"), *[F.col(r).alias(f"cut_{r}") for r in LADDERS])
    joined = stats.join(cuts, stats["stratum"].eqNullSafe(cuts["at"]), "left")
    rejected = F.filter(F.array(*[F.when(m > F.col(f"cut_{r}"), r) for r, m in measures().items()]), lambda r: r.isNotNull())
    judged = joined.withColumn("rejected_by", rejected).withColumn("base_failed", base_failed())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")


def risk_controlled(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Judge every document with the cutoffs certified on the labelled ones."""
    stats = durable(statistics(docs, stratum))
    return apply_rules(stats, durable(certify(stats, labels, risk, delta)))
