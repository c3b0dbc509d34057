"""Bradley-Terry quality scores: features of a text, weighted so that preferred documents win their pairs.

A document labelled good is preferred to one labelled bad. Weights minimise the logistic loss of the weighted feature
differences of ``PAIRS`` such pairs (Newton steps, L2 penalty). The pairs come from at most ``MAX_LABELLED`` labelled
documents, the first by a hash of their id: a documented bound on what the fit sees, and the only rows that reach the
driver, as a feature matrix. The cut is a quantile of the raw scores, the one with the best balanced accuracy on the
labelled documents; a raw score at the cut maps to a score of ``CUT`` and others follow by a logistic curve.

Features are shares of a text's counts; language, source and id are no inputs.

Cases: a null or empty text is scored as a text without words; repeated rows are scored each; null labels and labels
without a document are left out; with labels of one kind only, or none, every score is 0.5; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import text_stats
from cohortlab.llm.frames import map_rows
from cohortlab.session import bound_batches

MAX_LABELLED = 20_000
PAIRS = 60_000
CUT = 0.3
PENALTY = 1e-3
FEATURES = 15


def features(texts: pa.Array) -> np.ndarray:
    """Row features, each in a bounded range."""
    c = {k: v.astype(float) for k, v in text_stats.counts(texts).items()}
    words, chars, letters, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_letters", "n_lines"))
    symbols, upper, dup, repeat = c["n_symbols"] / chars, c["n_upper"] / letters, c["n_dup_lines"] / lines, c["n_repeat_words"] / words
    columns = [
        np.minimum(1, 5 * symbols), np.minimum(1, symbols * chars / words), np.minimum(1, 2 * upper), np.minimum(1, c["n_exclaim"] / words), np.minimum(1, 2 * dup),
        np.minimum(1, 3 * repeat), c["n_digits"] / chars, c["n_punctuation"] / chars, c["n_wide"] / chars, np.minimum(1, chars / words / 20),
        np.log1p(c["n_words"]) / 12, c["n_distinct_words"] / words, np.minimum(1, lines / words * 5), (c["n_words"] == 0).astype(float), np.sqrt(np.minimum(1, symbols)),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = (x @ self.weights - self.cut) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, seed: int = 7) -> Model:
    """Weights from pairs of a good and a bad row, and the quantile cut."""
    if good.all() or not good.any():
        return Model(np.zeros(x.shape[1]), 0.0, 1.0)
    draw = np.random.default_rng(seed)
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[draw.choice(win, pairs)] - x[draw.choice(lose, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ p / pairs - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    sorted_raw, sorted_good = raw[order], good[order]
    below_bad, below_good = np.cumsum(~sorted_good), np.cumsum(sorted_good)
    balanced = below_bad / below_bad[-1] + 1 - below_good / below_good[-1]
    balanced[:-1][sorted_raw[:-1] == sorted_raw[1:]] = -1
    best = np.flatnonzero(balanced[:-1] >= balanced[:-1].max() - 1e-12)
    at = int(best[-1])
    return Model(w, float((sorted_raw[at] + sorted_raw[at + 1]) / 2), float(max(raw.std() / 4, 1e-9)))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled documents that are not held out, at most ``max_labelled``: a repeated id brings one row, that with the least features."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out())
    chosen = marks.orderBy(F.xxhash64("doc_id"), "quality").limit(max_labelled)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def extract(batch: pa.RecordBatch) -> dict[str, object]:
        x = features(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality").cast(pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))}

    each = map_rows(known, extract, "doc_id long, quality int, x array<double>")
    rows = each.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "quality"])
    if not len(rows):
        return fit(np.zeros((0, FEATURES)), np.zeros(0, bool))
    return fit(np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy() == 1)


def score_column(model: Model, text: str = "text") -> Column:
    """The score of a text column, for use in any projection."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        from cohortlab.llm.words import chunks

        column = pa.array(texts, pa.large_string(), from_pandas=True)
        parts = [model.score(features(part)) for _, part in chunks(column)]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = learn(docs, labels)

    def judge(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "score": model.score(features(batch.column("text")))}

    scored = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), judge, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, with all their columns."""
    bound_batches(docs.sparkSession)
    return docs.where(score_column(learn(docs, labels)) >= CUT)
