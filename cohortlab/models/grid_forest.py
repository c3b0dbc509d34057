"""Forest regression over a grid of bins: one scan adds up every tree's bootstrap by cell, one task a tree grows it.

A tree over binned features can't tell rows of one cell apart, so a cell's drawn rows and their sum of targets are all that it needs.
The grid has a cell for every combination of bins, whatever the rows, so this is the way for few features: tables whose
grid would have more than ``MOST_CELLS`` go to another trainer. Nothing is stored per row, and draws follow the partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.boosting import Batches, quantile_cuts
from cohortlab.models.features import FEATURES, with_features

BINS = 32
MOST_CELLS = 4096
#: Rows whose draws for all trees are in memory at a time.
ROWS_AT_ONCE = 4096


def sizes(cuts: list[np.ndarray]) -> list[int]:
    return [len(c) + 1 for c in cuts]


def cells_of(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of each row's cell."""
    if not np.isfinite(values).all():
        raise ValueError("a feature is missing or not finite")
    return np.ravel_multi_index([np.searchsorted(c, values[:, j], "left") for j, c in enumerate(cuts)], sizes(cuts))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(FEATURES).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def grow(n: np.ndarray, s: np.ndarray, shape: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(fall of the squared error by feature, prediction of every cell) of a tree, from each cell's rows and sum of targets."""
    codes, width = np.stack(np.unravel_index(np.arange(prod(shape)), shape), axis=1), max(shape)
    falls, value = np.zeros(len(shape)), np.full(len(n), s.sum() / max(n.sum(), 1.0))
    cells, slot, nodes = np.arange(len(n)), np.zeros(len(n), np.int64), 1
    for _ in range(depth):
        best, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        means = np.zeros((nodes, 2))
        for j in range(len(shape)):
            at = slot * width + codes[cells, j]
            left_n, left_s = (np.cumsum(np.bincount(at, x[cells], nodes * width).reshape(nodes, width), axis=1) for x in (n, s))
            whole_n, whole_s = left_n[:, -1:], left_s[:, -1:]
            right_n, right_s = whole_n - left_n, whole_s - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                whole = whole_s**2 / whole_n
                fall = left_s**2 / left_n + right_s**2 / right_n - whole
                sides = np.stack([left_s / left_n, right_s / right_n], axis=2)
                fall = np.where((left_n >= 1) & (right_n >= 1) & (fall > 1e-12 * whole), fall, -np.inf)
            k, rows = np.argmax(fall, axis=1), np.arange(nodes)
            better = fall[rows, k] > best
            best[better], feature[better], cut[better], means[better] = fall[rows, k][better], j, k[better], sides[rows, k][better]
        split = np.isfinite(best)
        if not split.any():
            break
        falls += np.bincount(feature[split], best[split], len(shape))
        child = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        kept = split[slot]
        cells, slot = cells[kept], slot[kept]
        right = codes[cells, feature[slot]] > cut[slot]
        value[cells] = means[slot, right.astype(int)]
        slot, nodes = child[slot] + right, 2 * int(split.sum())
    return falls, value


def tree_tables(rows: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, seed: int) -> DataFrame:
    """(tree, rows, falls, value): each tree, grown in one task from the tasks' sums."""
    shape = sizes(cuts)

    def sums(batches: Batches) -> Batches:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = np.zeros((trees, 2, prod(shape)))
        for whole in batches:
            for first in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(y).all():
                    raise ValueError("a target is missing or not finite")
                cell = cells_of(_matrix(batch, len(cuts)), cuts)
                for t, times in enumerate(rng.poisson(1.0, (trees, len(y)))):
                    total[t, 0] += np.bincount(cell, times, total.shape[2])
                    total[t, 1] += np.bincount(cell, times * y, total.shape[2])
        held = [np.flatnonzero(total[t, 0]) for t in range(trees)]
        columns = [pa.array(np.arange(trees, dtype=np.int32)), pa.array([h.astype(np.int32).tobytes() for h in held]),
                   *[pa.array([total[t, i, h].tobytes() for t, h in enumerate(held)]) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "cell", "n", "s"])

    def tree(table: pa.Table) -> pa.Table:
        n, s = np.zeros(prod(shape)), np.zeros(prod(shape))
        for cell, some_n, some_s in zip(*[table.column(c).to_pylist() for c in ("cell", "n", "s")], strict=True):
            at = np.frombuffer(cell, np.int32)
            n[at] += np.frombuffer(some_n)
            s[at] += np.frombuffer(some_s)
        falls, value = grow(n, s, shape, depth)
        return pa.table([table.column("tree").slice(0, 1), pa.array([n.sum()]), pa.array([falls.tolist()]), pa.array([value.tolist()])], names=["tree", "rows", "falls", "value"])

    found = rows.mapInArrow(sums, "tree int, cell binary, n binary, s binary")
    return found.groupBy("tree").applyInArrow(tree, "tree int, rows double, falls array<double>, value array<double>")


@dataclass
class GridForest:
    """Fitted forest over named feature columns: a prediction for every cell."""

    features: list[str]
    cuts: list[np.ndarray]
    values: np.ndarray
    weights: np.ndarray
    params: dict[str, int]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        cuts, values = self.cuts, self.values

        @F.pandas_udf("double")
        def predicted(features: pd.Series) -> pd.Series:
            return pd.Series(values[cells_of(np.stack(features.to_numpy()).astype(float), cuts)] if len(features) else [], dtype=float)

        found = with_features(df.select(*[c for c in df.columns if c != out]), self.features, "_features")
        return found.withColumn(out, predicted("_features")).drop("_features")

    def importances(self, df: DataFrame) -> DataFrame:
        """(feature, importance)."""
        rows = list(zip(self.features, self.weights.tolist(), strict=True))
        return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def fit_grid_forest(df: DataFrame, features: list[str], target: str, trees: int, depth: int, seed: int) -> GridForest | None:
    """The forest, every tree over all features; None if the grid would be too large."""
    rows = with_features(df, features).select(FEATURES, F.col(f"`{target}`").cast("double").alias("y"))
    cuts = quantile_cuts(rows, len(features), BINS)
    if prod(sizes(cuts)) > MOST_CELLS:
        return None
    grown = tree_tables(rows, cuts, trees, depth, seed).orderBy("tree").collect()  # one row a tree, of at most MOST_CELLS numbers
    drawn = [r for r in grown if r["rows"]]
    if not drawn:
        raise ValueError("no training row")
    shares = np.array([r["falls"] for r in drawn])
    shares = (shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
    return GridForest(features, cuts, np.mean([r["value"] for r in drawn], axis=0), shares / shares.sum() if shares.sum() else shares,
                      {"trees": trees, "depth": depth, "seed": seed})
