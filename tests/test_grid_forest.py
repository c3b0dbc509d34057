import numpy as np
import pytest

from cohortlab.models import grid_forest
from cohortlab.models.supervised import fit_forest_regression


def frame(spark, n=3000, parts=3):
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 20, n), draw.integers(0, 9, n)
    t = np.where(a > 11, 50.0, 0.0) + 3.0 * b + draw.normal(size=n)
    return spark.createDataFrame(list(zip(a.tolist(), b.tolist(), t.tolist())), "a long, b long, t double").repartition(parts)


def test_a_tree_over_cells_equals_one_over_rows():
    draw = np.random.default_rng(5)
    shape = [6, 5]
    cell = draw.integers(0, 30, 400)
    y = np.where(cell // 5 > 2, 4.0, 1.0) + (cell % 5) * 0.3 + draw.normal(size=400)
    falls, value = grid_forest.grow(np.bincount(cell, minlength=30).astype(float), np.bincount(cell, y, 30), shape, 2)

    def plain(rows, depth):
        out, best = np.full(400, np.nan), None
        out[rows] = y[rows].mean()
        for code in (cell // 5, cell % 5):
            for cut in range(6):
                left, right = rows[code[rows] <= cut], rows[code[rows] > cut]
                if depth and len(left) and len(right):
                    error = sum(((y[r] - y[r].mean()) ** 2).sum() for r in (left, right))
                    if best is None or error < best[0]:
                        best = error, left, right
        for side in best[1:] if best else ():
            out[side] = plain(side, depth - 1)[side]
        return out

    want = plain(np.arange(400), 2)
    assert np.allclose(value[cell], want)
    assert np.isclose(falls.sum(), ((y - y.mean()) ** 2).sum() - ((y - want) ** 2).sum())


def test_nothing_is_kept_per_row_and_tree(spark):
    """Few features: a table of cells, whatever the rows. The forest before kept a number per row and tree."""
    df = frame(spark)
    model = fit_forest_regression(df, ["a", "b"], "t", trees=20)
    assert isinstance(model, grid_forest.GridForest) and len(model.values) <= grid_forest.MOST_CELLS
    found = model.predict(df).select("t", "prediction").toPandas()
    assert ((found.t - found.prediction) ** 2).mean() < 1.5
    weights = {r["feature"]: r["importance"] for r in model.importances(df).collect()}
    assert weights["a"] > 0.8 and np.isclose(sum(weights.values()), 1)


def test_both_ways_agree(spark, monkeypatch):
    df = frame(spark)
    grid = fit_forest_regression(df, ["a", "b"], "t", trees=12, depth=5)
    monkeypatch.setattr(grid_forest, "MOST_CELLS", 10)
    other = fit_forest_regression(df, ["a", "b"], "t", trees=12, depth=5)
    assert [m.getNumTrees for m in other.models] == [10, 2]
    a, b = (np.array([r[0] for r in m.predict(df).orderBy("a", "b", "t").select("prediction").collect()]) for m in (grid, other))
    assert np.abs(a - b).mean() < 0.5
    shares = [[r["importance"] for r in m.importances(df).collect()] for m in (grid, other)]
    assert np.allclose(*shares, atol=0.02)


def test_missing_numbers_are_an_error(spark):
    df = frame(spark, 30).selectExpr("a", "b", "if(a > 10, null, t) AS t")
    with pytest.raises(Exception, match="missing"):
        fit_forest_regression(df, ["a", "b"], "t", trees=2)
