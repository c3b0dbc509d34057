import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.models.autoencoder import (
    PlainObjective, VariationalObjective, fit_autoencoder, fit_variational, latent_projection,
)
from cohortlab.models import oneclass
from cohortlab.models.evaluate import (
    cross_validate, cross_validate_linear, regression_metrics, train_and_evaluate, validate_input,
)
from cohortlab.models.features import supervised_data, unsupervised_data
from cohortlab.models.linear import fit_linear
from cohortlab.models.oneclass import OneClassObjective, fit_oneclass
from cohortlab.models.stack import fit_stacked, out_of_fold_scores
from cohortlab.models.supervised import fit_boosted, fit_forest, fit_forest_regression, fit_logistic
from cohortlab.operators.ranked import curve_points, model_scores, roc_auc
from cohortlab.plans.anomaly import AnomalySettings, clean, explore, prepare, run

D = 6
COLUMNS = [f"v{i}" for i in range(D)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(500) < 0.15).astype(int)
    base = rng.normal(0, 1, (500, 2))
    x = np.hstack([base, base @ rng.normal(0, 1, (2, D - 2))]) + 0.05 * rng.normal(0, 1, (500, D))
    x[y == 1] += rng.normal(0, 3, (int(y.sum()), D))
    rows = [(int(i), *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"{c} double" for c in COLUMNS], "y int"])).cache()


@pytest.fixture(scope="module")
def arrays(labelled):
    return supervised_data(labelled, "id", COLUMNS, "y").cache()


def auc(df, score="score"):
    return roc_auc(curve_points(model_scores(df, "y", [score]))).first().roc_auc


def loop(x, y, rate=0.01, iterations=1000, tolerance=1e-6):
    """Plain gradient descent on standardised data."""
    mx, sx, my, sy = x.mean(0), x.std(0), y.mean(), y.std() or 1.0
    sx[sx == 0] = 1
    u, v = (x - mx) / sx, (y - my) / sy
    w, b, costs = np.zeros(x.shape[1]), 0.0, []
    for _ in range(iterations):
        e = v - u @ w - b
        costs.append(np.mean(e * e))
        if len(costs) > 1 and abs(costs[-2] - costs[-1]) < tolerance:
            break
        w, b = w + rate * 2 / len(v) * u.T @ e, b + rate * 2 / len(v) * e.sum()
    return w * sy / sx, my + sy * b - (w * sy / sx) @ mx, costs


def test_linear_equals_the_loop(spark, labelled):
    rows = labelled.withColumn("t", 3 * F.col("v0") - F.col("v1") + 1e6).withColumn("flat", F.lit(2.0))
    names = ["v0", "v1", "v2", "flat"]
    data = np.array([[r[c] for c in [*names, "t"]] for r in rows.collect()])
    model = fit_linear(rows, names, "t")
    weights, intercept, costs = loop(data[:, :-1], data[:, -1])
    assert len(model.history) == len(costs)
    assert model.history == pytest.approx(costs, abs=1e-9)
    assert model.coefficients == pytest.approx(weights, abs=1e-9)
    assert model.intercept == pytest.approx(intercept)
    assert all(a >= b for a, b in zip(model.history, model.history[1:]))
    assert model.coefficient_table(rows).count() == 5
    assert model.predict_cohort(rows.withColumn("k", F.lit("A")), "B", "k").count() == 0


def test_constant_target(labelled):
    model = fit_linear(labelled.withColumn("t", F.lit(7.0)), ["v0"], "t")
    assert model.history[0] == 0.0 and model.intercept == pytest.approx(7.0)


def test_missing_input_is_refused(labelled):
    bad = labelled.withColumn("v0", F.when(F.col("id") != 3, F.col("v0")))
    with pytest.raises(ValueError):
        fit_linear(bad, ["v0"], "v1")
    with pytest.raises(ValueError):
        validate_input(labelled.withColumn("v0", F.lit(float("nan"))), ["v0"], "v1")


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    assert (row.r2, row.mae, row.rmse, row.mape) == pytest.approx((0.5, 0.5, 0.5**0.5, 50.0))
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert regression_metrics(flat, "y", "p").first().r2 == 1.0


def test_cross_validation(labelled):
    rows = labelled.withColumn("t", 3 * F.col("v0") + F.col("v3"))
    fast = {r.fold: (r.r2, r.mae, r.rmse) for r in cross_validate_linear(rows, "id", ["v0", "v1"], "t", 3).collect()}
    slow = {r.fold: (r.r2, r.mae, r.rmse) for r in cross_validate(rows, "id", ["v0", "v1"], "t", fit_linear, 3).collect()}
    assert fast.keys() == slow.keys() == {0, 1, 2}
    for f in fast:
        assert fast[f] == pytest.approx(slow[f])


def test_train_and_evaluate(labelled):
    rows = labelled.withColumn("t", 3 * F.col("v0"))
    table, model = train_and_evaluate(rows, "id", ["v0"], "t")
    found = {r.part: r for r in table.collect()}
    assert (found["train"].n, found["test"].n) == (400, 100)
    assert found["test"].r2 > 0.99 and model.params["iterations"] == 1000


def test_forest_regression(labelled):
    rows = labelled.withColumn("t", 3 * F.col("v0"))
    model = fit_forest_regression(rows, ["v0", "v5"], "t", trees=5, depth=4)
    found = {r.feature: r.importance for r in model.importances(rows).collect()}
    assert sum(found.values()) == pytest.approx(1.0)
    assert regression_metrics(model.predict(rows), "t", "prediction").first().r2 > 0.5


def test_supervised_scorers(arrays):
    for model in (fit_forest(arrays, "y", trees=10, depth=6), fit_boosted(arrays, "y", rounds=5)):
        scored = model.score(arrays)
        assert scored.columns == ["id", "features", "y", "score"]
        assert auc(scored) > 0.9
    assert fit_logistic(arrays, "y").score(arrays).filter("score between 0 and 1").count() == 500


def test_stacking(arrays):
    fits = {"lr": fit_logistic, "rf": lambda d, y: fit_forest(d, y, trees=5, depth=4)}
    scored = out_of_fold_scores(arrays, "id", "y", fits)
    assert scored.select("id").distinct().count() == scored.count() == 500
    assert scored.filter("lr is null or rf is null").count() == 0
    stacked = fit_stacked(scored, "y", ["lr", "rf"], trees=5, depth=4).score(scored, "both")
    assert stacked.select(F.max(F.size("features"))).first()[0] == D
    assert auc(stacked, "both") > 0.9


@pytest.mark.parametrize("objective", [PlainObjective(5), VariationalObjective(5), OneClassObjective(5, 0.3, width=16)])
def test_gradients(objective):
    rng = np.random.default_rng(2)
    w = objective.start(rng) + 0.01 * rng.normal(size=objective.start(rng).shape)
    x = rng.normal(size=(7, 5))
    _, gradient = objective.loss_and_gradient(w, x, 3)
    for i in rng.integers(0, len(w), 25):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (objective.loss_and_gradient(w + step, x, 3)[0] - objective.loss_and_gradient(w - step, x, 3)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-4, rel=1e-3)


@pytest.mark.parametrize("fit", [fit_autoencoder, fit_variational])
def test_autoencoders(arrays, fit):
    ordinary = unsupervised_data(arrays, "id", "y")
    model = fit(ordinary, "id", epochs=12, batch=32, rate=0.01, shards=2)
    assert model.fitted.history[-1] < model.fitted.history[0]
    scored = model.score(arrays)
    assert auc(scored) > 0.9
    again = fit(ordinary.repartition(7), "id", epochs=12, batch=32, rate=0.01, shards=2)
    assert again.fitted.weights == pytest.approx(model.fitted.weights)
    errors = model.feature_errors(arrays).select("id", F.aggregate("errors", F.lit(0.0), lambda a, e: a + e).alias("e"))
    for r in errors.join(scored, "id").limit(20).collect():
        assert r.e / D == pytest.approx(r.score)
    if fit is fit_variational:
        plane = latent_projection(model, arrays, "id", "y", 50)
        assert plane.filter("y = 0").count() == 50 and plane.filter("y = 1").count() == arrays.filter("y = 1").count()
    assert model.history_table(arrays).count() == 12


def test_oneclass(arrays):
    ordinary = unsupervised_data(arrays, "id", "y")
    model = fit_oneclass(ordinary, "id", nu=0.1, epochs=20, batch=64, shards=2)
    outside = model.score(ordinary).filter("score > 0").count() / ordinary.count()
    assert abs(outside - 0.1) < 0.02
    assert auc(model.score(arrays)) > 0.8


def test_oneclass_learns_from_every_row(spark):
    rows = spark.range(0, 12_000, 1, 4).select("id", F.array(F.when(F.col("id") % 2 == 0, F.rand(1)).otherwise(F.rand(2) + 9), F.rand(3)).alias("features"))
    seen = spark.sparkContext.accumulator(0)

    class Counting(OneClassObjective):
        def loss_and_gradient(self, weights, x, epoch):
            seen.add(len(x))
            return super().loss_and_gradient(weights, x, epoch)

    held, oneclass.OneClassObjective = oneclass.OneClassObjective, Counting
    try:
        model = fit_oneclass(rows, "id", nu=0.1, epochs=2, width=16, shards=2)
    finally:
        oneclass.OneClassObjective = held
    assert seen.value == 2 * 12_000  # every row in both epochs
    assert model.score(rows).filter("score > 0").count() == pytest.approx(0.1 * 12_000, abs=3)  # the offset is a quantile of all rows


def test_cosine_of_turns_is_the_cosine():
    x = np.random.default_rng(0).uniform(-40, 40, (300, 7))
    assert np.allclose(oneclass.cosine_of_turns(x / (2 * np.pi)), np.cos(x), rtol=0, atol=1e-12)
    objective = OneClassObjective(7, 0.3, width=16)
    want = np.sqrt(2 / 16) * np.cos(x @ objective.directions + objective.phases)
    assert np.allclose(objective.lift(x), want, rtol=0, atol=1e-12)
    assert np.allclose(objective.margins(np.arange(16.0), x), want @ np.arange(16.0)) and objective.margins(np.arange(16.0), x[:0]).shape == (0,)


def test_whole_anomaly_job(spark, labelled):
    settings = AnomalySettings(epochs=3, batch=64, trees=4, depth=4, rounds=3, folds=2)
    doubled = labelled.unionByName(labelled.withColumn("id", F.col("id") + 1000)).unionByName(
        labelled.limit(1).withColumn("v0", F.lit(None).cast("double")))
    rows, train, test = prepare(doubled, "id", COLUMNS, "y", settings)
    assert rows.count() == 500 and clean(doubled.drop("id")).count() == 500
    assert (train.count(), test.count()) == (400, 100)
    assert train.agg(F.avg("v0")).first()[0] == pytest.approx(0.0, abs=1e-9)
    tables = explore(rows.withColumn("amount", F.abs("v0")), COLUMNS, "y", ["v0"], ["v0", "v1"], "amount")
    assert {k: t.count() for k, t in tables.items()} == {
        "class_balance": 2, "feature_boxes": 2, "feature_correlation": D, "correlation_matrix": 4, "amount_density": 400}
    result = run(doubled, "id", COLUMNS, "y", settings)
    assert result.scores.count() == 100
    assert result.metrics.count() == 8 and result.metrics.filter("roc_auc is null").count() == 0
    sizes = {k: t.count() for k, t in result.figures.items()}
    assert sizes["threshold_sweep"] == 400 and sizes["confusion"] == 8 and sizes["score_correlation"] == 64
    assert sizes["feature_error"] == 2 * D and sizes["latent_plane"] == 100 and sizes["metric_matrix"] == 40
