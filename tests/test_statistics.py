import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators.correlation import correlation_matrix, label_correlation
from cohortlab.operators.correlation import _by_blocks
from cohortlab.operators.distribution import feature_error_by_class, histogram, kernel_density, percentile
from cohortlab.operators import quantiles
from cohortlab.operators.quantiles import box_statistics, exact_quantiles, tally
from cohortlab.operators.reshape import duplicate_count, metrics_long
from cohortlab.operators.split import assign_folds, fixed_sample, sample_keeping, split_rows


def sample(n=4000, seed=3):
    """Values with a hot one (a third of all rows) and a rare class."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.exponential(10, n), 2)
    x[: n // 3] = 7.5
    y = (rng.random(n) < 0.03).astype(int)
    return [(int(i), float(v), int(c)) for i, (v, c) in enumerate(zip(x, y))]


@pytest.fixture
def frame(spark, partitions):
    return spark.createDataFrame(sample(), "id long, x double, y int").repartition(partitions)


def test_quantiles(frame):
    data = sample()
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = {(r.y, r.probability): r.value for r in exact_quantiles(frame, ["x"], probabilities, ["y"]).collect()}
    for c in (0, 1):
        values = [v for _, v, k in data if k == c]
        for p in probabilities:
            assert found[(c, p)] == pytest.approx(np.percentile(values, 100 * p), abs=1e-9)


def test_quantiles_edge_cases(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", float("nan")), (None, 9.0), ("d", 1.0), ("d", 2.0)], "k string, v double")
    found = {r.k: r.value for r in exact_quantiles(df, ["v"], [0.5], ["k"]).collect()}
    assert found == {"a": 3.0, "d": 1.5}
    assert percentile(df.filter("false"), "v", 0.5) is None
    extreme = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,)], "v double")
    assert percentile(extreme, "v", 0.5) == 0.0
    with pytest.raises(ValueError):
        exact_quantiles(df, ["v"], [1.5])


def test_box(frame):
    data = sample()
    found = {(r.y, r.feature): r for r in box_statistics(frame, ["x"], "y").collect()}
    for c in (0, 1):
        v = np.array([x for _, x, k in data if k == c])
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        r = found[(c, "x")]
        assert (r.q1, r["median"], r.q3) == pytest.approx((q1, med, q3))
        assert r.whisker_high == max(q3, v[v <= q3 + 1.5 * (q3 - q1)].max())
        assert r.whisker_low == min(q1, v[v >= q1 - 1.5 * (q3 - q1)].min())


def test_histogram(frame):
    data = sample()
    top = np.percentile([v for _, v, _ in data], 99)
    edges = np.linspace(0, top, 60)
    rows = histogram(frame, "x", "y").collect()
    assert len(rows) == 2 * 59
    for c in (0, 1):
        v = [x for _, x, k in data if k == c]
        counts = [r.n for r in sorted((r for r in rows if r.y == c), key=lambda r: r.bin)]
        assert counts == list(np.histogram(v, edges)[0])
        area = sum(r.density * (r.high - r.low) for r in rows if r.y == c)
        assert area == pytest.approx(1.0)


def skewed(spark, n=6000):
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.lognormal(size=n // 2), np.repeat(1.5, n // 3), draw.normal(size=n - n // 2 - n // 3) * 100])
    y = (draw.random(n) < 0.3).astype(int)
    rows = [(int(b), float(a), float(-a)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, None, float("nan"))], "y int, x double, z double").repartition(5), x, y


@pytest.mark.parametrize(("error", "in_order"), [(None, None), (1e-6, None), (None, 10), (1e-6, 10)])
def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch, error, in_order):
    """Probes that are too narrow are widened; ranking by value ranges gives the same."""
    if error:
        monkeypatch.setattr(quantiles, "rank_error", lambda: error)
    if in_order:
        monkeypatch.setattr(quantiles, "ROWS_IN_ORDER", in_order)
    df, x, y = skewed(spark)
    probabilities = [0.0, 0.003, 0.25, 0.5, 0.501, 0.99, 1.0]
    got = {(r.y, r.column, r.probability): r.value for r in exact_quantiles(df, ["x", "z"], probabilities, ["y"]).collect()}
    assert len(got) == 28
    for (c, column, p), value in got.items():
        assert value == pytest.approx(np.percentile((x if column == "x" else -x)[y == c], 100 * p), abs=1e-9)
    for r in box_statistics(df, ["x"], "y").collect():
        v = x[y == r.y]
        q1, q3 = np.percentile(v, [25, 75])
        assert r.whisker_low == pytest.approx(min(v[v >= q1 - 1.5 * (q3 - q1)].min(), q1))
        assert r.whisker_high == pytest.approx(max(v[v <= q3 + 1.5 * (q3 - q1)].max(), q3))


def test_quantiles_read_their_table_twice(spark):
    df, x, _ = skewed(spark)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = df.mapInArrow(count, df.schema)
    exact_quantiles(watched, ["x", "z"], [0.1, 0.5, 0.9], ["y"]).collect()
    assert read.value == 2 * (len(x) + 2)
    box_statistics(watched, ["x", "z"], "y").collect()
    assert read.value == 4 * (len(x) + 2)


def test_stored_sketches_of_parts_answer_for_the_whole(spark):
    df, x, _ = skewed(spark, 60_000)
    parts = quantiles.quantile_sketches(df.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(7))), ["x"], ["part"])
    merged = quantiles.merge_sketches(parts)
    assert merged.first()["n"] == len(x) + 1
    for r in quantiles.sketched_quantiles(merged, [0.1, 0.6, 0.95]).collect():
        low, high = (x < r.value).mean(), (x <= r.value).mean()
        assert low - 3 * quantiles.rank_error() <= r.probability <= high + 3 * quantiles.rank_error()


def test_quantiles_with_dotted_names(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "key int, `x.y` double")
    assert {(r.key, r.column, r.value) for r in exact_quantiles(df, ["x.y"], [0.5], ["key"]).collect()} == {(1, "x.y", 3.0), (2, "x.y", 5.0)}


def test_kernel_density(frame):
    data = sample()
    rows = kernel_density(frame, "x", "y").collect()
    for c in (0, 1):
        v = np.array([x for _, x, k in data if k == c])
        h = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        got = sorted((r.point, r.x, r.density) for r in rows if r.y == c)
        assert [g[1] for g in got] == pytest.approx(list(grid))
        assert [g[2] for g in got] == pytest.approx(list(want))


def test_kernel_density_equals_the_direct_sum_and_stays_in_the_jvm(spark):
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.normal(size=3000), draw.exponential(size=200) * 50, [1e4, -3e4, 7.5, 7.5]])
    df = spark.createDataFrame([(float(v), 1) for v in x] + [(None, 1), (float("nan"), 1), (2.0, None)], "x double, y int")
    density = kernel_density(df, "x", "y")
    rows = sorted(density.collect(), key=lambda r: r.point)
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert [r.point for r in rows] == list(range(200)) and np.allclose([r.x for r in rows], grid)
    assert np.abs(np.array([r.density for r in rows]) - want).max() < 1e-13 / h
    plan = density._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_density_of_a_constant_class_is_left_out(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 2.0)], "y int, x double")
    assert {r.y for r in kernel_density(df, "x", "y").collect()} == {1}


def test_correlations(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(1e6, 1.0, (300, 4))
    data[:, 1] = data[:, 0] * 2 + rng.normal(0, 1, 300)
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in data]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("k", F.lit(1.0))
    import pandas as pd

    want = pd.DataFrame(rows, columns=list("abcd"), dtype=float).corr()
    for fn in (correlation_matrix, _by_blocks):
        found = {(r.a, r.b): r["corr"] for r in fn(df, [*"abcd", "k"]).collect()}
        for p in "abcd":
            for q in "abcd":
                if (p, q) in found:
                    assert found[(p, q)] == pytest.approx(want.loc[p, q], abs=1e-6)
        assert found[("a", "k")] is None and found[("k", "k")] is None
    ranked = [r.feature for r in label_correlation(df, ["a", "b"], "a").collect()]
    assert ranked == ["b", "a"]


def place(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_stratified_split(frame):
    data = sample()
    flagged = {r.id: r.is_test for r in split_rows(frame, "id", 0.2, "y").collect()}
    assert len(flagged) == len(data)
    assert sum(flagged.values()) == math.ceil(0.2 * len(data))
    for c in (0, 1):
        ids = sorted((i for i, _, k in data if k == c), key=lambda i: (place(i), i))
        taken = [i for i in ids if flagged[i]]
        assert taken == ids[: len(taken)]
        assert abs(len(taken) - 0.2 * len(ids)) < 1


def test_small_strata(spark):
    df = spark.createDataFrame([(i, 0) for i in range(7)] + [(7, 1)], "id long, y int")
    flagged = split_rows(df, "id", 0.25, "y")
    assert flagged.filter("is_test").count() == 2
    assert flagged.count() == 8


def test_folds(frame):
    data = sample()
    found = {r.id: r.fold for r in assign_folds(frame, "id", 3, "y").collect()}
    for c in (0, 1):
        ids = sorted((i for i, _, k in data if k == c), key=lambda i: (place(i), i))
        want = [f for f, block in enumerate(np.array_split(ids, 3)) for _ in block]
        assert [found[i] for i in ids] == want


def test_more_folds_than_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(r.fold for r in assign_folds(df, "id", 5).collect()) == [0, 1]


def test_samples(frame):
    data = sample()
    ids = sorted((i for i, _, _ in data), key=lambda i: (place(i), i))
    assert {r.id for r in fixed_sample(frame, "id", 100).collect()} == set(ids[:100])
    assert fixed_sample(frame, "id", 10**6).count() == len(data)
    assert fixed_sample(frame.filter("false"), "id", 5).count() == 0
    kept = sample_keeping(frame, "id", "y", 50)
    assert kept.filter("y = 0").count() == 50
    assert kept.filter("y = 1").count() == sum(k for _, _, k in data)


def test_small_reshapes(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "a int, b string")
    assert duplicate_count(df).first().n_duplicates == 2
    assert duplicate_count(df.filter("false")).first().n_duplicates == 0
    wide = spark.createDataFrame([("m", 0.5, 0.25)], "model string, p double, q double")
    assert sorted(tuple(r) for r in metrics_long(wide).collect()) == [("m", "p", 0.5), ("m", "q", 0.25)]
    errors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "y int, e array<double>")
    found = {(r.y, r.feature): r.mean_error for r in feature_error_by_class(errors, "e", ["f", "g"], "y").collect()}
    assert found == {(0, "f"): 2.0, (0, "g"): 3.0, (1, "f"): 5.0, (1, "g"): 6.0}


def test_tally_compiles_to_methods_the_jvm_optimises(spark, capsys):
    columns = [f"c{i}" for i in range(4)]
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), *[(F.col("id") * (i + 1) % 997).cast("double").alias(c) for i, c in enumerate(columns)])
    infinite = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    near = F.struct(F.lit(10.0).alias("low"), F.lit(20.0).alias("high"))
    probes = spark.createDataFrame([(y, c) for y in (0, 1) for c in columns], "y long, column string").withColumn("probes", F.array(near, infinite, near, near, near))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tallied = tally(df, columns, ["y"], probes)
        tallied.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer methods
    assert tallied.agg(F.sum("n")).first()[0] == 2000 * len(columns)
