import pytest
from pyspark.sql import functions as F

from cohortlab.operators.aggregate import aggregate_by_region, composite_score
from cohortlab.operators.impute import class_weights, clip_outliers, fill_missing, fit_standard, min_max_scale, positive_weight
from cohortlab.operators.measure import prefer_measure, preferred_group_mean
from cohortlab.operators.merge import merge_on_keys, non_empty, proxy_fill
from cohortlab.operators.ranked import latest_periods

KEY = "birth_region_standardized string, year int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sources(spark):
    a = spark.createDataFrame([("A", 2013, 1.0), ("B", 2013, 2.0)], f"{KEY}, employment_rate double")
    b = spark.createDataFrame([("A", 2014, 5.0, 9.0), ("A", 2013, 6.0, 9.0)], f"{KEY}, median_income double, employment_rate double")
    c = spark.createDataFrame([("C", 2015, 7.0)], f"{KEY}, mv_asylum_count double")
    return [a, b, c]


def test_outer_merge_both_ways(sources):
    union, joins = merge_on_keys(sources, unique_keys=True), merge_on_keys(sources)
    assert union.columns == joins.columns
    assert rows(union) == rows(joins)
    assert ("A", 2013, 1.0, 6.0, None) in rows(union)
    assert ("A", 2014, None, 5.0, None) in rows(union)


@pytest.mark.parametrize("how, expected", [("inner", 1), ("left", 2), ("right", 2)])
def test_other_merges(sources, how, expected):
    assert merge_on_keys(sources[:2], how=how).count() == expected


def test_repeated_key_stops_the_union(sources):
    twice = sources[0].unionByName(sources[0])
    with pytest.raises(Exception, match="repeats a key"):
        merge_on_keys([twice, sources[1]], unique_keys=True).collect()


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(None, 2013, 1.0)], f"{KEY}, x double")
    b = spark.createDataFrame([(None, 2013, 2.0)], f"{KEY}, y double")
    assert rows(merge_on_keys([a, b], unique_keys=True)) == [(None, 2013, 1.0, 2.0)]


def test_no_source(sources):
    with pytest.raises(ValueError):
        merge_on_keys([])
    assert len(non_empty([sources[0], None, sources[1].limit(0)])) == 1


def test_proxy(spark):
    t = "Foreign Born (Total)"
    data = [(t, 2013, 5.0, 1.0), (t, 2014, None, 1.0), ("Africa", 2013, None, None), ("Africa", 2014, None, None),
            ("Sweden", 2013, None, None), ("Other", 2013, None, None), ("Asia", 2013, 3.0, None)]
    df = spark.createDataFrame(data, f"{KEY}, a_rate double, n_count double")
    found = {(r[0], r[1]): (r[2], r[3]) for r in proxy_fill(df).collect()}
    assert found[("Africa", 2013)] == (5.0, None)
    assert found[("Africa", 2014)] == (None, None)
    assert found[("Sweden", 2013)] == (None, None)
    assert found[("Other", 2013)] == (5.0, None)
    assert found[("Asia", 2013)] == (3.0, None)


def test_measure_choice(spark):
    df = spark.createDataFrame([("a", "Number of employed", 1.0), ("a", "x", 9.0), ("b", "number of EMPLOYED", 3.0)], "k string, o string, v double")
    assert prefer_measure(df, "o", "employment rate", "number of employed").count() == 2
    assert rows(preferred_group_mean(df, ["k"], "v", "o", "employment rate", "number of employed")) == [("a", 1.0), ("b", 3.0)]
    more = df.unionByName(spark.createDataFrame([("b", "Employment rate, total", 7.0)], df.schema))
    assert prefer_measure(more, "o", "employment rate", "number of employed").count() == 1
    assert rows(preferred_group_mean(more, ["k"], "v", "o", "employment rate", "number of employed")) == [("b", 7.0)]
    # A preferred row that does not enter the mean still decides the choice.
    assert rows(preferred_group_mean(more, ["k"], "v", "o", "employment rate", "number of employed", F.col("v") < 5)) == []


def test_fill(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 9.0, float("nan")), (4, None, 7.0)], "id int, a double, b double")
    median = {r.id: (r.a, r.b) for r in fill_missing(df, "median", ["id"]).collect()}
    assert median[4] == (2.0, 7.0) and median[1] == (1.0, 6.0) and median[3] == (9.0, 6.0)
    assert fill_missing(df, "mean", ["id"]).filter("id = 4").first().a == 4.0
    assert fill_missing(df, "zero", ["id"]).filter("id = 1").first().b == 0.0
    kept = fill_missing(df, "median", ["id", "b"]).filter("id = 1").first()
    assert kept.b is None and isinstance(kept.id, int)


def test_fill_of_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert rows(fill_missing(df, "median")) == [(1.0, None), (1.0, None)]


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (None, None)], "a double, b double")
    assert rows(min_max_scale(df, ["a", "b", "absent"])) == [(0.0, 5.0), (1.0, 5.0), (None, None)]
    assert fit_standard(df, ["a", "b"]) == {"a": (5.0, 5.0), "b": (5.0, 1.0)}
    assert rows(clip_outliers(df, "b")) == rows(df)
    clipped = clip_outliers(df, "a", 0.5)
    assert clipped.filter("a is null").count() == 1
    assert sorted(round(r.a, 6) for r in clipped.filter("a is not null").collect()) == [round(5 - 2.5 * 2**0.5, 6), round(5 + 2.5 * 2**0.5, 6)]


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "y int")
    assert {r.y: r.weight for r in class_weights(df, "y").collect()} == {0: 10 / 18, 1: 5.0}
    assert positive_weight(df, "y") == 9.0
    with pytest.raises(ValueError):
        positive_weight(df.filter("y = 0"), "y")


def test_region_functions(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 2, None), ("A", 3, 1.0), ("B", 1, None), (None, 1, 2.0)], "birth_region_standardized string, t int, v double")
    found = aggregate_by_region(df, ["v"])
    assert rows(found) == [("A", 3.0), ("B", None)]
    assert rows(aggregate_by_region(df, [], {"v": "last"}, order="t")) == [("A", 1.0), ("B", None)]
    assert rows(aggregate_by_region(df, [], {"v": "median"})) == [("A", 3.0), ("B", None)]
    with pytest.raises(ValueError):
        aggregate_by_region(df, [], {"v": "first"})
    with pytest.raises(ValueError):
        aggregate_by_region(df, [], {"v": "mode"})


def test_score(spark):
    df = spark.createDataFrame([("A", 1.0, 4.0), ("B", 3.0, 4.0), ("C", None, 4.0)], "birth_region_standardized string, x double, y double")
    found = {r[0]: r["integration_score"] for r in composite_score(df, ["x", "y"]).collect()}
    assert found == {"A": 0.0, "B": 0.5, "C": None}


def test_latest(spark):
    df = spark.createDataFrame([(2010,), (2012,), (2012,), (2015,), (2001,), (None,)], "year int")
    assert sorted(r.year for r in latest_periods(df, 2).collect()) == [2012, 2012, 2015]
