import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import repeats
from cohortlab.operators.merge import merge_on_keys, merge_stored
from cohortlab.operators.reshape import drop_exact_duplicates, duplicate_count
from cohortlab.sources.io import save_for_merge

SCHEMA = "id int, text string, x double, tags array<int>, `a.b` string"


def some_rows(seed=1, n=400):
    draw = random.Random(seed)
    rows = [(i, f"text {i}", i / 7, [i], "z") for i in range(n)]
    rows += [draw.choice(rows) for _ in range(30)] + [(None, "a", None, None, None), (None, "a", None, None, None), (None, None, None, None, "a"), (None, None, None, [None, 1], None), (None, None, None, [1, None], None)]
    rows += [(7, "zero", 0.0, [], ""), (7, "zero", -0.0, [], ""), (8, "nan", float("nan"), [], ""), (8, "nan", float("nan"), [], "")] + [(1, "hot", 1.0, [1], "h")] * 200
    return rows


def test_wide_rows_equal_plain_duplicates(spark, partitions):
    df = spark.createDataFrame(some_rows(), SCHEMA).repartition(partitions)
    assert not repeats.narrow(df)
    plain = df.dropDuplicates()
    got = drop_exact_duplicates(df)
    assert Counter(map(str, got.collect())) == Counter(map(str, plain.collect())) and got.columns == df.columns
    assert duplicate_count(df).first()[0] == df.count() - plain.count()


def test_only_repeats_are_shuffled(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    once, maybe = repeats.split_by_digest(df)
    assert once.count() + maybe.count() == df.count()
    again = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count().where("count > 1").agg(F.sum("count")).first()[0]
    assert again <= maybe.count() <= again + 10
    shuffled = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in shuffled


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_BITS", 8)
    monkeypatch.setattr(repeats, "LEAST_BITS", 8)
    df = spark.createDataFrame(some_rows(2), SCHEMA)
    assert repeats.split_by_digest(df)[1].count() > 300
    assert drop_exact_duplicates(df).count() == df.dropDuplicates().count()
    assert duplicate_count(df).first()[0] == df.count() - df.dropDuplicates().count()


def test_narrow_and_empty_tables(spark):
    narrow = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "a int, b double")
    assert repeats.narrow(narrow) and drop_exact_duplicates(narrow).count() == 2 and duplicate_count(narrow).first()[0] == 1
    texts = spark.createDataFrame([("F", "x" * n) for n in (1, 1, 2)], "a string, b string")
    assert repeats.narrow(texts) and drop_exact_duplicates(texts).count() == 2
    assert not repeats.narrow(texts.withColumn("c", F.repeat("b", F.lit(200))))
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_exact_duplicates(empty).count() == 0 and duplicate_count(empty).first()[0] == 0


def test_stored_sources_merge_without_exchange(spark, tmp_path):
    draw = random.Random(3)
    sources = {f"s{i}": spark.createDataFrame([(f"k{k}", k % 5, float(k * i)) for k in draw.sample(range(90), 40)], f"region string, year int, v{i} double") for i in range(4)}
    tables = save_for_merge(sources, ["region", "year"], "stored", str(tmp_path / "m"), 6)
    merged = merge_stored(spark, "stored", tables, ["region", "year"])
    want = merge_on_keys(list(sources.values()), ["region", "year"], "outer", unique_keys=True)
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, want.collect()))
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def test_stored_sources_need_single_known_keys(spark, tmp_path):
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    tables = save_for_merge({"x": twice}, ["k"], "twice", str(tmp_path / "t"), 2)
    with pytest.raises(Exception, match="repeats a key"):
        merge_stored(spark, "twice", tables, ["k"]).collect()
    with pytest.raises(Exception, match="a null in key k"):
        save_for_merge({"x": spark.createDataFrame([(None, 1)], "k string, v int")}, ["k"], "nulls", str(tmp_path / "n"), 2)
