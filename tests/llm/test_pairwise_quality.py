import numpy as np
import pyarrow as pa
from llm_support import ODD, prose, table

from cohortlab.llm import pairwise_quality as pq


def junk(i):
    kinds = [" ".join(f"w{j}$$$" for j in range(60)), prose(i, 60).upper() + "!! " * 20, "buy this now\n" * 30]
    return kinds[i % 3] + f" {i}"


def test_held_out_accuracy_and_cases(spark):
    rows = [(i, prose(i, 20 + i % 200)) for i in range(300)] + [(1000 + i, junk(i)) for i in range(90)]
    docs = table(spark, [*rows, (3, prose(3, 23)), *ODD])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows] + [(None, 0, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = pq.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + 1 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 90000]
    assert 40 < len(held) < 130 and np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) > 0.97
    kept = pq.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in got if r.predicted} == {r.doc_id for r in kept.collect()}


def test_rows_at_the_driver_are_bounded(spark, monkeypatch):
    """Repeated ids bring one row each, however many documents share them."""
    rows = [(1, prose(i, 20)) for i in range(300)] + [(2 + i, prose(900 + i, 20)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(42)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(pq, "fit", lambda x, good: seen.append(len(x)) or pq.Model(np.zeros(pq.FEATURES), 0.0, 1.0))
    pq.learn(table(spark, rows), labels, max_labelled=10)
    assert 0 < seen[0] <= 10


def test_pairs_are_won_by_the_preferred(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 4))
    good = x @ np.array([1.0, -2.0, 0.0, 0.5]) > -1.2
    model = pq.fit(x, good, pairs=5000)
    s = model.score(x)
    assert (s[good][:, None] > s[~good][None, :]).mean() > 0.99 and ((s >= pq.CUT) == good).mean() > 0.97


def test_labels_of_one_kind_or_none(spark):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(103, 1, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("false")):
        assert {r.score for r in pq.score_documents(docs, marks).collect()} == {0.5}
    assert pq.score_documents(docs.where("false"), labels).count() == 0
    assert pq.features(pa.array([], pa.string())).shape[1] == pq.FEATURES
