import random

import pytest
from llm_support import ODD, edited, prose, table, words_of

from cohortlab.llm import graph, group_matrix


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component id by position of the row."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                comp[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids and sets[i] else rows[i][0]))
    return out


def corpus(seed):
    draw = random.Random(seed)
    shared = prose(seed, 60)
    rows = []
    for family in range(12):
        base = prose((seed, family).__hash__(), draw.choice([6, 30, 80, 200]))
        rows += [edited(base, draw.random(), draw.choice([20, 40, 80, 10**9])) for _ in range(draw.randint(1, 8))]
    rows += [shared + " " + prose(draw.random(), draw.choice([40, 60, 5])) for _ in range(30)]
    chain = prose(seed + 1, 200).split()
    rows += [" ".join(chain[i : i + 120]) for i in range(0, 80, 9)]
    rows += ["a b a b a b a b a b a b a b", "A B a b a b a b a b a b", "k", "K", "k l", "x y z"]
    ids = draw.sample(range(1000, 5000), len(rows))
    return list(zip(ids, rows, strict=True)) + ODD


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = group_matrix.join_groups(table(spark, rows).repartition(3), cell_bits=10).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(a), n, str(c)) for a, n, c in brute(rows))


def test_tight_family_and_repeated_rows(spark):
    base = prose(5, 150)
    rows = [(i, edited(base, i, 60)) for i in range(120)] + [(500 + i, base) for i in range(40)] + [(500, base), (500, base)]
    got = group_matrix.join_groups(table(spark, rows), cell_bits=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


@pytest.mark.parametrize("block", [400, 10**6])
def test_loose_family_in_blocks(spark, block):
    """Copies at the edge of linking: most fail against their hub, and links run between any two of them."""
    base, other = prose(21, 120), prose(22, 120)
    rows = [(i, edited(base, 40 + i, [25, 30, 40][i % 3])) for i in range(90)]
    rows += [(200 + i, edited(other, i, 35) + " " + prose(300 + i, i % 30)) for i in range(60)]
    rows += [(400 + i, edited(" ".join(base.split()[:60] + other.split()[:60]), i, 45)) for i in range(30)]
    got = group_matrix.join_groups(table(spark, rows).repartition(4), cell_bits=10, block=block).collect()
    want = brute(rows)
    assert len({c for _, _, c in want}) > 10
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_needed_is_a_lower_bound_of_common_prefix_tokens(spark):
    draw = random.Random(3)
    cases = []
    for _ in range(600):
        a = draw.randint(1, 60)
        b = draw.randint(-(-8 * a // 10), 10 * a // 8)
        common = draw.randint(8 * min(a, b) // 10, min(a, b))
        if 100 * common >= 80 * (a + b - common):
            order = draw.sample(range(200), a + b - common)
            x, y = sorted(order[:a]), sorted(order[a - common :])
            px, py = x[: a - -(-80 * a // 100) + 1], y[: b - -(-80 * b // 100) + 1]
            cases.append((a, b, len(set(px) & set(py))))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "a int, b int, met int")
    assert len(cases) > 20 and df.where(F.col("met") < group_matrix.needed(F.col("a"), F.col("b"))).count() == 0


def test_keep_first(spark):
    base = prose(6, 90)
    rows = [(5, base), (3, base + " z"), (9, prose(7, 50)), (3, base + " z"), (11, prose(8, 40)), (11, prose(9, 40)), (None, base), (None, prose(10, 30)), (None, prose(10, 30)), *ODD]
    docs = table(spark, rows)
    got = group_matrix.keep_first(docs, cell_bits=10)
    assert got.columns == docs.columns
    left = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    want = [(3, base + " z"), (9, prose(7, 50)), (11, prose(8, 40)), (11, prose(9, 40)), (None, prose(10, 30)), *[o for o in ODD if o[0] != 90104]]
    assert left == sorted((str(a), b or "") for a, b in want)
    assert group_matrix.keep_first(docs.where("false"), cell_bits=10).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter_has_no_false_negatives(spark):
    import numpy as np

    ids = [0, 1, 5, -7, 2**40 + 3, 2**62]
    bits = graph.id_filter(spark.createDataFrame([(i,) for i in [*ids, None]], "x long"), "x", 12)
    assert graph.may_hold(bits, np.array(ids)).all() and not graph.may_hold(bits, np.array([2, 6, 1000])).any()


def test_id_filter_of_many_bitmaps(spark):
    import numpy as np

    ids = [0, 1, 32_767, 32_768, 65_535, 2**17 - 1, -1, 2**40 + 40_000]
    bits = graph.id_filter(spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "x long"), "x", 17)
    assert len(bits) == 2**14 and np.flatnonzero(np.unpackbits(bits)).tolist() == sorted({i % 2**17 for i in ids})
    assert graph.may_hold(bits, np.array(ids)).all() and not graph.may_hold(graph.id_filter(spark.createDataFrame([], "x long"), "x"), np.arange(100)).any()


def _jobs(spark, work):
    """The jobs and stages that ``work`` runs."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        work()
        jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    return len(jobs)


def test_steps_run_few_jobs(spark):
    """The driver keeps something of every job, stage and task."""
    links = spark.createDataFrame([(1, i) for i in range(2, 30)], "a long, b long")
    assert _jobs(spark, lambda: graph.components(links).count()) <= 20
    assert _jobs(spark, lambda: graph.id_filter(links, "b")) <= 4


def test_steps_let_the_driver_collect(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    group_matrix.linked(table(spark, [(1, prose(1, 60)), (2, prose(2, 60)), (3, prose(1, 60) + " z")]), cell_bits=10)
    assert full() - before >= 5
