import math

from llm_support import ODD, prose, table, words_of

from cohortlab.llm import decontaminate


def runs(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, items, threshold=0.8):
    out = {}
    for item_id, text in items:
        w = words_of(text)
        if not w:
            continue
        k = min(5, len(w))
        mine = runs(w, k)
        for doc_id, t in rows:
            shared = len(mine & runs(words_of(t), k))
            if shared >= math.ceil(len(mine) * threshold):
                out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), shared)
    return out


def test_containment_equals_brute_force(spark):
    items = [(i, prose(i, 8 + 5 * i)) for i in range(8)] + [(20, "tiny item"), (21, "single"), (22, None), (23, " "), (24, "p q r s t u v w x y"), (None, prose(99, 15)), (25, "Tiny  ITEM"), (26, "a b c d")]
    rows = [(100 + i, f"{prose(200 + i, 30)} {items[i][1].upper()} {prose(300 + i, 5000 if i == 3 else 20)}") for i in range(8)]
    for cut in range(1, 8):  # items with some words lost, around the threshold
        rows.append((400 + cut, prose(5, 33)[: -9 * cut]))
        rows.append((420 + cut, " ".join(w if j % 20 != cut else "zz" for j, w in enumerate(prose(7, 43).split()))))
    rows += [(500, "so a tiny item here"), (501, "single"), (502, "p q r s t u v w"), (503, "p q r s t u v w x"), (504, prose(99, 15)), (None, prose(2, 18)), (505, "a b c d a b c d"), (500, "nothing")]
    rows += ODD
    found = decontaminate.find(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id): r.n_shared for r in found} == want and len(found) == len(want) > 12
    assert all(math.isclose(r.containment, r.n_shared / r.n_item) for r in found)

    docs = table(spark, rows)
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    dirty = {d for d, _ in want}
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in dirty)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, ODD)
    assert decontaminate.find(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == len(ODD)
    assert decontaminate.find(docs.where("false"), spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 0


def test_the_pipeline_keeps_clean_rows_that_share_an_id_with_a_leak(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, prose(600, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{prose(601, 20)} {prose(600, 20)}"
    rows = [(None, leak), (None, "clean without id"), (None, None), (7, leak), (7, "clean with a repeated id"), (8, "clean"), (8, "clean"), (9, leak)]
    docs = table(spark, rows)
    left = corpus_pipeline.leaks(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(i), str(text)) for i, text in rows if text != leak)
