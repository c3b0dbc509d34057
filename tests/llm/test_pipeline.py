import corpus_pipeline
import duckdb
import pytest
from llm_support import ODD, edited, prose, table

import __spark_entry__
from cohortlab.llm import decontaminate, group_matrix, passages

SMALL = "/root/testdata/sf0.001"


def test_registered_names():
    queries = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in queries and set(__spark_entry__.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("name", ["op9_benchmark_decontamination", "op10_url_rules", "op12_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def _write(spark, tmp_path, rows, labels, items):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))


def test_every_stage_takes_effect(spark, tmp_path):
    passage, item = prose(1, 70), prose(2, 30)
    clean = [(i, prose(100 + i, 90)) for i in range(60)]
    bad = [(200 + i, " ".join(f"w{i}{j}%%%" for j in range(70))) for i in range(30)]
    near = [(300 + i, edited(prose(3, 160), i, 250)) for i in range(5)]
    rows = clean + bad + near + [(400 + i, f"{prose(500 + i, 60)} {passage} {prose(600 + i, 60)}") for i in range(3)] + [(450, f"{prose(7, 40)} {item} {prose(8, 40)}"), *ODD]
    _write(spark, tmp_path, rows, [(i, int(i < 200), 0) for i, _ in clean + bad if i % 3], [(1, item)])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids, columns = [], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean_ids = {i for i, _ in clean}
    assert all(clean_ids <= kept for kept in ids)
    assert not ids[0] & {i for i, _ in bad} and ids[1] & {300, 301, 302, 303, 304} == {300}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sum(passage in (texts[400 + i] or "") for i in range(3)) == 1 and ids[3] == ids[2] - {450}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_empty_tables(spark, tmp_path):
    _write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_with_dots(spark):
    rows = [(i, prose(i, 70)) for i in range(6)] + [(20, f"{prose(90, 60)} {prose(1, 70)}"), (3, prose(8, 70)), (None, prose(9, 70)), (None, "")]
    docs = table(spark, rows).selectExpr("*", "1 as `a.b`", "'x' as `row.text`")
    found = passages.repeated_passages(docs)
    for kept in (group_matrix.keep_first(docs), passages.cut_passages(docs, found), decontaminate.clean(docs, docs.selectExpr("1L as item_id", "'no such words here' as text"), each_row=True)):
        assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} == {1}
