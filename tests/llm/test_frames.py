import pyarrow as pa
from llm_support import prose, table
from pyspark.sql import functions as F

from cohortlab.llm import group_matrix, pairwise_quality
from cohortlab.llm.frames import map_rows
from cohortlab.session import BATCH_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """The buffers that a slice shares are those of its whole batch; a longer text is a batch of its own."""
    wide = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.when(F.col("id") == 7, 3_000_000).otherwise(20_000).cast("int")).alias("text"))

    def held(batch):
        return {"doc_id": batch.column("doc_id"), "size": pa.array([batch.column("text").buffers()[2].size] * batch.num_rows, pa.int64())}

    sizes = {r["doc_id"]: r["size"] for r in map_rows(wide, held, "doc_id long, size long").collect()}
    assert len(sizes) == 400 and sizes.pop(7) >= 15_000_000 and max(sizes.values()) < 3 * BATCH_BYTES
    assert sorted(sizes.values())[300] <= 1.1 * BATCH_BYTES


def test_operators_bound_batches_unless_the_session_names_a_limit(spark):
    docs = table(spark, [(i, prose(i, 60)) for i in range(4)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    try:
        for run in (lambda: pairwise_quality.keep_good(docs, labels), lambda: group_matrix.keep_first(docs)):
            spark.conf.unset(SETTING)
            run()
            assert spark.conf.get(SETTING) == str(BATCH_BYTES)
        spark.conf.set(SETTING, "3m")
        pairwise_quality.keep_good(docs, labels)
        assert spark.conf.get(SETTING) == "3m"
    finally:
        spark.conf.unset(SETTING)
