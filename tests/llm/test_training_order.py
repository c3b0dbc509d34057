import zlib

import numpy as np
from llm_support import ODD, prose, table

from cohortlab.llm import tokens, training_order


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = np.arange(n)
        got = training_order.feistel(x, n, key=5)
        assert sorted(got.tolist()) == x.tolist()
        assert got[n // 2] == training_order.feistel(x[n // 2 : n // 2 + 1], n, key=5)[0]
    assert (training_order.feistel(np.arange(1000), 1000, 5) != training_order.feistel(np.arange(1000), 1000, 6)).mean() > 0.9


def test_records_hold_all_ids_at_their_slots(spark, tmp_path):
    rows = [(i, prose(i, 5 + 37 * (i % 9))) for i in range(60)] + [(7, prose(7, 10)), (7, prose(7, 10))] + ODD
    docs = table(spark, rows).repartition(3)
    ordered = training_order.training_order(training_order.store_sequences(docs, size=64), key=3, size=64, per_shard=50)
    got = ordered.collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.shard == r.slot // 50 and r.offset == r.slot % 50 * 133 and len(r.record) == 132 for r in got)
    e = tokens.encoder(tokens.default_path())
    want = []
    for doc_id, text in rows:
        ids = [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id is None, doc_id or 0, p, zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in got) == sorted(want)

    path = str(tmp_path / "shards")
    training_order.write_shards(ordered, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("cast(regexp_extract(path, 'shard=([0-9]+)', 1) as long) shard", "content")
    assert files.count() == -(-len(got) // 50)
    for start in (0, 1, 49, 50, 77, len(got) - 1):
        read = training_order.read_records(files, start, per_shard=50, size=64).collect()
        assert sorted(r.slot for r in read) == list(range(start, len(got)))
    crc = {r.slot: r.ids_crc32 for r in got}
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == crc[r.slot] for r in training_order.read_records(files, 0, per_shard=50, size=64).collect())


def test_empty_table(spark):
    stored = training_order.store_sequences(table(spark, []))
    assert training_order.training_order(stored).count() == 0
