import numpy as np
import pytest
from llm_support import ODD, prose, table
from zlib import crc32

from cohortlab.llm import hilbert


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_single_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(side**dims))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_rows_law_and_slots(spark, partitions):
    rows = [(i, prose(i, 1 + i % 30), ["en", "de", "fr"][i % 3]) for i in range(200)] + [(500 + i, "copy") for i in range(90)] + [(7, "again"), (7, "again"), *ODD]
    docs = table(spark, rows).repartition(partitions)
    got = hilbert.hilbert_shards(docs).collect()
    counts = [sum(r.shard == s for r in got) for s in range(16)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    by = {r.doc_id: r for r in got}
    assert all(by[i].size == len((t or "").encode()) + 1 and by[i].text_crc32 == crc32((t or "").encode()) for i, t, *_ in rows if i != 7)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(ordered, ordered[1:], strict=False)) and {r.law for r in got} == {"rows"}


def test_ranges_prune_shards_in_every_dimension(spark):
    rows = [(i, "x" * (i % 97 + 1), ["de", "en", "es", "fr"][i // 7 % 4]) for i in range(1600)]
    docs = table(spark, rows)
    placed = hilbert.hilbert_shards(docs, dimensions=("lang", "n_chars")).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    ranges = hilbert.shard_ranges(placed, ("lang", "n_chars")).collect()
    assert len(ranges) == 16
    assert sum(r.min_lang <= "de" <= r.max_lang for r in ranges) <= 9 and sum(r.min_n_chars <= 10 <= r.max_n_chars for r in ranges) <= 9


def test_empty_table(spark):
    assert hilbert.hilbert_shards(table(spark, [])).count() == 0
