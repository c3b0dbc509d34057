import random
import zlib

import numpy as np
import pyarrow as pa
from llm_support import ODD, prose, table

from cohortlab.llm import packing, tokens


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_sweep_places_every_rank_once_and_packs_like_best_fit():
    draw = random.Random(5)
    for case in range(30):
        capacity = 100
        top = [100, 60, 30, 12][case % 4]
        lengths = [draw.randint(1, top) for _ in range(draw.randint(1, 400))]
        sizes, counts = np.unique(lengths, return_counts=True)
        held, seen = {}, []
        for n, low, high, first, per, base in packing.sweep(sizes, counts, capacity):
            for r in range(low, high):
                seen.append((n, r))
                held.setdefault(first + (r - low) // per, []).append((base + (r - low) % per * n, n))
        assert sorted(seen) == sorted((int(n), r) for n, c in zip(sizes, counts, strict=True) for r in range(c))
        for places in held.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(held) <= plain_best_fit(lengths, capacity) * 1.03 + 1


def test_packs_whole_documents(spark):
    rows = [(i, prose(i, 1 + i * 7 % 300)) for i in range(150)] + [(900, prose(900, 4000)), (901, "hot"), *[(910 + i, "hot") for i in range(60)], (3, prose(3, 22)), *ODD]
    got = packing.pack_documents(table(spark, rows), capacity=512).collect()
    e = tokens.encoder(tokens.default_path())
    want = []
    for doc_id, text in rows:
        ids = [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(str(doc_id), p, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    assert len(held) <= plain_best_fit([w[3] for w in want], 512) + 1


def test_shards_keep_sequences_apart_and_empty_table(spark):
    pieces = packing.token_pieces(table(spark, [(i, prose(i, 30)) for i in range(80)]))
    got = packing.best_fit(pieces, shard_pieces=20).collect()
    assert len(got) == 80 and len({(r.sequence_id, r.offset) for r in got}) == 80
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_a_worker_holds_a_small_table_of_pieces():
    """Workers outlive their stage, so the table stays in memory while other stages run."""
    held = tokens.Encoder(tokens.default_path())
    assert held.keys.nbytes + held.place.nbytes + held.count.nbytes <= 20_000_000


def test_an_emptied_table_changes_no_ids():
    texts = pa.array([prose(i, 300) for i in range(40)])
    whole, small = tokens.Encoder(tokens.default_path()), tokens.Encoder(tokens.default_path(), 400)
    for i in range(0, 40, 4):
        assert whole.encode(texts.slice(i, 4)).ids.tolist() == small.encode(texts.slice(i, 4)).ids.tolist()
