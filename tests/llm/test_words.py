import tracemalloc

import numpy as np
import pyarrow as pa

from cohortlab.llm import tokens, words
from llm_support import prose, words_of

TEXTS = ["", None, "a", "  Ab\tab\nAB \x0b\x0c", "été x" * 3, "w " * 5000, prose(1, 400), "it's 12,5 don't!! <|endoftext|> é", "\x01 a\x01b", "ΑΣ İ ﬁ", "a.b c-d 'tis ''s x≠y 1≠"]


def test_words_match_a_regular_expression():
    found = words.split(pa.array(TEXTS), lower=True)
    assert np.diff(found.first).tolist() == [len(words_of(t)) for t in TEXTS]
    flat = [w for t in TEXTS for w in words_of(t)]
    by_hash = dict(zip(found.hashes.tolist(), flat, strict=True))
    assert len(by_hash) == len(set(flat)) and [by_hash[h] for h in found.hashes.tolist()] == flat


def test_words_do_not_depend_on_slices_or_segments(monkeypatch):
    whole = words.split(pa.array(TEXTS)).hashes
    parts = [words.split(part).hashes for _, part in words.chunks(pa.array(TEXTS), 50)]
    assert np.concatenate(parts).tolist() == whole.tolist()
    assert words.split(pa.array(["zz", *TEXTS, "zz"]).slice(1, len(TEXTS))).hashes.tolist() == whole.tolist()
    monkeypatch.setattr(words, "CHUNK_BYTES", 64)
    assert words.split(pa.array(TEXTS)).hashes.tolist() == whole.tolist()
    long = "x" * 3_000_000 + " y"
    assert len(words.split(pa.array([long])).hashes) == 2


def test_shingles():
    h = words.split(pa.array(["a b c d e f", "a b c", "b c d e f", ""])).hashes
    assert len(words.shingle_set(h[:6], 5)) == 2
    assert words.shingle_set(h[9:14], 5)[0] in words.shingle_set(h[:6], 5)
    assert len(words.shingle_set(h[6:9], 5)) == 1 and len(words.shingle_set(h[:0], 5)) == 0
    assert words.shingle_set(np.tile(h[:1], 50), 5).size == 1


def test_ids_equal_the_tokenizer_and_survive_a_full_cache():
    e = tokens.Encoder(tokens.default_path(), limit=40)
    texts = pa.array([*TEXTS, prose(2, 300), prose(3, 30)])
    for _ in range(2):
        got = e.encode(texts, end_id=0)
        for i, t in enumerate(texts.to_pylist()):
            want = e.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert got.ids[got.first[i] : got.first[i + 1]].tolist() == [*want, 0]
        assert e.lengths(texts).tolist() == (np.diff(got.first) - 1).tolist()
    assert e.encode(pa.array([], pa.string()), 0).ids.size == 0


def test_memory_of_short_texts_follows_the_slice():
    texts = pa.array([prose(i, 500) for i in range(800)])
    tracemalloc.start()
    try:
        for _, part in words.chunks(texts):
            words.long_windows(words.split(part, lower=True).hashes, 41)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10_000_000
