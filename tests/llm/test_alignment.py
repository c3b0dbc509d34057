import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import ODD, prose, table

from cohortlab.llm import alignment


def plain_tokens(text):
    """Both sides as (id, bytes), or none."""
    left, right = alignment.aligner(alignment.default_paths()).left, alignment.aligner(alignment.default_paths()).right
    if not text:
        return [], []
    alphabet = alignment.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in left.tokenizer.id_to_token(i))) for i in left.tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in right.model.encode(text):
        piece = right.model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if right.model.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(rows):
    """Brute force over all pairs of tokens."""
    docs = []
    for row in rows:
        a, b = map(spans, plain_tokens(row[1]))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            parts.append("|".join(",".join(str(t[0]) for t in side if low <= t[1] < high) for side in (a, b)))
        docs.append((row[0], len(a), len(b), len(cuts), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    count = Counter(p for d in docs for p in set(d[4]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(((d[0], *d[1:4], len(d[4]), sum(count[p] == most[p[0]] for p in d[4]), sum(count[p] for p in d[4]), d[5]) for d in docs), key=str)


MIXED = [
    "Hello world, tokenization <|endoftext|> and <s> </s> <unk> stay text", "  two  spaces\n\nand\ttabs\r\n", "naïve café — 漢字かな \U0001f600\U0001f680 ok",
    "▁ lower one eighth block", "a\x00b", "é combining ﬁ ligature", " ", "\n", "x" * 300, "don't we'll 12345 3.14159", "<0x41> <0xE2>",
]


def result(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(MIXED)] + [(100 + i, prose(i, 30)) for i in range(20)] + [(200 + i, MIXED[0]) for i in range(40)] + [(5, MIXED[2]), (5, MIXED[2]), *ODD]
    docs = table(spark, rows).repartition(3)
    want = plain(rows)
    assert result(alignment.align_documents(docs)) == want
    assert sum(r[1] == 0 for r in want) >= 3, "texts that don't spell their bytes are among the cases"
    small = alignment.align_documents(docs, chunk_pairs=50, slice_pairs=30)
    assert result(small) == want


def test_chunks_and_slices_are_used(spark):
    rows = [(i, prose(i, 25)) for i in range(30)]
    local = alignment.durable(alignment.local_alignments(table(spark, rows)).selectExpr("*", "monotonically_increasing_id() as row"))
    counts = alignment.durable(alignment.pair_counts(local))
    assert counts.count() > 60 and local.selectExpr("sum(size(codes))").first()[0] > 60
    one = {tuple(r) for r in alignment.look_up(local, counts).collect()}
    assert one == {tuple(r) for r in alignment.look_up(local, counts, 20, 10).collect()} and len(one) == 30


def test_long_text_and_empty_table(spark):
    text = (MIXED[2] + " " + prose(4, 50) + "\n") * 400
    got = alignment.align_documents(table(spark, [(1, text), (2, "short one")])).where("doc_id = 1").first()
    tokens = plain_tokens(text)
    assert (got.n_a, got.n_b) == (len(tokens[0]), len(tokens[1])) and got.n_links >= max(got.n_a, got.n_b) and len(got.groups_sha256) == 64
    assert alignment.align_documents(table(spark, [])).count() == 0
    assert result(alignment.align_documents(table(spark, [(None, None), (None, "")]))) == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.integers(0, 10**6)), min_size=1, max_size=4))
def test_coalescing_equals_plain_cuts(docs):
    """Groups break exactly where both sides end, for any cuts of the same bytes."""
    sides, at = [[], []], 0
    cuts_wanted = 0
    for sizes, seed in docs:
        total = sum(sizes)
        draw = np.random.default_rng(seed)
        other = np.diff([0, *sorted(set(draw.integers(1, total + 1, 6).tolist()) | {total})]).tolist()
        cuts_wanted += len(set(np.cumsum(sizes).tolist()) & set(np.cumsum(other).tolist()))
        for side, parts in zip(sides, (sizes, other), strict=True):
            ends = at + np.cumsum(parts)
            side += [(int(e - p), int(e)) for p, e in zip(parts, ends, strict=True)]
        at += total
    a, b = (alignment.Side(np.arange(len(s)), np.array([x[0] for x in s]), np.array([x[1] for x in s]), np.zeros(1, int)) for s in sides)
    group_a, group_b, groups = alignment.coalesce(a, b)
    assert groups == cuts_wanted
    got = set(zip(*(x.tolist() for x in alignment.overlaps(a, b, group_a, group_b, groups)), strict=True))
    assert got == {(i, j) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if x[0] < y[1] and y[0] < x[1]}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "The", "don't", "é", "漢", "▁", "\u00a0", "\u3000", "\u2003", "\u0301", "1", "23", ".", "--", "\x1c", "\U0001f600", "ǆ", "ﬁ", "ß", "<s>", "<|endoftext|>"]), max_size=14))
def test_pieces_encode_as_the_whole_text(parts):
    text = "".join(parts)
    both = alignment.aligner(alignment.default_paths())
    pieces = alignment.CUT.split(" " + text)
    assert [i for ids in both.left.encode(pieces) for i in ids] == both.left.tokenizer.encode(" " + text, add_special_tokens=False).ids
    assert [i for ids in both.right.encode([p[1:] for p in pieces]) for i in ids] == both.right.model.encode(text) or text == ""


def test_no_entry_goes_over_a_cut_and_a_full_store_is_emptied():
    both = alignment.aligner(alignment.default_paths())
    model = both.right.model
    assert not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    texts = alignment.pa.array([prose(i, 20) for i in range(10)] + MIXED)
    small = alignment.Aligner(alignment.default_paths(), limit=50)
    for _ in range(2):
        want, got = both.align(texts), small.align(texts)
        assert all(alignment.pa.array(want[k]).equals(alignment.pa.array(got[k])) for k in want)
