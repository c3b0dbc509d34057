import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, block int, shard string, place string, k1 string, depth int, size string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "p", "k", 2, "z") for r in rows], SCHEMA)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def plain(convs):
    """Brute force over all prefixes."""
    members = defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(set)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].add(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[c] for c in below) if below else 1
        own = (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        saved[prefix] = own + sum(saved[c] for c in below)
    out = []
    for prefix, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(held), len(prefix), parent, len(held), len(children[prefix]), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def some_rows(seed, convs=60):
    draw = random.Random(seed)
    rows = []
    scripts = [[draw.choice("abcd") * draw.randint(0, 3) for _ in range(30)] for _ in range(4)]
    for conv in range(convs):
        script = draw.choice(scripts)
        n = draw.choice([1, 2, 3, 6, 9, 14, 25])
        for turn in range(n):
            text = script[turn] if draw.random() < 0.93 else f"é{draw.randrange(9)}"
            rows.append((conv, turn, draw.choice(["user", "user", "bot"]) if turn > 8 else "user", text))
    return rows


@pytest.mark.parametrize(("width", "shard_rows"), [(64, 20_000), (4, 7), (2, 1), (8, 30)])
def test_rebuilt_conversations_equal_brute_force(spark, width, shard_rows):
    rows = some_rows(width)
    rows += [(200 + i, t, "user", "copy") for i in range(0, 50, 2) for t in range(12)] + [(400, t, None, None) for t in range(40)] + [(401, None, "user", "first"), (401, 3, "bot", None)]
    rows += [(None, 1, "user", "of nobody"), (500, 1, "user", "twice"), (500, 1, "user", "twice"), (10**12 + 5, 0, "user", "far"), (7001, 0, "user", "gone")]
    convs, turns = trie.head_swap(talk(spark, rows).repartition(5))
    assert result(trie.trie_nodes(convs, turns, width, shard_rows)) == plain(rebuilt(rows))


def test_one_conversation_and_one_group_hold_most_rows(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)] + [(10, t, "user", f"t{t % 7}") for t in range(650)]
    rows += [(20 + i, t, "user", "same") for i in range(300) for t in range(2)]
    convs, turns = trie.plain_turns(talk(spark, rows).repartition(6))
    assert result(trie.trie_nodes(convs, turns, 8, 40)) == plain({c: [(r[2], r[3]) for r in rows if r[0] == c] for c in {r[0] for r in rows}})


def test_turnless_root_and_empty_table(spark):
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "its only turn is replaced by none")]
    assert result(trie.trie_nodes(*trie.head_swap(talk(spark, rows)))) == plain(rebuilt(rows)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert result(trie.trie_nodes(*trie.head_swap(talk(spark, [])))) == []
    assert result(trie.trie_nodes(*trie.head_swap(talk(spark, [(None, None, None, None)])))) == []


def test_carried_sums_go_over_chunks(spark):
    rows = [(c, b, (c + 3) * (b + 1)) for c in range(3) for b in range(150)]
    blocks = spark.createDataFrame(rows, "conv_id long, block long, x long")
    for after in (False, True):
        got = {(r.conv_id, r.block): r.x for r in trie.carried(blocks, "x", F.sum, lambda a, b: a + b, after).collect()}
        assert got == {(c, b): sum(x for k, d, x in rows if k == c and (d > b if after else d < b)) for c, b, _ in rows}


def test_numbering_goes_on_over_batches(spark):
    rows = [(1 if i < 900 else i, i, "u", str(i)) for i in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        numbered, bases = trie.ordered_turns(trie.hashed_turns(talk(spark, rows).repartition(9)))
        got = numbered.join(bases, ["conv_id", "part"]).selectExpr("conv_id", "base + local as place", "n_own").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.place for r in got if r.conv_id == 1) == list(range(900)) and all(r.place == 0 and r.n_own == 1 for r in got if r.conv_id != 1)


def test_marks_of_one_shard():
    rows = pa.table({
        "shard": pa.array([0] * 3, pa.int32()), "side": [1, 1, 0], "block": [0] * 3, "p1": [0] * 3, "p2": [0] * 3, "goes_on": [False] * 3, "conv_id": [3, 2, 1],
        "z1": [[5, 6], [5], [5]], "z2": [[1, 1], [1], [1]], "size": [[10, 20], [10], [10]]})
    got = trie.mark_starts(rows).to_pydict()
    assert got["conv_id"] == [2, 3] and got["fresh"] == [[False], [False, True]] and got["leaf"] == [0, 1] and got["unowned"] == [10, 10]
    assert np.array_equal(trie._valid(rows.column("z1")), [[True, True], [True, False], [True, False]])
