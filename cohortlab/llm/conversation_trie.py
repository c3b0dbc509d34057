"""Prefix trie of conversations, aggregated over padded turn-id matrices.

Turns are ordered within a conversation by ``turn``, nulls first; ties by the hash of role and text. A turn is known by hashes
of its depth, role and text, and a prefix by the exclusive-or of its turns' hashes (128 bits). Conversations are cut into blocks of
``WIDTH`` turns, each with the key of the prefix before it, so that a long one is many rows of bounded size. The
blocks are sorted by depth, prefix, turns and id into range shards of about ``SHARD_ROWS``.

*Marks*: a shard's blocks form a matrix of turn ids, padded at the right; numpy lexsorts it, compares each row with the one before and
OR-accumulates the differences along the columns: where the mask is set, a node starts. The last row of the
shard before and the first of the one after take part, so every node starts in just one row of all shards. That
row owns the node, and the last conversation that ends at a leaf owns the leaf.
*Sums*: with owners, all that a node needs is a sum over its members: the saved tokens of its subtree are the bytes of its members' turns from
its depth on that they don't own, its leaves the owned leaves, its children the owned turns one deeper. ``reduceat`` sums each column
between node starts. A long conversation's sums after a block are carried to it by windows of two levels.
*Boundaries*: only nodes that touch a shard's first or last row can have parts in several shards; these are added up by key.

A conversation with a third of all turns is split when turns are numbered (ranges with offsets) and then block by block; a third of all
conversations being copies is split by id among shards. Ids that end at one node are joined to texts inside ranges, and these texts are
hashed in order by a stream: SHA-256 of one string can't be split, so a node's last step is one task of bounded memory.

Cases: null roles and texts are empty; rows without ``conv_id`` belong to no conversation and are left out; repeated rows are
repeated turns; equal conversations share all nodes; a conversation without turns after a rebuild is a member of
the root alone, which is a leaf if there is no other node; a very long text is only hashed and measured; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import durable

WIDTH = 64
SHARD_ROWS = 20_000
CHUNK_BLOCKS = 64
TEXT_IDS = 10_000
KEY = ["depth", "k1", "k2"]
ORDER = ["block", "p1", "p2", "z1", "goes_on", "conv_id"]
Batches = Iterator[pa.RecordBatch]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, t1, t2, size`` of every turn: two hashes of role and text, and the text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), role, text).alias("t2"), F.octet_length(text).cast("long").alias("size"))


def _number(batches: Batches) -> Batches:
    """Place of each row among those of its conversation in one sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.flatnonzero(new)
        local = np.arange(len(conv)) - np.repeat(start, np.diff(np.concatenate([start, [len(conv)]])))
        if len(conv) and conv[0] == last:
            local[: start[1] if len(start) > 1 else len(conv)] += seen
        if len(conv):
            last, seen = conv[-1], int(local[-1]) + 1
        columns = [pa.array(np.full(len(conv), part, np.int32)), pa.array(local, pa.int64())] + [batch.column(c) for c in ("conv_id", "t1", "t2", "size")]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "local", "conv_id", "t1", "t2", "size"])


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with ``part`` and place in it, and ``conv_id, part, base, n_own``: the turns before a part, and all of a conversation."""
    keys = ["conv_id", "turn", "t1", "t2", "spread"]
    dealt = turns.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = durable(dealt.mapInArrow(_number, "part int, local long, conv_id long, t1 long, t2 long, size long"))
    of_conv = Window.partitionBy("conv_id")
    before = of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    bases = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(of_conv).alias("n_own"))
    return numbered, durable(bases)


def head_swap(conversations: DataFrame, step: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: ``conv_id, n_turns`` of each, and ``conv_id, place, n_turns, t1, t2, size`` of each turn.

    With ``h = crc32(conv_id) mod most``, the first ``h`` turns of conversation ``conv_id - conv_id mod step`` come before the own
    turns after the first ``h``.
    """
    numbered, bases = ordered_turns(hashed_turns(conversations))
    own = bases.where("base = 0").select("conv_id", "n_own")
    plan = own.withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).withColumn("from_id", F.col("conv_id") - F.col("conv_id") % step)
    givers = own.select(F.col("conv_id").alias("from_id"), F.col("n_own").alias("n_from"))
    plan = plan.join(givers, "from_id", "left").withColumn("taken", F.least("h", F.coalesce("n_from", F.lit(0))))
    plan = durable(plan.select("conv_id", "from_id", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")))
    places = bases.select("conv_id", "part", "base").join(plan, "conv_id")
    placed = numbered.join(places, ["conv_id", "part"]).withColumn("at", F.col("base") + F.col("local"))
    kept = placed.where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("place"), "n_turns", "t1", "t2", "size")
    first = numbered.where(F.col("local") < most).join(bases, ["conv_id", "part"]).withColumn("at", F.col("base") + F.col("local")).where(F.col("at") < most - 1)
    first = first.select(F.col("conv_id").alias("from_id"), "at", "t1", "t2", "size")
    heads = plan.where("taken > 0").join(first, "from_id").where("at < taken").select("conv_id", F.col("at").alias("place"), "n_turns", "t1", "t2", "size")
    return plan.select("conv_id", "n_turns"), kept.unionByName(heads)


def plain_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`head_swap`, of the conversations as they are."""
    numbered, bases = ordered_turns(hashed_turns(conversations))
    turns = numbered.join(bases, ["conv_id", "part"]).select("conv_id", (F.col("base") + F.col("local")).alias("place"), F.col("n_own").alias("n_turns"), "t1", "t2", "size")
    return bases.where("base = 0").select("conv_id", F.col("n_own").alias("n_turns")), turns


def carried(blocks: DataFrame, column: str, total: Callable[[Column], Column], join: Callable[[Column, Column], Column], after: bool) -> DataFrame:
    """``conv_id, block, column`` summed over a conversation's blocks before (or ``after``) each: by chunks of blocks, then inside a chunk."""
    rows = blocks.select("conv_id", "block", F.expr(f"block div {CHUNK_BLOCKS}").alias("chunk"), column)
    way = (lambda c: F.col(c).desc()) if after else F.col
    rest = lambda w, c: w.orderBy(way(c)).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    chunks = rows.groupBy("conv_id", "chunk").agg(total(F.col(column)).alias("whole"))
    chunks = chunks.select("conv_id", "chunk", F.coalesce(total(F.col("whole")).over(rest(Window.partitionBy("conv_id"), "chunk")), none).alias("far"))
    near = F.coalesce(total(F.col(column)).over(rest(Window.partitionBy("conv_id", "chunk"), "block")), none)
    return rows.withColumn("near", near).join(chunks, ["conv_id", "chunk"]).select("conv_id", "block", join(F.col("near"), F.col("far")).alias(column))


def turn_blocks(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """``conv_id, block, goes_on, p1, p2, z1, z2, size, x1, x2``: turn hashes and bytes of a block, the prefix key before it and its own."""
    hashed = turns.select(
        "conv_id", "place", "n_turns", F.expr(f"place div {width}").alias("block"), F.xxhash64("place", "t1", "t2").alias("z1"), F.xxhash64(F.lit(1), "place", "t1", "t2").alias("z2"), "size")
    row = F.array_sort(F.collect_list(F.struct("place", "z1", "z2", "size")))
    blocks = hashed.groupBy("conv_id", "block").agg(row.alias("row"), F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.max("n_turns").alias("n_turns"))
    blocks = durable(blocks.select(
        "conv_id", "block", ((F.col("block") + 1) * width < F.col("n_turns")).alias("goes_on"), F.col("row.z1").alias("z1"), F.col("row.z2").alias("z2"),
        F.col("row.size").alias("size"), "x1", "x2"))
    long = blocks.join(blocks.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    xor = lambda a, b: a.bitwiseXOR(b)
    before = [carried(long, x, F.bit_xor, xor, False).withColumnRenamed(x, p) for x, p in (("x1", "p1"), ("x2", "p2"))]
    keys = before[0].join(before[1], ["conv_id", "block"]).where("block > 0")
    none = F.lit(0).cast("long")
    return blocks.join(keys, ["conv_id", "block"], "left").withColumn("p1", F.coalesce("p1", none)).withColumn("p2", F.coalesce("p2", none))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _padded(flat: np.ndarray, valid: np.ndarray) -> np.ndarray:
    out = np.zeros(valid.shape, flat.dtype)
    out[valid] = flat
    return out


def _valid(column: pa.ChunkedArray) -> np.ndarray:
    """Mask of the real cells of a padded matrix, a row per list."""
    n = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return np.arange(int(n.max(initial=0))) < n[:, None]


def _numbers(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


MARKED = "shard int, place long, conv_id long, block long, goes_on boolean, p1 long, p2 long, z1 array<long>, z2 array<long>, size array<long>, fresh array<boolean>, leaf long, unowned long"


def mark_starts(table: pa.Table) -> pa.Table:
    """Mark node starts and owned leaves in one shard; rows of side 0 and 2 are its neighbours in the order of all shards."""
    side, block, p1, p2, goes_on, conv = _numbers(table, ["side", "block", "p1", "p2", "goes_on", "conv_id"])
    valid = _valid(table.column("z1"))
    ids = _flat(table.column("z1"))
    matrix = _padded(np.unique(ids, return_inverse=True)[1] + 1, valid)
    order = np.lexsort((conv, goes_on, *matrix.T[::-1], p2, p1, block))
    matrix, valid = matrix[order], valid[order]
    head = np.stack([block, p1, p2])[:, order]
    change = np.ones(matrix.shape, bool)
    other = (head[:, 1:] != head[:, :-1]).any(axis=0)
    change[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1) | other[:, None]
    length = valid.sum(axis=1)
    last = np.ones(len(order), bool)
    last[:-1] = change[np.arange(1, len(order)), length[:-1] - 1]
    own = side[order] == 1
    fresh = (change & valid)[own]
    sizes = _padded(_flat(table.column("size")), _valid(table.column("size")))[order][own]
    offsets = pa.array(np.concatenate([[0], np.cumsum(length[own])]).astype(np.int32))
    rows = table.take(pa.array(order[own]))
    return pa.table({
        "shard": rows.column("shard"), "place": np.arange(int(own.sum())), "conv_id": rows.column("conv_id"), "block": rows.column("block"), "goes_on": rows.column("goes_on"),
        "p1": rows.column("p1"), "p2": rows.column("p2"), "z1": rows.column("z1"), "z2": rows.column("z2"), "size": rows.column("size"),
        "fresh": pa.ListArray.from_arrays(offsets, pa.array(fresh[valid[own]])), "leaf": (last & ~goes_on[order])[own].astype(np.int64),
        "unowned": (sizes * ~fresh).sum(axis=1).astype(np.int64),
    })


def marked_blocks(blocks: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``MARKED`` columns of all blocks, in range shards."""
    stored = durable(blocks.select("conv_id", "block", "goes_on", "p1", "p2", "z1", "z2", "size"))
    shards = max(1, -(-stored.count() // shard_rows))
    dealt = durable(stored.repartitionByRange(shards, *ORDER).withColumn("shard", F.spark_partition_id()))
    row = F.struct(*ORDER, "z2", "size")
    edges = dealt.groupBy("shard").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    line = Window.orderBy("shard")
    edges = edges.select("shard", F.lag("high").over(line).alias("r0"), F.lead("low").over(line).alias("r2"))
    near = [edges.where(f"r{s} is not null").select("shard", F.lit(s).alias("side"), f"r{s}.*") for s in (0, 2)]
    rows = dealt.withColumn("side", F.lit(1)).unionByName(near[0]).unionByName(near[1])
    return rows.groupBy("shard").applyInArrow(mark_starts, MARKED)


PARTS = "depth long, k1 long, k2 long, q1 long, q2 long, edge boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def sum_nodes(width: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of one shard's rows between node starts, depth by depth."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        conv, block, goes_on, p1, p2, after, leaf, child = _numbers(table, ["conv_id", "block", "goes_on", "p1", "p2", "after", "leaf", "child"])
        valid = _valid(table.column("z1"))
        fresh = _padded(_flat(table.column("fresh")).astype(bool), valid)
        size = _padded(_flat(table.column("size")), valid) * ~fresh
        saved = np.cumsum(size[:, ::-1], axis=1)[:, ::-1] + after[:, None]
        keys = [np.bitwise_xor.accumulate(np.concatenate([p[:, None], _padded(_flat(table.column(z)), valid)], axis=1), axis=1) for p, z in ((p1, "z1"), (p2, "z2"))]
        deeper = np.zeros(valid.shape, np.int64)
        deeper[:, :-1] = fresh[:, 1:]
        if valid.shape[1] == width:
            deeper[:, -1] = np.where(goes_on, child, 0)
        out = []
        for j in range(valid.shape[1]):
            rows = np.flatnonzero(valid[:, j])
            start = fresh[rows, j].copy()
            start[0] = True
            at = np.flatnonzero(start)
            first = rows[at]
            last = rows[np.concatenate([at[1:], [len(rows)]]) - 1]
            out.append([
                block[first] * width + j + 1, keys[0][first, j + 1], keys[1][first, j + 1], keys[0][first, j], keys[1][first, j], (first == 0) | (last == len(conv) - 1),
                np.minimum.reduceat(conv[rows], at), np.diff(np.concatenate([at, [len(rows)]])), np.add.reduceat(deeper[rows, j], at),
                np.add.reduceat(leaf[rows], at), np.add.reduceat(saved[rows, j], at)])
        names = [part.strip().split(" ")[0] for part in PARTS.split(",")]
        return pa.table([np.concatenate([x[i] for x in out]) for i in range(len(names))], names=names)

    return run


def _joined_ids(batches: Batches) -> Batches:
    """Ids of one sorted partition that end at the same node, as comma-joined texts of at most ``TEXT_IDS`` ids."""
    for batch in batches:
        keys = np.stack(_numbers(pa.Table.from_batches([batch]), KEY))
        conv = batch.column("conv_id").to_pylist()
        new = np.ones(len(conv), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        new[::TEXT_IDS] = True
        at = np.flatnonzero(new)
        stop = np.concatenate([at[1:], [len(conv)]]).astype(int)
        texts = [",".join(map(str, conv[s:e])) for s, e in zip(at.tolist(), stop.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array([conv[s] for s in at.tolist()], pa.int64()), pa.array(texts, pa.string())], names=[*KEY, "first_id", "ids"])


def _hashed_ids(batches: Batches) -> Batches:
    """Hash of the texts of each node, which follow one another in a sorted partition."""
    held, digest = None, None
    for batch in batches:
        rows = []
        keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
        for key, ids in zip(keys, batch.column("ids").to_pylist(), strict=True):
            if key != held:
                if held is not None:
                    rows.append((*held, digest.hexdigest()))
                held, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digests(rows)
    if held is not None:
        yield _digests([(*held, digest.hexdigest())])


def _digests(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*KEY, "ends_sha256"])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``KEY, ends_sha256`` of the nodes where conversations end, of ``KEY, conv_id`` rows."""
    order = [*KEY, "conv_id"]
    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, k1 long, k2 long, first_id long, ids string")
    line = texts.repartition(*KEY).sortWithinPartitions(*KEY, "first_id")
    return line.mapInArrow(_hashed_ids, "depth long, k1 long, k2 long, ends_sha256 string")


def trie_nodes(convs: DataFrame, turns: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``convs`` holds ``conv_id, n_turns``, ``turns`` holds ``conv_id, place, n_turns, t1, t2, size``.
    """
    blocks = durable(turn_blocks(turns, width))
    marked = durable(marked_blocks(blocks, shard_rows))
    long = marked.join(marked.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    after = carried(long, "unowned", F.sum, lambda a, b: a + b, True).withColumnRenamed("unowned", "after")
    child = long.where("block > 0").select("conv_id", (F.col("block") - 1).alias("block"), F.get("fresh", F.lit(0)).cast("long").alias("child"))
    leaves = long.where("not goes_on").select("conv_id", F.col("leaf").alias("far_leaf"))
    none = F.lit(0).cast("long")
    carry = after.join(child, ["conv_id", "block"], "left").join(leaves, "conv_id")
    full = marked.join(carry, ["conv_id", "block"], "left").select(
        "shard", "place", "conv_id", "block", "goes_on", "p1", "p2", "z1", "z2", "size", "fresh",
        F.coalesce("far_leaf", "leaf").alias("leaf"), F.coalesce("after", none).alias("after"), F.coalesce("child", none).alias("child"))
    parts = durable(full.groupBy("shard").applyInArrow(sum_nodes(width), PARTS))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edge = parts.where("edge").groupBy(*KEY, "q1", "q2").agg(F.min("conv_id").alias("conv_id"), *sums)
    nodes = durable(parts.where("not edge").drop("edge").unionByName(edge))
    ends = convs.where("n_turns = 0").select(none.alias("depth"), none.alias("k1"), none.alias("k2"), "conv_id").unionByName(
        convs.join(blocks.where("not goes_on"), "conv_id").select(
            F.col("n_turns").alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("k2"), "conv_id"))
    hashes = durable(hashed_ends(ends.select(*KEY, "conv_id")))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    under = nodes.where("depth = 1").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    empty = hashlib.sha256(b"").hexdigest()
    spark = convs.sparkSession
    root = spark.createDataFrame(
        [(top["conv_id"], 0, None, 0, 0, top["n_convs"], under["n"], under["leaves"] or 1, under["saved"] or 0)] if top["n_convs"] else [],
        "conv_id long, depth long, parent_conv_id long, k1 long, k2 long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, ["depth", "q1", "q2"])
    shallow = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(top["conv_id"]).cast("long"))
    every = deep.drop("q1", "q2").unionByName(shallow.drop("q1", "q2")).unionByName(root)
    return every.join(hashes, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
