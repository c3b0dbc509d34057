"""Best-fit packing of documents into sequences of fixed capacity, in bulk-synchronous rounds.

A document longer than the capacity is cut into whole sequences and a shorter last piece; no other is cut. Pieces are
dealt by hash to shards of about ``SHARD_PIECES``, and each shard counts its pieces by length, the range-sorted form
in which equal lengths are one run. All shards sweep at once, each in its own task: in a round every remaining length
looks up its successor, the smallest gap that holds it; lengths that want the same gaps are served by rank, the longest
first; gaps are updated and the next round begins. A length without a successor opens new sequences when it is the
longest left, or longer than half the capacity. A run of gaps takes as many equal pieces each as fit, as best fit would.
The rounds end when no piece is left. A sweep returns rank intervals, and each piece finds its place by its rank among
the pieces of its length.

Cases: a null or empty text is the end token alone; repeated rows are packed each; equal lengths are ordered by their
content and id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm import tokens
from cohortlab.llm.frames import map_rows
from cohortlab.session import durable

CAPACITY = 2048
SHARD_PIECES = 200_000
PLAN = "shard long, length long, from_rank long, to_rank long, first_bin long, per_bin long, base long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``; ids are little-endian unsigned 32-bit."""
    path = path or tokens.default_path()

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        got = tokens.encoder(path).encode(batch.column("text"), end_id)
        total = np.diff(got.first)
        number = -(-total // capacity)
        row = np.repeat(np.arange(len(total)), number)
        piece = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
        start = piece * capacity
        length = np.minimum(total[row] - start, capacity)
        raw = memoryview(got.ids.astype("<u4").tobytes())
        at = 4 * (got.first[row] + start)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        return {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": start,
                "length": length, "ids_crc32": pa.array(crc, pa.int64())}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds over one shard's lengths: rows ``length, from_rank, to_rank, first_bin, per_bin, base``.

    The piece of rank r in a row goes to bin ``first_bin + (r - from_rank) // per_bin`` at offset
    ``base + (r - from_rank) % per_bin * length``.
    """
    left = {int(n): int(c) for n, c in zip(lengths, counts, strict=True) if c}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def fill(length: int, free: int, first: int, n: int) -> int:
        """Put pieces of one length into a run of n equal gaps; returns the gaps used."""
        per = free // length
        take = min(left[length], per * n)
        plan.append((length, rank[length], rank[length] + take, first, per, capacity - free))
        rank[length] += take
        left[length] -= take
        full, rest = divmod(take, per)
        for run, size, held in ((first, full, per), (first + full, 1 if rest else 0, rest)):
            if size and free > held * length:
                gaps.setdefault(free - held * length, []).append((run, size))
        return full + bool(rest)

    while left:
        order = np.array(sorted(left, reverse=True))
        sizes = np.array(sorted(gaps), dtype=np.int64)
        at = np.searchsorted(sizes, order)
        wanted: dict[int, list[int]] = {}
        opening = []
        for length, i in zip(order.tolist(), at.tolist(), strict=True):
            if i < len(sizes):
                wanted.setdefault(int(sizes[i]), []).append(length)
            elif 2 * length > capacity or length == order[0]:
                opening.append(length)
        for free, claims in wanted.items():
            runs = gaps.pop(free)
            for length in claims:
                while left[length] and runs:
                    first, n = runs.pop()
                    used = fill(length, free, first, n)
                    if used < n:
                        runs.append((first + used, n - used))
            if runs:
                gaps.setdefault(free, []).extend(runs)
        for length in opening:
            need = -(-left[length] // (capacity // length))
            fill(length, capacity, bins, need)
            bins += need
        left = {n: c for n, c in left.items() if c}
    return plan


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id, offset`` to stored pieces (``doc_id, piece, length, ids_crc32`` and others)."""
    shards = max(1, round(pieces.count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sweep(pdf["length"].to_numpy(), pdf["n"].to_numpy(), capacity)
        out = pd.DataFrame(rows, columns=["length", "from_rank", "to_rank", "first_bin", "per_bin", "base"])
        out.insert(0, "shard", pdf["shard"].iloc[0])
        return out

    runs = durable(dealt.groupBy("shard", "length").agg(F.count("*").alias("n")).groupBy("shard").applyInPandas(plan, PLAN))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "length").orderBy("ids_crc32", "doc_id", "piece")) - 1)
    place = F.col("rank") - F.col("from_rank")
    return (
        ranked.join(runs, ["shard", "length"]).where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.shiftleft("shard", 32) + F.col("first_bin") + F.floor(place / F.col("per_bin")))
        .withColumn("offset", F.col("base") + F.pmod(place, F.col("per_bin")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenise and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return best_fit(durable(token_pieces(docs, capacity, path, end_id)), capacity)
