"""Training-order materialisation: a keyed permutation gives every sequence a global slot.

Sequences are stored once with their place in the task that wrote them, so their dense numbers follow from one count per
task, without a second look at the payload. A Feistel network over the next even number of bits permutes the numbers;
a value outside the range walks on through the cycle until it falls inside. Slots are range-partitioned and sorted; slot s
is record ``s % per_shard`` of shard ``s // per_shard``, and every record has the same number of bytes, so a reader
that stopped after any slot seeks to the next one.

A record: the number of ids (4 bytes, little-endian), then the ids (2 bytes each, or 4 for vocabularies over 65,536),
padded with zeros.

Cases: a null or empty text is one sequence of the end token; repeated rows are stored each; an empty table gives no rows;
other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm import tokens
from cohortlab.llm.frames import flat_binary
from cohortlab.llm.words import CHUNK_BYTES, chunks, mix
from cohortlab.session import durable

SEQUENCE = 1024
PER_SHARD = 16_384
ROUNDS = 6
STORED = "part int, place long, doc_id long, piece int, length int, ids_crc32 long, ids binary"


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1, for any of its members."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        value = out[todo]
        left, right = value >> np.uint64(half), value & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def store_sequences(docs: DataFrame, size: int = SEQUENCE, path: str | None = None, end_id: int = 0, width: int = 2) -> DataFrame:
    """Token sequences of at most ``size`` ids, stored with the task that wrote them and their place in it."""
    path = path or tokens.default_path()

    def cut(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, texts in chunks(batch.column("text"), CHUNK_BYTES):
                got = tokens.encoder(path).encode(texts, end_id)
                total = np.diff(got.first)
                number = -(-total // size)
                doc = np.repeat(np.arange(len(total)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = got.first[doc] + piece * size
                wide = memoryview(got.ids.astype("<u4").tobytes())
                length = np.minimum(got.first[doc + 1] - start, size)
                crc = [zlib.crc32(wide[4 * a : 4 * (a + b)]) for a, b in zip(start.tolist(), length.tolist(), strict=True)]
                ids = flat_binary(got.ids.astype("<u2" if width == 2 else "<u4"), np.concatenate([start, got.first[-1:]]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(doc), part), pa.int32()), pa.array(place + np.arange(len(doc))),
                    batch.column("doc_id").slice(row, len(texts)).take(pa.array(doc)), pa.array(piece, pa.int32()),
                    pa.array(length, pa.int32()), pa.array(crc, pa.int64()), ids], names=[c.split(" ")[0] for c in STORED.split(", ")])
                place += len(doc)

    return durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, STORED))


def slots(number: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def permute(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, key))

    return permute(number)


def training_order(stored: DataFrame, key: int = 20_240_607, size: int = SEQUENCE, per_shard: int = PER_SHARD, width: int = 2) -> DataFrame:
    """Records in training order: ``slot, shard, offset, doc_id, piece, length, ids_crc32, record``.

    ``offset`` is the record's place in bytes inside its shard's file (see :func:`write_shards`).
    """
    parts = stored.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(parts.select("part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")))
    n = parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    numbered = stored.join(F.broadcast(parts.select("part", "base")), "part")  # one row per task that wrote
    numbered = numbered.withColumn("slot", slots(F.col("base") + F.col("place"), n, key))
    dealt = numbered.drop("part", "place", "base").repartitionByRange(max(1, -(-n // per_shard)), "slot").sortWithinPartitions("slot")
    stride = stride_bytes(size, width)
    record = F.rpad(F.concat(_little(F.col("length")), F.col("ids")), stride - 1, F.lit(b"\x00"))
    return dealt.select(
        "slot", F.floor(F.col("slot") / per_shard).alias("shard"), (F.pmod("slot", F.lit(per_shard)) * stride).alias("offset"),
        "doc_id", "piece", "length", "ids_crc32", record.alias("record"))


def _little(value: Column) -> Column:
    """Four little-endian bytes of a non-negative integer."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)])


def stride_bytes(size: int = SEQUENCE, width: int = 2) -> int:
    """Header, ids and the byte that ends a record."""
    return 4 + size * width + 1


def write_shards(ordered: DataFrame, path: str) -> None:
    """One file of fixed-stride records for each shard, under ``path/shard=N``; a newline ends each record.

    Rows of a shard are brought together by range and sorted by slot, so a shard is one task's file.
    """
    n = max(1, ordered.select("shard").distinct().count())
    rows = ordered.select("shard", "slot", F.col("record").cast("string").alias("value")).repartitionByRange(n, "shard")
    rows.sortWithinPartitions("shard", "slot").select("shard", "value").write.partitionBy("shard").option("lineSep", "\n").text(path)


def read_records(df: DataFrame, start_slot: int, per_shard: int = PER_SHARD, size: int = SEQUENCE, width: int = 2) -> DataFrame:
    """``slot, ids`` from ``start_slot`` on, out of shard files read as ``shard, content`` (Spark's binaryFile source)."""
    stride = stride_bytes(size, width)

    def cut(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i in range(max(0, start_slot - shard * per_shard), len(content) // stride):
                    row = content[i * stride : (i + 1) * stride]
                    n = int.from_bytes(row[:4], "little")
                    ids = np.frombuffer(row[4 : 4 + n * width], "<u2" if width == 2 else "<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([shard * per_shard + i]), pa.array([ids.astype(np.int64).tolist()])], names=["slot", "ids"])

    wanted = df.where(F.col("shard") >= start_slot // per_shard).select(F.col("shard").cast("long"), "content")
    return wanted.mapInArrow(cut, "slot long, ids array<long>")
