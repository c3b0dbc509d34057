"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing, with corpus-wide counts of linked ids.

New pieces of a batch are encoded by both tokenizers, and every token is an interval of bytes. The tokens of both sides are
lexsorted by start, ``maximum.accumulate`` gives the running end, and a group breaks where a start reaches the running
maximum: there tokens of both sides end. Within groups the overlapping pairs are expanded from sorted places. All
pieces lie end to end, so that one pass serves them all; a piece's end breaks its last group.

A text is cut before each single space that stands between other characters than white space. Neither vocabulary has an entry that
goes over such a place, so both sides end there: tokens and groups of a text are those of its pieces in a row. A worker
aligns a distinct piece once while its store, bounded in characters, holds it.

A document's distinct linked id pairs are stored once, as sorted codes with their numbers of links. A code's count is the
number of documents that hold it: a partial aggregate over the stored codes. The counts, sorted by code, are cut into chunks of
``CHUNK_PAIRS``. A task gets one chunk and a slice of the documents' codes and looks them up by binary search, so
neither a hot pair nor a hot token gathers rows anywhere, and a worker holds one chunk and one batch. A document has a
row per chunk that holds a code of it, and these are summed.

Cases: a null or empty text, or one whose tokens don't spell the bytes of space + text, has no tokens: zeros and an empty hash;
repeated rows and ids are documents of their own; a null id is returned as null; ties for the highest count are all best;
a very long text is one row of its own batch, split by the tokenizers alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm import words
from cohortlab.llm.frames import map_rows
from cohortlab.session import durable

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
B_BITS = 20
CHUNK_PAIRS = 4_000_000
SLICE_PAIRS = 2_000_000
CACHE_CHARS = 8_000_000
#: Before one space between two characters that are neither white space nor the space's stand-in U+2581.
CUT = re.compile(r"(?<=[^\s\u2581])(?= [^\s\u2581])")
LOCAL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, links array<int>"
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Spelling:
    """The bytes of each id of a vocabulary, in one pool."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and the end of each id in them."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - (ends - size), size) + np.arange(int(size.sum()))
        return self.pool[at], ends


class ByteLevel:
    """Byte-level vocabulary: characters of an entry stand for bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spelling = Spelling([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries])

    def __reduce__(self) -> tuple[type, tuple[str]]:
        """A copy in another process reads its file again: the library's own copies forget how special tokens are treated."""
        return ByteLevel, (self.path,)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Piece vocabulary: U+2581 stands for a space, byte pieces for one byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            entries.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.spelling = Spelling(entries)

    def __reduce__(self) -> tuple[type, tuple[str]]:
        return Pieces, (self.path,)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Side:
    """One side's tokens of a batch, end to end: ids, byte spans, and the place of each document's first token."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def _side(per_doc: list[list[int]], spelling: Spelling, good: np.ndarray) -> Side:
    used = [x if g else [] for x, g in zip(per_doc, good.tolist(), strict=True)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in used])]).astype(np.int64)
    ids = np.fromiter((i for x in used for i in x), np.int64, int(first[-1]))
    ends = np.cumsum(spelling.length[ids])
    return Side(ids, ends - spelling.length[ids], ends, first)


def _spelled(per_doc: list[list[int]], spelling: Spelling, wanted: list[bytes]) -> np.ndarray:
    """Whether each document's ids spell its wanted bytes."""
    counts = np.array([len(x) for x in per_doc], np.int64)
    data, ends = spelling.spell(np.fromiter((i for x in per_doc for i in x), np.int64, int(counts.sum())))
    stop = np.concatenate([[0], ends])[np.cumsum(counts)] if len(counts) else counts
    raw = data.tobytes()
    begin = np.concatenate([[0], stop[:-1]]) if len(counts) else counts
    return np.array([w != b" " and raw[s:e] == w for w, s, e in zip(wanted, begin.tolist(), stop.tolist(), strict=True)], bool)


def coalesce(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each A and each B token, and the number of groups."""
    starts, ends = np.concatenate([a.starts, b.starts]), np.concatenate([a.ends, b.ends])
    order = np.lexsort((ends, starts))
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a.ids)], group[len(a.ids) :], int(breaks.sum())


def overlaps(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all overlapping A and B tokens; both lie in one group."""
    low = np.searchsorted(b.ends, a.starts, "right")
    high = np.searchsorted(b.starts, a.ends, "left")
    first_b = np.searchsorted(group_b, np.arange(groups + 1))
    low, high = np.maximum(low, first_b[group_a]), np.minimum(high, first_b[group_a + 1])
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(a.ids)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def group_text(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, written: np.ndarray) -> np.ndarray:
    """The ids as text, both sides group by group, each followed by its separator: the last of a group by ``;``."""
    out = np.empty(len(a.ids) + len(b.ids), object)
    for ids, group, other, mark, side in ((a.ids, group_a, group_b, 1, "left"), (b.ids, group_b, group_a, 2, "right")):
        last = np.ones(len(ids), bool)
        last[:-1] = group[1:] != group[:-1]
        out[np.arange(len(ids)) + np.searchsorted(other, group, side)] = written[np.where(last, mark, 0), ids]
    return out


class Aligner:
    """Alignments of distinct pieces, kept while they are at most ``limit`` characters; a full store is emptied, which changes no result."""

    def __init__(self, paths: tuple[str, str], limit: int = CACHE_CHARS):
        self.paths, self.limit = paths, limit
        self.left, self.right = ByteLevel(paths[0]), Pieces(paths[1])
        size = max(len(self.left.spelling.length), len(self.right.spelling.length))
        self.written = np.array([[f"{i}{mark}" for i in range(size)] for mark in ",|;"], object)
        self.clear()

    def __reduce__(self) -> tuple[type, tuple[tuple[str, str], int]]:
        return Aligner, (self.paths, self.limit)

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.text = np.zeros(0, object)
        self.numbers = np.zeros((5, 0), np.int64)  # A ids, B ids, groups, links, whether the ids spell the piece
        self.first = np.zeros(1, np.int64)
        self.codes = np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Align new pieces, all end to end, and keep them."""
        ids_a, ids_b = self.left.encode(pieces), self.right.encode([p[1:] for p in pieces])
        wanted = [p.encode() for p in pieces]
        good = _spelled(ids_a, self.left.spelling, wanted) & _spelled(ids_b, self.right.spelling, wanted)
        a, b = _side(ids_a, self.left.spelling, good), _side(ids_b, self.right.spelling, good)
        group_a, group_b, groups = coalesce(a, b)
        at_a, at_b = overlaps(a, b, group_a, group_b, groups)
        of_a = np.repeat(np.arange(len(pieces)), np.diff(a.first))
        first_of_group = np.searchsorted(group_a, np.arange(groups))
        n = [np.diff(a.first), np.diff(b.first), np.bincount(of_a[first_of_group], minlength=len(pieces)), np.bincount(of_a[at_a], minlength=len(pieces)), good]
        tokens = group_text(a, b, group_a, group_b, self.written)
        ends = (a.first + b.first).tolist()
        text = np.empty(len(pieces), object)
        text[:] = ["".join(tokens[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        for i, piece in enumerate(pieces):
            self.place[piece] = len(self.text) + i
        self.text = np.concatenate([self.text, text])
        self.numbers = np.concatenate([self.numbers, np.array(n, np.int64)], axis=1)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n[3])])
        self.codes = np.concatenate([self.codes, (a.ids[at_a] << B_BITS) | b.ids[at_b]])
        self.chars += sum(map(len, pieces))

    def align(self, texts: pa.Array) -> dict[str, object]:
        """Counts, group hash and distinct linked pairs of every text of a batch."""
        per_doc = [CUT.split(" " + t) if t else [] for t in texts.to_pylist()]
        pieces = [p for doc in per_doc for p in doc]
        missing = [p for p in dict.fromkeys(pieces) if p not in self.place]
        if self.chars + sum(map(len, missing)) > self.limit:
            self.clear()
            missing = list(dict.fromkeys(pieces))
        if missing:
            self._learn(missing)
        at = np.fromiter((self.place[p] for p in pieces), np.int64, len(pieces))
        doc = np.repeat(np.arange(len(per_doc)), [len(x) for x in per_doc])
        bad = np.bincount(doc[self.numbers[4][at] == 0], minlength=len(per_doc)) > 0
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        n_a, n_b, n_groups, n_links = (np.bincount(doc, weights=x[at], minlength=len(per_doc)).astype(np.int64) for x in self.numbers[:4])
        ends = np.searchsorted(doc, np.arange(len(per_doc) + 1)).tolist()
        written = self.text[at]
        shas = [hashlib.sha256("".join(written[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(ends[:-1], ends[1:], strict=True)]
        size = self.numbers[3][at]
        place = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of_link = np.repeat(doc, size)
        codes = self.codes[place]
        order = np.lexsort((codes, of_link)) if len(per_doc) >= 1 << (63 - 2 * B_BITS) else np.argsort((of_link << 2 * B_BITS) | codes)
        of_link, codes = of_link[order], codes[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (of_link[1:] != of_link[:-1])
        kept = np.flatnonzero(new)
        number = np.diff(np.concatenate([kept, [len(codes)]])).astype(np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of_link[kept], minlength=len(per_doc)))]).astype(np.int32))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": shas,
            "codes": pa.ListArray.from_arrays(offsets, pa.array(codes[kept])), "links": pa.ListArray.from_arrays(offsets, pa.array(number)),
        }


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(paths)
    return _ALIGNERS[paths]


def local_alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``LOCAL`` columns of every row: all that a document's own text gives. A code is ``a * 2^B_BITS + b``."""
    paths = paths or default_paths()

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id")} | aligner(paths).align(batch.column("text"))

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, LOCAL)


def pair_counts(local: DataFrame) -> DataFrame:
    """``code, n, best`` of each linked pair: the documents that hold it, and whether no pair of its A id has more."""
    counts = local.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("code", B_BITS)))
    return counts.withColumn("best", F.col("n") == most)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one partition: its chunk of counts, then documents' codes."""
    chunk: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    table = None
    for batch in batches:
        held = np.asarray(batch.column("row").is_null())
        n_held = int(held.sum())
        if n_held:
            part = batch.slice(0, n_held)
            chunk.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")))
        rest = batch.slice(n_held)
        if not len(rest):
            continue
        if table is None:
            code, n, best = (np.concatenate(x) for x in zip(*chunk, strict=True))
            order = np.argsort(code)
            table = code[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool)
            chunk.clear()
        codes, links = rest.column("codes"), rest.column("links")
        sizes = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted, number = codes.flatten().to_numpy(zero_copy_only=False), links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(table[0], wanted)
        if len(wanted) and not np.array_equal(table[0][np.minimum(at, len(table[0]) - 1)], wanted):
            raise ValueError("a pair has no count in its chunk")
        total = np.concatenate([[[0], [0]], np.cumsum([number * table[2][at], number * table[1][at]], axis=1)], axis=1)
        ends = np.cumsum(sizes)
        n_best, count_sum = total[:, ends] - total[:, ends - sizes]
        yield pa.RecordBatch.from_arrays([rest.column("row"), pa.array(n_best), pa.array(count_sum)], names=["row", "n_best", "count_sum"])


def look_up(local: DataFrame, counts: DataFrame, chunk_pairs: int = CHUNK_PAIRS, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of each stored row of ``local`` that has pairs."""
    sizes = local.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("total")).first()
    chunks = max(1, -(-counts.count() // chunk_pairs))
    slices = max(1, -(-sizes["total"] // (slice_pairs * chunks)))
    chunk_of = lambda code: F.pmod(F.xxhash64(code), F.lit(chunks))
    held = counts.select(
        (chunk_of(F.col("code")) * slices).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "code", "n", "best")
    held = held.select((F.col("base") + F.col("slice")).cast("int").alias("part"), "code", "n", "best")
    slice_of = F.pmod(F.xxhash64("row"), F.lit(slices))
    if chunks == 1:
        asked = local.select(slice_of.cast("int").alias("part"), "row", "codes", "links")
    else:
        pairs = F.arrays_zip("codes", "links")
        cut = local.select("row", pairs.alias("pairs"), F.explode(F.array_distinct(F.transform("codes", chunk_of))).alias("chunk"))
        own = cut.select("row", "chunk", F.filter("pairs", lambda p: chunk_of(p["codes"]) == F.col("chunk")).alias("pairs"))
        asked = own.select((F.col("chunk") * slices + slice_of).cast("int").alias("part"), "row", F.col("pairs.codes").alias("codes"), F.col("pairs.links").alias("links"))
    both = held.unionByName(asked.where(F.size("codes") > 0), allowMissingColumns=True)
    dealt = both.repartitionById(chunks * slices, "part").sortWithinPartitions("part", F.col("row").isNotNull())
    parts = dealt.mapInArrow(_look_up, "row long, n_best long, count_sum long")
    return parts if chunks == 1 else parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, chunk_pairs: int = CHUNK_PAIRS, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    local = durable(local_alignments(docs, paths).withColumn("row", F.monotonically_increasing_id()))
    counts = durable(pair_counts(local))
    found = look_up(local, counts, chunk_pairs, slice_pairs)
    zero = F.lit(0).cast("long")
    return local.join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
