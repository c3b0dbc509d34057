"""Token ids of whole texts with a public tokenizer, encoding each distinct piece once per Python worker.

The vocabulary's normaliser and splitter never look across ASCII white space, nor between an ASCII letter or
digit and ASCII punctuation other than the apostrophe, and they ignore case: the ids of a text are the ids of its
lower-cased pieces in a row. New pieces are encoded many at a time, set apart by a control character that is a
token of its own; a piece that holds it is encoded by itself. The cache of a worker is emptied when it holds
``CACHE_WORDS`` words, which bounds memory and changes no result.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cohortlab.llm import words

CACHE_WORDS = 500_000
_JOIN = 512
_MARK = "\x01"
_CACHES: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Ids:
    """Ids of some rows in a row, and the place of each row's first id (n + 1 places)."""

    ids: np.ndarray
    first: np.ndarray


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _CACHES:
        _CACHES[path] = Encoder(path)
    return _CACHES[path]


class Encoder:
    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        """An open-addressed table from the hash of a piece to the place and number of its ids in ``pool``."""
        bits = max(10, (2 * self.limit - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.place = np.zeros(1 << bits, np.int32)
        self.count = np.zeros(1 << bits, np.int32)
        self.held = self.used = 0
        self.pool = np.zeros(1 << 12, np.uint32)

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and the number of ids of each."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        counts: list[np.ndarray] = [np.zeros(0, np.int32)]
        for at in range(0, len(texts), _JOIN):
            part = texts[at : at + _JOIN]
            if self.mark is None or any(_MARK in t for t in part):
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
                ids += each
                counts.append(np.array([len(x) for x in each], np.int32))
                continue
            joined = f" {_MARK} ".join(part)
            got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            mark = got == self.mark
            ids.append(got[~mark])
            counts.append(np.diff(np.concatenate([[-1], np.flatnonzero(mark), [len(got)]])).astype(np.int32) - 1)
        return np.concatenate(ids), np.concatenate(counts)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or of the empty slot where its search ended, as -1 - slot."""
        slot = (hashes >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, slot, -1 - slot)
        rest = np.flatnonzero((key != hashes) & (key != 0))
        while len(rest):
            slot = (-1 - out[rest] + 1) & self.last
            key = self.keys[slot]
            out[rest] = np.where(key == hashes[rest], slot, -1 - slot)
            rest = rest[(key != hashes[rest]) & (key != 0)]
        return out

    def _learn(self, found: words.Words, hashes: np.ndarray, missing: np.ndarray) -> None:
        new, sample = np.unique(hashes[missing], return_index=True)
        sample = missing[sample]
        raw = found.data
        spans = zip(found.starts[sample].tolist(), found.ends[sample].tolist(), strict=True)
        ids, counts = self.encode_words([raw[s:e].tobytes().decode("utf-8", "replace") for s, e in spans])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        place = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.held += len(new)
        left = np.arange(len(new))
        while len(left):  # pieces that end at the same empty slot take turns
            slot = -1 - self._find(new[left])
            slot, first = np.unique(slot, return_index=True)
            put = left[first]
            self.keys[slot], self.place[slot], self.count[slot] = new[put], place[put], counts[put]
            left = np.setdiff1d(left, put, assume_unique=True)

    def _look_up(self, texts: pa.Array) -> tuple[words.Words, np.ndarray]:
        """Pieces of the rows, and the slot of each."""
        found = words.split(texts, lower=True, pieces=True)
        hashes = np.maximum(found.hashes, np.uint64(1))
        slots = self._find(hashes)
        missing = np.flatnonzero(slots < 0)
        if not len(missing):
            return found, slots
        if self.held + len(missing) > self.limit:
            self.limit = max(self.limit, 2 * len(hashes))
            self.clear()
            missing = np.arange(len(hashes))
        self._learn(found, hashes, missing)
        return found, self._find(hashes)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        found, at = self._look_up(texts)
        total = np.concatenate([[0], np.cumsum(self.count[at], dtype=np.int64)])
        return np.diff(total[found.first])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Ids:
        """Ids of each row, each ended by ``end_id`` if one is given; a null text is empty."""
        found, at = self._look_up(texts)
        counts = self.count[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        first = total[found.first]
        ids = self.pool[np.repeat(self.place[at] - total[:-1], counts) + np.arange(int(total[-1]))]
        if end_id is None:
            return Ids(ids, first)
        return Ids(np.insert(ids, first[1:], np.uint32(end_id)), first + np.arange(len(first)))
