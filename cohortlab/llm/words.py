"""Words of whole texts as 64-bit hashes, computed with numpy for an Arrow batch at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial over random byte values
modulo 2^64, taken from running sums, then mixed. Memory follows the batch: long texts are hashed in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


_KIND = np.ones(256, np.uint8)  # 0 white space, 2 ASCII letter or digit, 3 ASCII punctuation but the apostrophe, 1 any other byte
_KIND[list(SPACES)] = 0
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 3
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[65:91] = _VALUE[97:123]
_POWER = _powers(_BASE, CHUNK_BYTES + 1)
_UNPOWER = _powers(_INVERSE, CHUNK_BYTES + 1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_POWER):
        return _POWER, _UNPOWER
    return _powers(_BASE, n), _powers(_INVERSE, n)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each span ``data[start:end]``; spans are sorted and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    table, first = (_LOWER_VALUE if lower else _VALUE), 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        high = int(ends[last - 1])
        power, unpower = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((total[e] - total[s]) * unpower[s] + (e - s).astype(np.uint64))
        first = last
    return out


@dataclass
class Words:
    """Words of some rows: byte spans and hashes, and the place of each row's first word (n + 1 places)."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and the n + 1 places where rows begin; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole rows of about ``limit`` bytes, with the first row of each."""
    _, offs = buffers(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, texts.slice(row, end - row)
        row = end


def split(texts: pa.Array, lower: bool = False, pieces: bool = False) -> Words:
    """All words of the rows, in order; ``pieces`` also cuts them between ASCII letters or digits and punctuation."""
    data, rows = buffers(texts)
    kind = _KIND[data]
    inside = kind != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    if len(data):
        cut[1:-1] |= kind[1:] * kind[:-1] == 6 if pieces else ~inside[:-1]
        if pieces:
            cut[1:-1] |= ~inside[:-1]
    starts = np.flatnonzero(inside & cut[:-1])
    stop = cut[1:].copy()
    stop[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & stop) + 1
    return Words(data, rows, starts, ends, span_hashes(data, starts, ends, lower), np.searchsorted(starts, rows))


_WEIGHTS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes, by its first place (``len - size + 1`` values)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * _WEIGHTS[j]
    return mix(total)


def long_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """As :func:`windows`, by running sums: the work doesn't grow with ``size``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, unpower = _power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:n]) * unpower[:n] + np.uint64(size))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of one text, sorted; fewer words give the whole sequence as one, none give none."""
    if len(hashes) >= size:
        return np.unique(windows(hashes, size))
    return windows(hashes, len(hashes)) if len(hashes) else np.zeros(0, np.uint64)
