"""Counts of a text that quality rules and scores use, for whole Arrow batches with numpy.

Words keep their case here. Lines are cut at each newline.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cohortlab.llm import words

SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_exclaim",
    "n_punctuation", "n_wide", "n_distinct_words",
)
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def _class(members) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(members)] = 1
    return out


_UPPER = _class(range(65, 91))
_LETTERS = _UPPER + _class(range(97, 123))
_CLASSES = {
    "word_chars": 1 - _class(range(0x80, 0xC0)) - _class(words.SPACES), "n_symbols": _class(SYMBOLS), "n_upper": _UPPER, "n_letters": _LETTERS,
    "n_digits": _class(range(48, 58)), "n_exclaim": _class(b"!"), "n_punctuation": _class(b for b in range(33, 127) if not chr(b).isalnum()),
    "n_wide": _class(range(0xC0, 256)),
}


def _runs(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal hashes of a row together, and whether each place repeats the one before."""
    key = words.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    return order, same


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each of ``COUNTS`` for every row; null is empty."""
    found = words.split(texts)
    n, rows, data = len(texts), found.rows, found.data
    bytes_of = np.zeros((n, 256), np.int64)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        bytes_of[i] = np.bincount(data[a:b], minlength=256)
    out = {name: bytes_of @ members for name, members in _CLASSES.items()}
    out["n_words"] = np.diff(found.first)

    line = np.zeros(len(data) + 1, bool)
    line[rows[:-1][np.diff(rows) > 0]] = True
    line[1:][np.flatnonzero(data == 10)] = True
    starts = np.flatnonzero(line[:-1])
    ends = np.concatenate([starts[1:], [len(data)]]).astype(np.int64) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    wordy = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    row = np.searchsorted(rows, starts, "right") - 1
    order, same = _runs(row, words.span_hashes(data, starts, ends))
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[order[same]], minlength=n)

    row = found.row_of_word()
    order, same = _runs(row, found.hashes)
    out["n_distinct_words"] = out["n_words"] - np.bincount(row[order[same]], minlength=n)
    window = words.windows(found.hashes, 3)
    whole = row[: len(window)] == row[2:] if len(window) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    order, same = _runs(row[at], window[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    first = at[order[twice]]
    covered = np.zeros(len(row), bool)
    for j in range(3):
        covered[first + j] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return {name: out[name].astype(np.int64) for name in COUNTS}
