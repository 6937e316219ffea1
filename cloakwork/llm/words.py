"""Hashes of all words of a batch of texts, in numpy, from the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Its hash is a polynomial over its bytes
modulo 2**64, taken as a difference of prefix sums, then mixed; so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, _BLOCK + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block; firsts: where rows begin in it."""
    n = len(data)
    space = _SPACE[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = firsts[(firsts > 0) & (firsts < n)]
    begins[inner] |= ~space[inner]
    ends[inner - 1] |= ~space[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[:n], out=sums[1:])
    raw = (sums[stops] - sums[starts]) * inverse[starts]
    return starts, mix(raw + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets into them of the rows."""
    starts, hashes, at, end = [], [], 0, int(offsets[-1])
    while at < end:
        to = min(end, at + _BLOCK)
        if to < end:
            row = offsets[np.searchsorted(offsets, to, "right") - 1]
            gaps = np.flatnonzero(_SPACE[data[at:to]])
            to = max(int(row), at + int(gaps[-1]) + 1 if len(gaps) else at)
            if to <= at:  # one word longer than a block
                more = np.flatnonzero(_SPACE[data[at + _BLOCK : end]])
                nxt = offsets[np.searchsorted(offsets, at, "right")]
                to = min(int(nxt), at + _BLOCK + int(more[0]) + 1 if len(more) else end)
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)]
        s, h = _block_words(data[at:to], rows - at)
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def forget_powers() -> None:
    """Frees the tables that the last block needed."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows of at most `most` bytes each, at least one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to
