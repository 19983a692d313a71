"""Vectorised word kernels over Arrow string batches.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; all of those are single bytes in UTF-8, so
working on bytes gives the same words as working on code points. Texts are cut into chunks of whole rows of
about ``CHUNK`` bytes, so memory follows one chunk (or one row, if a row is longer), never a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made = np.multiply.accumulate(steps)
            if size <= 4 * CHUNK:
                _POWERS[name] = made
            else:  # a very long row: used once, not kept
                _POWERS[f"{name}_long"] = made
        if size > 4 * CHUNK:
            return _POWERS.pop("up_long"), _POWERS.pop("down_long")
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of consecutive rows. ``first[i]:first[i + 1]`` are the words of row ``row + i``."""

    row: int
    raw: np.ndarray  # bytes of the chunk
    rows: np.ndarray  # byte offsets of rows in raw
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    first: np.ndarray  # word offsets of rows

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.raw) + 1)
        raw = LOWER[self.raw] if lower else self.raw
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[self.start])


def binary_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_binary array; nulls stay null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def words(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """Words of every row, chunk by chunk; null rows have none."""
    column = binary_column(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:
        sizes = np.diff(offsets) * np.asarray(column.is_valid())
        if sizes.sum() != offsets[-1] - offsets[0]:  # a null row may still cover bytes
            column = column.fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        b = min(b, n)
        raw = data[offsets[a] : offsets[b]]
        rows = offsets[a : b + 1] - offsets[a]
        word = ~SPACE[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = word[:-1]
        before[rows[:-1][rows[:-1] < len(raw)]] = False
        start = np.flatnonzero(word & ~before)
        after = np.zeros(len(raw), bool)
        after[:-1] = word[1:]
        last = rows[1:] - 1
        after[last[(last >= 0) & (rows[1:] > rows[:-1])]] = False
        end = np.flatnonzero(word & ~after) + 1
        yield Words(a, raw, rows, start, end, np.searchsorted(start, rows))
        a = b
    # workers are used again by other stages: what the batch took goes back
    pa.default_memory_pool().release_unused()


_STEPS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; entry ``i`` covers words ``i .. i + size - 1``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _STEPS[k]
    return mix64(total)


def shingle_sets(chunk: Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a chunk, words lower-cased (A-Z).

    A row with fewer than ``size`` words has its whole sequence as the one shingle; without words, none.
    """
    hashes = chunk.hashes(lower=True)
    windows = window_hashes(hashes, size)
    first = chunk.first
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            found = np.sort(windows[a : b - size + 1])
            if len(found) > 1:
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                found = found[keep]
        elif b > a:
            found = mix64((hashes[a:b] * _STEPS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            found = windows[:0]
        yield chunk.row + i, found
