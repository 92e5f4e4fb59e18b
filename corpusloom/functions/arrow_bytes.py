"""Vectorised work on the UTF-8 buffers of Arrow string columns: slices, spans and 64-bit window hashes.

Every helper works on one slice of a record batch, so memory depends on the slice size
(or on the longest single text), never on the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table that is true for the bytes of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: The white space [\x20\x09-\x0D].
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES, max_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``max_bytes`` bytes (at least one row each, and at most ``max_rows``)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    row = 0
    while row < batch.num_rows:
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        stop = stop if max_rows is None else min(stop, row + max_rows)
        yield batch.slice(row, stop - row)
        row = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte values and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a row."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:][(offsets[1:] > 0)] - 1
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each row's spans: row r has spans bounds[r] to bounds[r + 1]."""
    return np.searchsorted(starts, offsets, side="left")


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        step[0] = 1
        _powers[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash, so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WindowHash:
    """64-bit hashes of any byte windows of one array in constant time each (a prefix-sum polynomial hash)."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power(_MULTIPLIER, n), out=self._sums[1:])
        self._inverse = _power(_INVERSE, n + 1)
        self._seed = np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)) ^ self._seed)
