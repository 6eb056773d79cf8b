"""Words and rolling hashes of many texts at once, as numpy arrays inside one task.

A word is a run of bytes outside space and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` of the text: these six
characters are single bytes in UTF-8. Arrays cover a slice of rows of bounded size, so a task needs the same
memory whatever the table holds; only a single text longer than the bound makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
# For operators that follow each other in the same workers: arrays of a few MB go back to the system when they are freed,
# larger ones stay with the worker, next to what the executor's JVM holds.
SMALL_SLICE_BYTES = 500_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the row bounds in them; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows holding about `size` bytes of text, one row at least."""
    _, bounds = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Word bounds in `data` and, per row, the range of its words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.bounds = text_bytes(texts)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = np.where(upper, self.data + 32, self.data).astype(np.uint8)
        inside = ~SPACE[self.data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        row_starts = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        before[row_starts] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[self.bounds[1:][self.bounds[:-1] < self.bounds[1:]] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word, from its bytes alone."""
        return range_hashes(self.data, self.start, self.end, seed)

    def window_hashes(self, hashes: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of `size` words within one row starts, and 64 bits for its words in order."""
        starts = self.window_starts(size)
        return starts, sequence_hashes(hashes, starts, starts + size, seed)

    def window_starts(self, size: int) -> np.ndarray:
        index = np.arange(len(self.start))
        return index[index + size <= self.first[1:][self.rows]]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for the bytes and the length of each range."""
    return mixed(_ranges(_byte_values(seed)[data], start, end, seed) + (end - start).astype(np.uint64))


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for the hashes in each range, in order, and their number."""
    return mixed(_ranges(hashes, start, end, seed + 7) + (end - start).astype(np.uint64) * np.uint64(2 * seed + 1))


def number_hashes(numbers: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for the numbers and the length of each range."""
    return mixed(_ranges(mixed(numbers + np.uint64(1)), start, end, seed) + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(1_000_003 * (seed + 1)))


_grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    known = _grown.get(seed)
    if known is None or len(known[0]) < size:
        base = int(mixed(np.array([seed + 99], np.uint64))[0]) | 1
        length = max(size, SLICE_BYTES + 1) if size > SMALL_SLICE_BYTES + 1 else SMALL_SLICE_BYTES + 1
        pair = []
        for value in (base, pow(base, -1, 1 << 64)):
            factors = np.full(length, value, np.uint64)
            factors[0] = 1
            pair.append(np.cumprod(factors))
        if length > SLICE_BYTES + 1:  # one very long text: not worth keeping
            return pair[0], pair[1]
        known = _grown[seed] = (pair[0], pair[1])
    return known


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range, the same wherever the range lies."""
    power, inverse = _powers(seed, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[end] - total[start]) * inverse[start]


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
