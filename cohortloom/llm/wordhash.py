"""64-bit hashes of words and of runs of words, for a slice of texts at once (numpy, used inside tasks)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_FACTOR = 0x9E3779B97F4A7C15 | 1
_WORD_FACTOR = 0xD6E8FEB86659FD93 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


@cache
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """factor ** i and its inverse, modulo 2 ** 64, for i in 0..size - 1."""
    inverse = pow(factor, -1, 1 << 64)
    both = []
    for f in (factor, inverse):
        p = np.full(size, f, dtype=np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def powers(factor: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(factor, 1 << max(12, (need - 1).bit_length()))


class Words:
    """The words of a column of texts: ``hash`` and ``doc`` (the row in the column) of each, in order."""

    def __init__(self, column: pa.Array, lower: bool = False, hashed: bool = True):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = pa.compute.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        inside = ~_SEPARATOR[self.data]
        first = np.zeros(len(data) + 1, bool)
        first[self.offsets] = True
        after_gap = np.empty_like(inside)
        after_gap[:1] = True
        after_gap[1:] = ~inside[:-1]
        self.start = np.flatnonzero(inside & (after_gap | first[:-1]))
        before_gap = np.empty_like(inside)
        before_gap[-1:] = True
        before_gap[:-1] = ~inside[1:]
        self.end = np.flatnonzero(inside & (before_gap | first[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.n_docs = len(column)
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        if hashed:
            up, down = powers(_BYTE_FACTOR, len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
            self._sums, self._down = sums, down
            self.hash = self._between(self.start, self.end)

    def _between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of each word's first bytes; that of the word if it has no more."""
        return self._between(self.start, np.minimum(self.end, self.start + size))

    def __len__(self) -> int:
        return len(self.start)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Runs:
    """Hashes of runs of consecutive words, by prefix sums: a run's hash depends on its words alone."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        factor = (_WORD_FACTOR + 2 * salt * 0x632BE59BD9B4E019) % (1 << 64) | 1
        up, self.down = powers(factor, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def whole_windows(words: Words, length: int) -> np.ndarray:
    """Starts of the runs of ``length`` words that lie in one text."""
    if len(words) < length:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[: len(words) - length + 1] == words.doc[length - 1 :])
