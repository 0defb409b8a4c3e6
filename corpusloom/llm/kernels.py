"""Vectorised kernels over Arrow string columns, shared by the operators that scan texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values).
BYTE_BASE = U64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = U64(0xD6E8FEB86659FD93)
BYTE_BASE_2 = U64(0xC2B2AE3D27D4EB4F)
WORD_BASE_2 = U64(0xFF51AFD7ED558CCD)
#: Bytes of text that a kernel takes at once; a longer document is a slice of its own.
SLICE_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(max(n, 2 * len(self.up)), b, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_BYTES, _WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)
_BYTES_2, _WORDS_2 = Powers(BYTE_BASE_2), Powers(WORD_BASE_2)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a string column; null is empty."""
    col = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each document's first word (and one more)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; second: of another, independent family."""
    up, down = (_BYTES_2 if second else _BYTES).upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class WordSums:
    """Hashes of any range of words in constant time, from the words' hashes."""

    def __init__(self, hashes: np.ndarray, second: bool = False):
        self.up, self.down = (_WORDS_2 if second else _WORDS).upto(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """Hash of sizes words from each start."""
        return mix((self.sums[starts + sizes] - self.sums[starts]) * self.down[starts] + np.asarray(sizes, U64))

    def grams(self, n: int) -> np.ndarray:
        """Hash of each n consecutive words, by first word; documents are not told apart."""
        return self.ranges(np.arange(max(0, len(self.sums) - n)), n)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1]) if width < n else out
