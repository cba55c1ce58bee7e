"""Words of Arrow text columns as numpy arrays: no Python object for a word.

A word is a run of bytes other than the six ASCII white-space ones. Texts are taken from the column's buffers, a few MB at a
time; a longer text makes a piece of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 19


@functools.cache
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(_grown(base, BLOCK_BYTES + 1) for base in (_BASE, _BASE_INVERSE))


def _grown(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse; a single word may be longer than a block."""
    return _block_powers() if n <= BLOCK_BYTES else (_grown(_BASE, n + 1), _grown(_BASE_INVERSE, n + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def spans(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values of x."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(_BASE) + x[j : j + n]
    return mixed(out)


class Words:
    """The words of consecutive texts: buf, doc_at (byte offsets of the texts), start and end of each word, first (word offsets of the texts)."""

    def __init__(self, buf: np.ndarray, doc_at: np.ndarray, lower: bool = False):
        self.buf = buf = _LOWER[buf] if lower else buf
        self.doc_at = doc_at
        word = np.zeros(len(buf) + 2, dtype=bool)
        word[1:-1] = ~_SPACE[buf]
        before, here = word[:-1], word[1:]
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[doc_at] = True
        # where a text begins or ends, a word does too
        self.start = np.flatnonzero(here & (~before | cut))
        self.end = np.flatnonzero(before & (~here | cut))
        self.first = np.searchsorted(self.start, doc_at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.doc_at) - 1), self.counts)

    def hashes(self, start: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of the bytes from start to the word's end (start rises and overlaps no other word)."""
        start = self.start if start is None else start
        out = np.empty(len(start), dtype=np.uint64)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(self.end, start[a] + BLOCK_BYTES, "right")))
            lo, hi = int(start[a]), int(self.end[b - 1])
            up, down = _powers(hi - lo)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((self.buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = start[a:b] - lo, self.end[a:b] - lo
            out[a:b] = (sums[e] - sums[s]) * down[s] ^ ((e - s).astype(np.uint64) << np.uint64(40))
            a = b
        return mixed(out)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def pieces(column: pa.Array, lower: bool = False, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for consecutive rows of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b, Words(data[at[a] : at[b]], at[a : b + 1] - at[a], lower)
        a = b
