"""Vectorised text primitives shared by the corpus operators.

A batch of texts is one array of UTF-8 bytes plus offsets (Arrow's own layout).
Words, lines, windows and shingles are found with numpy over the whole batch;
no Python loop runs over words. Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; UTF-8 never uses those bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that begin a character.
LEADS = (np.arange(256) & 0xC0) != 0x80


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BATCH_BYTES, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, x, U64), dtype=U64)]) for x in (_BASE, _INVERSE))
    return _powers[size]


class Texts:
    """Some texts of a column: ``data`` holds their bytes, ``at`` their offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int = 0):
        self.data, self.at, self.first = data, at, first
        self.n = len(at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of one number per byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Sums from which :meth:`spans` gets the hash of any span."""
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * powers(len(data))[0][: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * powers(len(self.data))[1][start] + (end - start).astype(U64))

    def runs(self, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes not ``outside``, and where each text's runs begin."""
        n = len(self.data)
        edge = np.ones(n + 1, bool)
        edge[1:n] = False
        edge[self.at] = True
        inside = ~outside
        before = edge[:-1].copy()
        before[1:] |= outside[:-1]
        after = edge[1:].copy()
        after[:-1] |= outside[1:]
        start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        return start, end, np.searchsorted(start, self.at)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(SPACE[self.data]) if len(self.data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64))


def windows(codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows, and where each text's windows begin.

    ``codes`` has a hash per word, ``first`` where each text's words begin.
    """
    n = max(0, len(codes) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + codes[j : j + n]
    size = np.maximum(np.diff(first) - k + 1, 0)
    keep = np.repeat(first[:-1], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    return mix(out[keep] + U64(k)), np.concatenate([[0], np.cumsum(size)])


def shingle_sets(texts: Texts, k: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``k``-word shingles over lower-cased A-Z.

    A text of fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    start, end, first = texts.words()
    if not len(start):
        return [np.zeros(0, U64)] * texts.n
    codes = texts.spans(texts.prefix(LOWER[texts.data]), start, end)
    rows, at = windows(codes, first, k)
    out = []
    for i in range(texts.n):
        n = first[i + 1] - first[i]
        if n >= k:
            x = np.sort(rows[at[i] : at[i + 1]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif n:
            out.append(windows(codes[first[i] : first[i + 1]], np.array([0, n]), int(n))[0])
        else:
            out.append(np.zeros(0, U64))
    return out


def batches(column: pa.Array, limit: int | None = None) -> Iterator[Texts]:
    """The texts of an Arrow string or binary column, without copying; null counts as empty."""
    limit = limit or BATCH_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Texts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo)
        lo = hi


def ragged(parts: list[np.ndarray]) -> pa.Array:
    """A binary column with the bytes of each array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
