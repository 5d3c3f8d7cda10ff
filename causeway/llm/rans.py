"""A static range asymmetric numeral system over token ids, and its block format.

One table of frequencies, scaled to ``2**SCALE`` and shared by all blocks, drives
``LANES`` interleaved 64-bit states that put out 32-bit words. A block stands
alone: header, document lengths, checkpoints, words, CRC-32 of its ids. At every
checkpoint (``CHECKPOINT`` ids) the states and the place in the words are kept, so
the segments of a block, like blocks, decode in parallel.

Block, little-endian: magic ``CRN1``; uint32 documents, ids, segments, lanes,
words, crc32; int64 id and uint32 length of each document; per segment uint32
first word and ``lanes`` uint64 states; uint32 words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

SCALE, LANES, CHECKPOINT = 18, 1024, 1 << 16
LOW = 1 << 31
MAGIC = b"CRN1"
U64 = np.uint64


@dataclass(frozen=True)
class Table:
    """Scaled frequencies by id (0: never occurs); their sum is ``2**SCALE``."""

    freq: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """From counts of all ids; every id that occurs keeps a frequency of 1 or more."""
        counts = np.asarray(counts, np.float64)
        seen, whole = counts > 0, 1 << SCALE
        if seen.sum() > whole:
            raise ValueError("more distinct ids than the scale can hold")
        if not seen.any():
            counts, seen = np.ones(max(1, len(counts))), np.ones(max(1, len(counts)), bool)
        freq = np.where(seen, np.maximum(1, np.floor(counts * (whole / counts.sum()))), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        i = 0
        while (d := whole - int(freq.sum())) != 0:  # the largest take the rounding
            j = order[i % len(order)]
            freq[j] += d if d > 0 else max(d, -(int(freq[j]) // 2) if freq[j] > 1 else 0)
            i += 1
        return cls(freq)

    @cached_property
    def start(self) -> np.ndarray:
        return (np.cumsum(self.freq) - self.freq).astype(U64)

    @cached_property
    def by_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


def _encode_segment(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """States to begin decoding with, and the words in reading order."""
    steps = -(-len(ids) // LANES)
    freq, start = table.freq[ids].astype(U64), table.start[ids]
    state, words = np.full(LANES, LOW, U64), []
    for t in range(steps - 1, -1, -1):
        f, s = freq[t * LANES : (t + 1) * LANES], start[t * LANES : (t + 1) * LANES]
        x = state[: len(f)]
        out = x >= f * U64((LOW >> SCALE) << 32)
        words.append(x[out].astype(np.uint32))
        x = np.where(out, x >> U64(32), x)
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << U64(SCALE)) + r + s
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def _decode_segment(state: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    state, at, ids = state.copy(), 0, np.empty(n, np.uint32)
    for t in range(0, n, LANES):
        k = min(LANES, n - t)
        x = state[:k]
        slot = x & U64((1 << SCALE) - 1)
        got = table.by_slot[slot]
        ids[t : t + k] = got
        x = table.freq[got].astype(U64) * (x >> U64(SCALE)) + slot - table.start[got]
        low = np.flatnonzero(x < U64(LOW))
        x[low] = (x[low] << U64(32)) | words[at : at + len(low)]
        at += len(low)
        state[:k] = x
    if (state != U64(LOW)).any():
        raise ValueError("the words don't lead back to the first states")
    return ids


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    found = [_encode_segment(ids[i : i + CHECKPOINT], table) for i in range(0, len(ids), CHECKPOINT)]
    first = np.cumsum([0, *(len(w) for _, w in found)])
    head = struct.pack("<6I", len(doc_ids), len(ids), len(found), LANES, first[-1], zlib.crc32(ids.astype("<u4").tobytes()))
    points = b"".join(struct.pack("<I", a) + s.astype("<u8").tobytes() for a, (s, _) in zip(first, found))
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), points, *(w.astype("<u4").tobytes() for _, w in found)])


def decode_block(block: bytes, table: Table, segments: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids); with ``segments``, only their ids, unchecked."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n, n_seg, lanes, n_words, crc = struct.unpack_from("<6I", block, 4)
    if lanes != LANES or len(block) != 28 + 12 * n_docs + n_seg * (4 + 8 * lanes) + 4 * n_words:
        raise ValueError("the block's sizes don't agree")
    at = 28
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    lengths = np.frombuffer(block, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    points = [(struct.unpack_from("<I", block, p)[0], np.frombuffer(block, "<u8", lanes, p + 4)) for p in range(at, at + n_seg * (4 + 8 * lanes), 4 + 8 * lanes)]
    words = np.frombuffer(block, "<u4", n_words, at + n_seg * (4 + 8 * lanes))
    parts = [_decode_segment(points[i][1], words[points[i][0] :], min(CHECKPOINT, n - i * CHECKPOINT), table) for i in (range(n_seg) if segments is None else segments)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if segments is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum mismatch")
    return doc_ids, lengths, ids
