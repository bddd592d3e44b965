"""Directly addressable codes for token ids, and the segment format that holds them.

An id is cut into chunks of 8 bits, the lowest first. Level 0 has the first chunk of every id; a bitmap says which ids go on, and level 1
has the next chunk of those only, and so on. A rank directory (ones before each block of 512 bits) turns a position of one level into its
position in the next, so any id is read by a few lookups, without decoding its neighbours.

A segment, little-endian:  b"DAC1" | u32 documents | u64 ids | u8 levels |
i64 doc_id per document | u8 per document: 1 where doc_id is null | u64 ids up to and with each document |
per level: u64 n | n chunk bytes | ceil(n / 8) bitmap bytes | (n // 512 + 1) x u32 rank directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"DAC1", 512


def encode(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One segment of the ids of whole documents; ends: ids up to and with each document."""
    levels, v = [], ids.astype(np.uint32)
    while True:
        more = v > 255
        ones = np.concatenate([[0], np.cumsum(more)])[:: BLOCK][: len(v) // BLOCK + 1].astype("<u4")
        levels += [struct.pack("<Q", len(v)), (v & 255).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ones.tobytes()]
        v = v[more] >> 8
        if not len(v):
            break
    head = MAGIC + struct.pack("<IQB", len(doc_ids), len(ids), len(levels) // 4)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join([head, keys, ends.astype("<u8").tobytes(), *levels])


class Segment:
    """Reads a segment: one id by position, or all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of this format")
        self.n_docs, self.n, n_levels = struct.unpack_from("<IQB", data, 4)
        at = 17
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.null = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bits)
            rank = np.frombuffer(data, "<u4", n // BLOCK + 1, at)
            at += 4 * len(rank)
            self.levels.append((chunks, bits, rank))

    def __getitem__(self, i: int) -> int:
        """The id at position i, by one rank lookup for each further chunk."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bits, rank in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(rank[block]) + int(before.sum()), shift + 8
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        out = np.zeros(0, dtype=np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            v = chunks.astype(np.uint32)
            if len(out):
                v[np.unpackbits(bits, count=len(v), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = v
        return out
