"""Canonical length-limited Huffman codes over token ids: vectorised encoding and table-driven decoding.

A block is a run of ids coded on its own.  Every ``STRIDE`` ids its bit offset is kept as a
checkpoint, so decoding runs in as many lanes as there are checkpoints, all in step.
"""

from __future__ import annotations

import struct

import numpy as np

LIMIT = 16
STRIDE = 64
MAGIC = b"QHUF\x01"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for the ids that occur (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if not len(used):
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # levels[k]: which of the sorted coins and packages of a level are coins
    levels, current = [], weight
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        kind = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        at = np.argsort(merged, kind="stable")
        levels.append(kind[at])
        current = merged[at]
    take, depth = 2 * (n - 1), np.zeros(n, np.int64)
    for kind in reversed(levels):
        coins = int(kind[:take].sum())
        depth[:coins] += 1
        take = 2 * (take - coins)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


class Code:
    """Canonical codes: shorter first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = self.lengths[order]
        # the code of a symbol, left-aligned in LIMIT bits, is the sum of the space of those before it
        space = np.int64(1) << (LIMIT - size)
        begin = np.cumsum(space) - space
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = begin >> (LIMIT - size)
        self.symbol = np.zeros(1 << LIMIT, np.int32)
        self.size = np.ones(1 << LIMIT, np.int32)
        if len(order):
            filled = int(space.sum())
            self.symbol[:filled] = np.repeat(order, space)
            self.size[:filled] = np.repeat(size, space)

    def encode(self, ids: np.ndarray) -> bytes:
        """magic, number of ids, number of bits, checkpoints (bit length of each stride), packed codes."""
        n = len(ids)
        size = self.lengths[ids]
        end = np.cumsum(size)
        begin = end - size
        bits = int(end[-1]) if n else 0
        words = np.zeros(bits // 32 + 2, np.uint64)
        if n:
            slot = begin >> 5
            value = self.codes[ids].astype(np.uint64) << (64 - size - (begin & 31)).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            at = slot[first]
            # codes don't overlap, so sums are unions
            words[at] += np.add.reduceat(value >> np.uint64(32), first)
            words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        marks = np.diff(np.r_[begin[::STRIDE], bits]) if n else np.zeros(0, np.int64)
        return MAGIC + struct.pack("<QQ", n, bits) + marks.astype("<u2").tobytes() + words.astype(">u4").tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        if block[:5] != MAGIC:
            raise ValueError("not a coded block")
        n, _ = struct.unpack_from("<QQ", block, 5)
        lanes = -(-n // STRIDE)
        marks = np.frombuffer(block, "<u2", lanes, 21).astype(np.int64)
        words = np.frombuffer(block, ">u4", offset=21 + 2 * lanes).astype(np.uint64)
        pairs = words[:-1] << np.uint64(32) | words[1:]
        at = np.cumsum(marks) - marks
        out = np.zeros((STRIDE, lanes), np.int32)
        full = lanes if n % STRIDE == 0 else lanes - 1
        for k in range(STRIDE):
            live = lanes if k < n - full * STRIDE else full
            here = at[:live]
            window = (pairs[here >> 5] >> (48 - (here & 31)).astype(np.uint64)).astype(np.int64) & 0xFFFF
            out[k, :live] = self.symbol[window]
            here += self.size[window]
        return out.T.reshape(-1)[:n]
