"""Two-stage suffix sorting of a block of texts, and the repeated windows that its common prefixes show.

Suffixes smaller than their successors are sorted directly, by eight bytes at a time and no deeper
than asked; all others are induced: one scan over the first-byte buckets, in ascending order, puts
every suffix that is larger than its successor behind those already known to be smaller.
"""

from __future__ import annotations

import numpy as np


class Block:
    """Texts joined by a terminator that is below every byte (UTF-8 has no byte 0xFF, so bytes move up by one)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        self.first = offsets[:-1] + np.arange(n)
        self.chars = np.zeros(len(data) + n, np.uint8)
        inside = np.ones(len(self.chars), bool)
        self.last = self.first + sizes
        inside[self.last] = False
        self.chars[inside] = data + np.uint8(1)
        self.text = np.repeat(np.arange(n), sizes + 1)
        self.left = self.last[self.text] - np.arange(len(self.chars))
        padded = np.concatenate([self.chars, np.zeros(8, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(self.chars), np.uint64)
        for i in range(8):
            word = word << np.uint64(8) | padded[i : i + len(word)]
        cut = np.minimum(self.left, 8)
        self.word = np.where(cut < 8, word & ~((np.uint64(1) << (8 * (8 - np.maximum(cut, 1))).astype(np.uint64)) - np.uint64(1)), word)
        self.word[cut == 0] = 0

    def at(self, positions: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of each suffix from ``depth`` on, zeros after its end."""
        out = np.zeros(len(positions), np.uint64)
        more = self.left[positions] > depth
        out[more] = self.word[positions[more] + depth]
        return out

    def rising(self) -> np.ndarray:
        """Suffixes that are smaller than their successor (a terminator is not)."""
        n = len(self.chars)
        step = np.zeros(n, np.int16)
        step[:-1] = np.diff(self.chars.astype(np.int16))
        where = np.where(step != 0, np.arange(n), n - 1)
        turn = np.minimum.accumulate(where[::-1])[::-1]
        return (step[turn] > 0) & (self.chars > 0)

    def sort_directly(self, positions: np.ndarray, depth: int) -> np.ndarray:
        """``positions`` by their suffixes' first ``depth`` bytes."""
        order = np.argsort(self.word[positions], kind="stable")
        positions = positions[order]
        key = self.word[positions]
        rank = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else key
        for k in range(8, depth, 8):
            same = np.zeros(len(rank) + 1, bool)
            same[1:-1] = rank[1:] == rank[:-1]
            tied = np.flatnonzero((same[1:] | same[:-1]) & (self.left[positions] > k - 8))
            if not len(tied):
                break
            group, key = rank[tied], self.at(positions[tied], k)
            order = np.lexsort((key, group))
            positions[tied] = positions[tied[order]]
            new = np.zeros(len(rank), np.int64)
            key, group = key[order], group[order]
            new[tied[1:]] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
            new[1:] += rank[1:] != rank[:-1]
            rank = np.cumsum(new > 0)
        return positions

    def suffixes(self, depth: int) -> np.ndarray:
        """All suffixes in order of their first ``depth`` bytes or more."""
        rising = self.rising()
        direct = self.sort_directly(np.flatnonzero(rising), depth)
        begin = np.searchsorted(self.chars[direct], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        waiting[0] = [np.flatnonzero(self.chars == 0)]
        inner = np.ones(len(self.chars), bool)
        inner[self.first] = False
        out = []
        for c in range(256):
            part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
            waiting[c] = []
            levels = [part]
            while c and len(part):  # runs of one byte
                part = part[inner[part]] - 1
                part = part[(self.chars[part] == c) & ~rising[part]]
                levels.append(part)
            bucket = np.concatenate([*levels, direct[begin[c] : begin[c + 1]]])
            if not len(bucket):
                continue
            out.append(bucket)
            before = bucket[inner[bucket]] - 1
            before = before[self.chars[before] > c]
            head = self.chars[before]
            before = before[np.argsort(head, kind="stable")]
            cuts = np.searchsorted(self.chars[before], np.arange(257))
            for b in np.unique(head).tolist():
                waiting[b].append(before[cuts[b] : cuts[b + 1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def common(self, order: np.ndarray, most: int) -> np.ndarray:
        """Common prefix of each suffix in ``order`` with the one before it, up to ``most``; 0 for the first."""
        out = np.zeros(len(order), np.int64)
        open_ = np.arange(1, len(order))
        for k in range(0, most, 8):
            a, b = self.at(order[open_], k), self.at(order[open_ - 1], k)
            same = a == b
            odd = (a ^ b)[~same]
            shift = np.zeros(len(odd), np.int64)
            for i in range(1, 8):
                shift += odd < np.uint64(1) << np.uint64(8 * i)
            out[open_[~same]] = k + shift
            open_ = open_[same]
        out[open_] = most
        return np.minimum(out, np.minimum(self.left[order], most))

    def repeated(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window positions, group of equal windows of ``size`` bytes), for groups of two or more."""
        order = self.suffixes(size)
        order = order[self.left[order] >= size]
        common = self.common(order, size)
        group = np.cumsum(common < size) if len(order) else common
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        return order[many], group[many]
