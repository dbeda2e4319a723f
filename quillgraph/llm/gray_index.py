"""Hierarchical Hamming index over fingerprints in Gray order.

Fingerprints are sorted by their rank in the binary-reflected Gray sequence, so neighbours share
most bits.  Every eight neighbours form a node that holds the bits all of them share (a mask and
a value); every eight nodes form an upper node, up to one root for each group.  A node keeps only
the shared bits that no ancestor has already factored out, so the differences of a query to the
nodes on a path add up to a lower bound of its distance to every member, and a whole subtree is
left as soon as the sum exceeds the radius.
"""

from __future__ import annotations

import numpy as np

FAN = 8


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes over runs of members: residual mask, value, first child and number of children."""

    def __init__(self, shared: np.ndarray, value: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        self.shared, self.value, self.first, self.sizes = shared, value, first, sizes
        self.residual = shared


class GrayIndex:
    """A forest with one tree for each group.  codes: sorted by (group, Gray rank); groups: dense ids."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        ands, ors, owner = codes, codes, groups
        self.levels: list[Level] = []
        while True:
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            size = np.diff(np.r_[begin, len(owner)])
            if self.levels and (size == 1).all():
                break
            within = np.arange(len(owner)) - np.repeat(begin, size)
            first = np.flatnonzero(within % FAN == 0)
            ands, ors = np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first)
            owner = owner[first]
            self.levels.append(Level(~(ands ^ ors), ands, first, np.diff(np.r_[first, len(within)])))
        for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            lower.residual = lower.shared & ~np.repeat(upper.shared, upper.sizes)

    def near(self, queries: np.ndarray, radius: int, uniform: list[np.ndarray] | None = None, label: np.ndarray | None = None):
        """Pairs (query, later member) of one group within ``radius``, both as positions in ``codes``.

        Blocks of the frontier are handled depth first, so memory stays bounded.  With labels,
        members and nodes that are known to be linked to the query already are left out.
        """
        found = []
        top = self.levels[-1]
        owner_of_root = np.searchsorted(self.root_starts(), queries, "right") - 1
        gap = np.bitwise_count((self.codes[queries] ^ top.value[owner_of_root]) & top.residual[owner_of_root]).astype(np.int64)
        stack = [(len(self.levels) - 1, queries, owner_of_root, gap)]
        while stack:
            depth, q, node, gap = stack.pop()
            keep = gap <= radius
            if uniform is not None:
                keep &= uniform[depth][node] != label[q]
            q, node, gap = q[keep], node[keep], gap[keep]
            if not len(q):
                continue
            level = self.levels[depth]
            sizes = level.sizes[node]
            child = np.repeat(level.first[node] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            q, gap, node = np.repeat(q, sizes), np.repeat(gap, sizes), np.repeat(node, sizes)
            if depth == 0:
                keep = child > q
                if label is not None:
                    keep &= label[child] != label[q]
                q, child = q[keep], child[keep]
                keep = np.bitwise_count(self.codes[q] ^ self.codes[child]) <= radius
                found.append((q[keep], child[keep]))
                continue
            lower = self.levels[depth - 1]
            keep = self.last_member(depth - 1)[child] > q
            q, gap, child = q[keep], gap[keep], child[keep]
            gap = gap + np.bitwise_count((self.codes[q] ^ lower.value[child]) & lower.residual[child])
            for i in range(0, len(q), 1 << 18):
                stack.append((depth - 1, q[i : i + (1 << 18)], child[i : i + (1 << 18)], gap[i : i + (1 << 18)]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def last_member(self, depth: int) -> np.ndarray:
        """Largest member position under each node of a level."""
        if not hasattr(self, "_last"):
            self._last = []
            for level in self.levels:
                end = level.first + level.sizes - 1
                self._last.append(end if not self._last else self._last[-1][end])
        return self._last[depth]

    def root_starts(self) -> np.ndarray:
        return np.r_[0, self.last_member(len(self.levels) - 1)[:-1] + 1]

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all its members have, else -1."""
        out, low, high = [], label, label
        for level in self.levels:
            low, high = np.minimum.reduceat(low, level.first), np.maximum.reduceat(high, level.first)
            out.append(np.where(low == high, low, -1))
        return out


def _relabel(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking members a[i] and b[i]; a label is the least of its set."""
    x, y = label[a], label[b]
    while True:
        odd = x != y
        if not odd.any():
            return label
        x, y = x[odd], y[odd]
        target = np.arange(len(label))
        np.minimum.at(target, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = target[target]
            if (jumped == target).all():
                break
            target = jumped
        label = target[label]
        x, y = target[x], target[y]


def forest(codes: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions that join exactly what links of at most ``radius`` bits join inside each group.

    Every edge is itself such a link or a chain of them; at most one edge for each position.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((gray_rank(codes), groups))
    sorted_codes, sorted_groups = codes[order], groups[order]
    dense = np.cumsum(np.r_[0, sorted_groups[1:] != sorted_groups[:-1]])
    label = np.arange(n)
    for turn in (0, 16, 32, 48):  # neighbours in a few Gray orders: most links of a tight group
        turned = (sorted_codes << np.uint64(turn)) | (sorted_codes >> np.uint64((64 - turn) % 64)) if turn else sorted_codes
        at = np.lexsort((gray_rank(turned), dense))
        a, b = at[:-1], at[1:]
        link = (dense[a] == dense[b]) & (np.bitwise_count(sorted_codes[a] ^ sorted_codes[b]) <= radius)
        label = _relabel(label, a[link], b[link])
    index = GrayIndex(sorted_codes, dense)
    within = np.arange(n) - np.searchsorted(dense, dense)
    # the first of each group, which may be near all others, before the rest of it
    for low, high in ((0, 8), (8, 64), (64, n)):
        q = np.flatnonzero((within >= low) & (within < high))
        for i in range(0, len(q), 1 << 13):
            a, b = index.near(q[i : i + (1 << 13)], radius, index.uniform(label), label)
            label = _relabel(label, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels after the pairs, which pairs did it): of pairs in order of preference those that make a spanning forest."""
    kept, at = [], np.arange(len(a))
    while True:
        x, y = label[a[at]], label[b[at]]
        odd = x != y
        at, x, y = at[odd], x[odd], y[odd]
        if not len(at):
            return label, np.concatenate(kept) if kept else at
        # each label takes its first pair with a smaller one, so no circle can arise
        high, first = np.unique(np.maximum(x, y), return_index=True)
        kept.append(at[first])
        target = np.arange(len(label))
        target[high] = np.minimum(x, y)[first]
        while not (target[target] == target).all():
            target = target[target]
        label = target[label]


TIERS = (2, 4, 7, 10, 14, 18)


def nearest_pairs(codes: np.ndarray, groups: np.ndarray, radius: int, known: np.ndarray | None = None, barred=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions, the nearest first, that span what differences of at most ``radius`` bits join inside each group: a forest.

    ``known``: labels of members that are joined already; ``barred(a, b)``: which pairs of positions can't be used.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    dense = np.cumsum(np.r_[0, groups[1:] != groups[:-1]])
    index, out = GrayIndex(codes, dense), []
    # a member's label holds inside its group alone
    label = np.arange(n) if known is None else np.unique(np.stack([dense, known[order]]), axis=1, return_inverse=True)[1].ravel()

    def use(a, b):
        nonlocal label
        if barred is not None and len(a):
            free = ~barred(order[a], order[b])
            a, b = a[free], b[free]
        near = np.argsort(np.bitwise_count(codes[a] ^ codes[b]), kind="stable")
        label, used = _joined(label, a[near], b[near])
        out.append((a[near][used], b[near][used]))

    for turn in (0, 16, 32, 48):
        turned = (codes << np.uint64(turn)) | (codes >> np.uint64((64 - turn) % 64)) if turn else codes
        at = np.lexsort((gray_rank(turned), dense))
        a, b = at[:-1], at[1:]
        near = np.flatnonzero((dense[a] == dense[b]) & (np.bitwise_count(codes[a] ^ codes[b]) <= TIERS[1]))
        use(a[near], b[near])
    within = np.arange(n) - np.searchsorted(dense, dense)
    for r in (*(t for t in TIERS if t < radius), radius):
        # few members of a group at a time: what they join is left out for those that follow, so a large group of copies gives few pairs
        for low, high in ((0, 8), (8, 64), (64, n)):
            q = np.flatnonzero((within >= low) & (within < high))
            for i in range(0, len(q), 1 << 10):
                use(*index.near(q[i : i + (1 << 10)], r, index.uniform(label), label))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return order[a], order[b]
