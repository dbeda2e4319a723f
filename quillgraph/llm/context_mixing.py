"""The language model of operator 4: what a text's decisions are, what predicts each, and how predictions are mixed.

A text is its lower-cased words and an end.  A word is sent as binary decisions: whether it is the
word that most often followed the two words before it in the corpus; else its path in a Huffman
tree of the codebook, which has a leaf for words outside it; for such a word, whether the corpus
has it (then its frequency among such words is its cost), and else its bytes in a second tree.

Every decision has up to three predictions, log odds from counts of hashed contexts.  On a codebook path:
the node alone, and the node after the last short word, which tells the language.  For a
follower: its share of the context's counts, a bias, and how long it has gone well.  In spelling:
the node, the node after one byte, the node after three.  A gate picks the weights that combine
them; within a text the weights of each gate are refined online, and a last stage corrects the
probabilities by how often such ones came true in the text so far.

Signs are turned so that what happened is 1: log odds x for what happened are -x had the other
branch been taken, so nothing that a prediction uses depends on the outcome.
"""

from __future__ import annotations

import numpy as np

from .bpe import spread
from .huffman import code_lengths
from .text import LOWER, mix, rows_of, utf8, word_hash, words_at

#: Symbols: a byte for itself, a word outside the codebook, the end of a text, then the codebook.
NEW, END, FIRST = 256, 257, 258
END_HASH, START_HASH = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
CLASSES = 64
SPELL_BITS = 15
ODDS = 14.0
BUCKETS = 12
#: Levels of a codebook path at most; all are mixed.
LEVELS = 24
#: Depths of a path that gates tell apart; deeper ones share the last gate.
GATED = 7
#: Gates: codebook path by depth (0-2), follower by its run and count (3-11), known word (12), spelling by depth (13-15).
GATES = 16
#: Weights that every text starts with, by gate; refined online in each text.  Parameters, rounded from a fit on a fold of sf0.1 that no figure is of.
PRIOR = np.array([
    [0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0],
    [1.9, -1.2, 0.35], [1.6, -1.8, 0.35], [1.0, -0.95, 0.35],
    [3.0, -0.1, 0.8], [2.0, -0.3, 0.5], [1.3, 0.0, 0.75],
    [3.3, 1.1, 0.13], [2.1, 0.0, 0.05], [1.2, 0.9, 0.06],
    [1.0, 0.0, 0.0],
    [0.0, 0.2, 0.9], [-0.3, 0.15, 0.85], [-1.0, 0.25, 0.65],
], np.float32)


class Tokens:
    """Words and ends of some texts: hash, row, class of the last short word, hash of the two before, and place in the bytes."""

    def __init__(self, column):
        data, offsets = utf8(column)
        self.data = data = LOWER[data]
        starts, ends = words_at(data, offsets)
        row, self.rows = rows_of(starts, offsets), len(offsets) - 1
        count = np.bincount(row, minlength=self.rows)
        total = len(starts) + self.rows
        at = np.arange(len(starts)) + row
        self.row = np.repeat(np.arange(self.rows), count + 1)
        self.first = np.cumsum(count + 1) - (count + 1)
        self.last = self.first + count
        self.hash = np.full(total, END_HASH, np.uint64)
        self.hash[at] = word_hash(data, starts, ends)
        self.start, self.end = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[at], self.end[at] = starts, ends
        self.is_end = np.zeros(total, bool)
        self.is_end[self.last] = True

    def contexts(self) -> np.ndarray:
        """Hash of the two tokens before each."""
        one = np.r_[START_HASH, self.hash[:-1]]
        one[self.first] = START_HASH
        two = np.r_[START_HASH, one[:-1]]
        two[self.first] = START_HASH
        return mix(one * np.uint64(0x9E3779B97F4A7C15) + mix(two + np.uint64(0xA24BAED4963EE407)))

    def classes(self) -> np.ndarray:
        """Class of the last word of at most three bytes before each token of its text; 0 if there is none."""
        size = self.end - self.start
        lead = self.data[np.minimum(self.start, max(len(self.data) - 1, 0))] if len(self.data) else np.zeros(len(size), np.uint8)
        short = (size > 0) & (size <= 3) & ((lead >= 97) & (lead <= 122) | (lead >= 128))
        own = np.where(short, (mix(self.hash) >> np.uint64(40)).astype(np.int64) % (CLASSES - 1) + 1, 0)
        at = np.maximum.accumulate(np.where(short, np.arange(len(size)), -1))
        at = np.r_[-1, at[:-1]]
        return np.where(at >= self.first[self.row], own[np.maximum(at, 0)], 0)

    def spelled(self, which: np.ndarray):
        """(bytes with a space after each word, token of each, one byte before each, slot of three before each)."""
        size = self.end[which] - self.start[which] + 1
        ends = np.cumsum(size)
        begin = ends - size
        text = np.full(int(size.sum()), 32, np.uint8)
        text[spread(begin, size - 1)] = self.data[spread(self.start[which], size - 1)]
        return text, np.repeat(which, size), *before(text, begin)


def before(text: np.ndarray, begin: np.ndarray):
    """(the byte before each, 0 at a word's begin; slot of the three before each)."""
    n = len(text)
    wide = text.astype(np.uint64)
    past = []
    for k in (1, 2, 3):
        p = np.zeros(n, np.uint64)
        p[k:] = wide[:-k] if n > k else wide[:0]
        for j in range(k):
            at = begin + j
            p[at[at < n]] = 0
        past.append(p)
    # a short word's bytes may reach back over its begin by less than k; those are zero too
    word = np.zeros(n, np.int64)
    word[begin[begin < n]] = 1
    own = np.cumsum(word)
    for k in (2, 3):
        if n > k:
            past[k - 1][k:][own[k:] != own[:-k]] = 0
    slot = mix(past[0] | past[1] << np.uint64(8) | past[2] << np.uint64(16)) >> np.uint64(64 - SPELL_BITS)
    return past[0].astype(np.int64), slot.astype(np.int64)


class Tree:
    """A Huffman tree over symbols 0..n-1 with counts of one or more; paths of all symbols one after the other."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.size = code_lengths(counts, limit)
        order = np.lexsort((np.arange(len(counts)), self.size))
        order = order[self.size[order] > 0]
        length = self.size[order]
        space = np.int64(1) << (limit - length)
        code = np.zeros(len(counts), np.int64)
        code[order] = (np.cumsum(space) - space) >> (limit - length)
        self.begin = np.cumsum(self.size) - self.size
        symbol = np.repeat(np.arange(len(counts)), self.size)
        self.depth = np.arange(len(symbol)) - self.begin[symbol]
        rest = self.size[symbol] - self.depth
        key = np.int64(1) << (self.depth + 1) | code[symbol] >> (rest - 1)
        self.bit = (key & 1).astype(bool)
        self.symbol = symbol
        nodes, self.child = np.unique(key, return_inverse=True)
        parents, self.node = np.unique(key >> 1, return_inverse=True)
        self.nodes = len(parents)
        self.zero, self.one = (np.searchsorted(nodes, parents << 1 | b) for b in (0, 1))
        self.has_one = nodes[np.minimum(self.one, len(nodes) - 1)] == (parents << 1 | 1) if len(nodes) else np.zeros(0, bool)
        self.children = len(nodes)

    def branches(self, counts: np.ndarray):
        """Counts of the two branches of each node."""
        total = np.bincount(self.child, weights=counts[self.symbol].astype(float), minlength=self.children)
        return total[self.zero], np.where(self.has_one, total[np.minimum(self.one, max(self.children - 1, 0))], 0.0)


class Model:
    """What the corpus taught, small enough to broadcast: its size depends on the codebook only."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, least: int, n_tokens: int, n_kinds: int, n_ends: int, n_single: int, classed: np.ndarray, spelling: tuple[np.ndarray, np.ndarray]):
        """words, counts: codebook hashes (sorted) and training counts, ``least`` or more each; n_single: words that occur once;
        classed: (CLASSES x symbols) counts of all symbols; spelling: counts after one byte and after three.

        A training token is judged by the corpus without it, so a word that occurs ``least`` times is outside the
        codebook for it, and one that occurs once is unknown: which is how often the words of other texts are.
        """
        self.words, self.least, self.n_tokens, self.n_kinds = words, least, n_tokens, n_kinds
        known = np.r_[counts, 0, 0].astype(float)
        self.n_rare = max(n_tokens - n_ends - int(counts.sum()), 0) + least
        outside = self.n_rare - least + int(counts[counts == least].sum())
        self.single = min((n_single + 0.5) / (outside + 1.0), 0.999)
        known[-2:] = outside, n_ends  # NEW and END stand after the codebook here
        self.tree = tree = Tree(known + 1, LEVELS)
        zero, one = tree.branches(known + 1)
        hit, miss = np.where(tree.bit, one[tree.node], zero[tree.node]), np.where(tree.bit, zero[tree.node], one[tree.node])
        # odds of each step for other texts, then for a training text, without the word's own occurrence
        odds = [np.log(hit) - np.log(miss), np.log(np.maximum(hit - 1, 0.3)) - np.log(miss)]
        self.paths = len(tree.bit)
        self.odds = np.concatenate(odds).astype(np.float32)
        self.turn = np.where(tree.bit, 1 / ODDS, -1 / ODDS).astype(np.float32)
        self.by_class = np.zeros((CLASSES, tree.nodes), np.int8)
        p = one / np.maximum(one + zero, 1e-9)
        for c in range(CLASSES):
            z, o = tree.branches(classed[c])
            self.by_class[c] = steps(o + 16 * p, z + 16 * (1 - p))
        self.bytes = Tree(np.asarray(spelling[0]).sum(axis=0) + 1.0, 16)
        self.byte_odds = []
        z, o = self.bytes.branches(np.asarray(spelling[0]).sum(axis=0) + 1.0)
        self.byte_zero = (np.log(o) - np.log(z)).astype(np.float32)
        p = o / (o + z)
        member = np.zeros((2, self.bytes.nodes, 256))
        member[self.bytes.bit.astype(int), self.bytes.node, self.bytes.symbol] = 1
        one1 = spelling[0] @ member[1].T + 2 * p
        zero1 = spelling[0] @ member[0].T + 2 * (1 - p)
        self.byte_one = steps(one1, zero1)
        # the byte before is not part of a slot's name, so slots lean on the node alone
        self.byte_three = np.zeros((1 << SPELL_BITS, self.bytes.nodes), np.int8)
        for i in range(0, 1 << SPELL_BITS, 1 << 12):
            part = spelling[1][i : i + (1 << 12)]
            self.byte_three[i : i + (1 << 12)] = steps(part @ member[1].T + 0.5 * p, part @ member[0].T + 0.5 * (1 - p))
        self.byte_nodes = self.bytes.nodes
        tree.depth = np.minimum(tree.depth, GATED)
        for t in (self.tree, self.bytes):
            del t.child, t.symbol, t.zero, t.one, t.has_one

    @property
    def tail(self) -> np.ndarray:
        """What each symbol costs after each class beside the decisions on its path: nothing, as the whole path is mixed."""
        return np.broadcast_to(np.float32(0), (CLASSES, len(self.words) + 2))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Leaf of each hash: its place in the codebook, or that of NEW, or of END."""
        n = len(self.words)
        out = np.full(len(hashes), n, np.int64)
        if n:
            at = np.minimum(np.searchsorted(self.words, hashes), n - 1)
            out = np.where(self.words[at] == hashes, at, n)
        out[hashes == END_HASH] = n + 1
        return out

    def leaves(self, symbol: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The leaves of tokens of which the corpus has ``left`` others: NEW for those below the codebook's least."""
        n = len(self.words)
        return np.where((symbol < n) & (left < self.least), n, symbol)


def steps(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Log odds in steps of 1 / ODDS, in a byte."""
    return np.clip(np.rint((np.log(one) - np.log(zero)) * ODDS), -127, 127).astype(np.int8)


def followers(fp: np.ndarray, train: np.ndarray, total: np.ndarray, top: np.ndarray, top_count: np.ndarray):
    """(has one, came true, its count, count of the others) without each token's own occurrence in a training text."""
    same = fp == top
    total = total - train
    left = top_count - (same & train)
    has = total > 0
    count = np.maximum(left, 1)
    return has, has & same & (left > 0), count, np.maximum(total - count, 0)


def decisions(t: Tokens, model: Model, a: int, b: int, symbol, count, train, follow, run):
    """(x of three predictions, gate, tokens' first decision, tokens' cost outside the decisions) of tokens a to b.

    symbol, count, train: of each token of ``t``; follow: as from ``followers``; run: how long followers have come true.
    """
    own = slice(a, b)
    has, true, n_top, n_other = (x[own] for x in follow)
    symbol, train, count, run = symbol[own], train[own], count[own], run[own]
    n_book = len(model.words)
    path = np.where(true, 0, model.tree.size[symbol])
    new = ~true & (symbol == n_book)
    left = count - train
    known = new & (left > 0) & (model.n_rare > 0)
    spell = new & ~known
    word = np.flatnonzero(spell) + a
    text, owner, one, three = t.spelled(word)
    bits = model.bytes.size[text]
    spelled = np.bincount(owner - a, weights=bits, minlength=b - a).astype(np.int64)
    size = has + path + new + spelled
    begin = np.cumsum(size) - size
    total = int(size.sum())
    x, gate = np.zeros((3, total), np.float32), np.zeros(total, np.int8)
    at = begin[has]
    sign = np.where(true[has], np.float32(1), np.float32(-1))
    reach = np.minimum(run[has], 8)
    x[0, at] = sign * np.log((n_top[has] + np.float32(0.2)) / (n_other[has] + np.float32(0.8)))
    x[1, at] = sign
    x[2, at] = sign * reach
    gate[at] = 3 + 3 * np.minimum(reach, 2) + np.minimum(n_top[has], 3) - 1
    walk = np.flatnonzero(path)
    at = spread(begin[walk] + has[walk], path[walk])
    e = spread(model.tree.begin[symbol[walk]], path[walk])
    token = np.repeat(walk, path[walk])
    x[0, at] = model.odds.take(e + train[token] * model.paths)
    x[1, at] = model.by_class.take((t.kind[own] * model.tree.nodes)[token] + model.tree.node.take(e)) * model.turn.take(e)
    gate[at] = np.array([0, 0, 1, 1, 1, 1, 2, 2], np.int8).take(model.tree.depth.take(e))
    at = (begin + has + path)[new]
    sign = np.where(known[new], np.float32(1), np.float32(-1))
    x[0, at] = sign * np.float32(np.log(1 - model.single) - np.log(model.single))
    x[1, at] = sign
    gate[at] = 12
    if len(word):
        e = spread(model.bytes.begin[text], bits)
        letter = np.repeat(np.arange(len(text)), bits)
        at = spread((begin + has + path + new)[word - a], spelled[word - a])
        turned = np.where(model.bytes.bit[e], np.float32(1), np.float32(-1))
        node = model.bytes.node[e]
        x[0, at] = model.byte_zero[node] * turned
        x[1, at] = model.byte_one[one[letter], node] * turned * np.float32(1 / ODDS)
        x[2, at] = model.byte_three[three[letter], node] * turned * np.float32(1 / ODDS)
        gate[at] = 13 + np.searchsorted([2, 5], model.bytes.depth[e], "right")
    outside = np.zeros(b - a)
    outside[known] += np.log(left[known] / max(model.n_rare, 1))
    return x, gate, begin, size, outside


class State:
    """What the mixing has learned in each of some texts: weights by gate (one more for empty places), corrections by sureness."""

    def __init__(self, lanes: int):
        self.weights = np.ascontiguousarray(np.repeat(np.vstack([PRIOR, np.zeros((1, 3), np.float32)]).T[:, None], lanes, axis=1))
        self.hits, self.seen = (np.zeros((lanes, BUCKETS)) for _ in range(2))


def step_sizes(total: int):
    """(first, end) of the stretches between two refinements: they depend on the place in the text alone."""
    t = 0
    while t < total:
        size = 64 if t < 1 << 13 else 256 if t < 1 << 16 else 1024
        yield t, min(t + size, total)
        t += size


def mixed(x: np.ndarray, gate: np.ndarray, lengths: np.ndarray, state: State, done: int = 0, rate: float = 0.01, calm: float = 200.0) -> np.ndarray:
    """Log probability of each decision's outcome; ``lengths``: decisions of each text, one after the other.

    ``done``: decisions before these, for the pieces of one long text.
    """
    lanes, total = len(lengths), x.shape[1]
    out = np.zeros(total, np.float32)
    if not total:
        return out
    # shortest first, so that those which go on are a slice; texts of about one length waste no places
    order = np.argsort(lengths, kind="stable")
    size, most = lengths[order], int(lengths.max())
    begin = (np.cumsum(lengths) - lengths)[order]
    wide_x, wide_g = np.zeros((3, lanes, most), np.float32), np.full((lanes, most), GATES, np.int32)
    for k, (b, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
        wide_x[:, k, :n] = x[:, b : b + n]
        wide_g[k, :n] = gate[b : b + n]
    wide_g += np.arange(lanes, dtype=np.int32)[:, None] * (GATES + 1)
    weights, hits, seen = state.weights[:, order].reshape(3, -1), state.hits[order].reshape(-1), state.seen[order].reshape(-1)
    base = np.arange(lanes, dtype=np.int32)[:, None] * BUCKETS
    result = np.zeros((lanes, most), np.float32)
    for i, j in step_sizes(done + most):
        if j <= done:
            continue
        i, j = max(i - done, 0), j - done
        a = int(np.searchsorted(size, i, "right"))
        w, part = wide_g[a:, i:j], wide_x[:, a:, i:j]
        logit = weights[0].take(w)
        logit *= part[0]
        logit += weights[1].take(w) * part[1]
        logit += weights[2].take(w) * part[2]
        sure = np.abs(logit)
        np.minimum(sure, 20, out=sure)
        bucket = np.minimum(sure * 2, BUCKETS - 1).astype(np.int32)
        bucket += base[a:]
        np.negative(sure, out=sure)
        doubt = np.exp(sure)
        np.reciprocal(1 + doubt, out=sure)
        doubt *= sure
        true = logit >= 0
        # how often such decisions came true here, beyond what was said; the doubt is at most halved
        lack = doubt - (hits / (seen + calm)).astype(np.float32).take(bucket)
        np.maximum(lack, doubt / 2, out=lack)
        np.minimum(lack, np.float32(0.99), out=lack)
        result[a:, i:j] = np.log(np.where(true, 1 - lack, lack))
        miss = np.where(true, doubt, sure)
        if j > size[a]:  # empty places count nowhere
            bucket[w - (np.arange(a, lanes, dtype=np.int32) * (GATES + 1))[:, None] == GATES] = len(hits)
        flat = w.ravel()
        for k in range(3):
            weights[k] += np.float32(rate) * np.bincount(flat, weights=(miss * part[k]).ravel(), minlength=weights.shape[1]).astype(np.float32)
        bucket = bucket.ravel()
        hits += np.bincount(bucket, weights=np.where(true, doubt, -sure).ravel(), minlength=len(hits) + 1)[:-1]
        seen += np.bincount(bucket, minlength=len(hits) + 1)[:-1]
    state.weights[:, order], state.hits[order], state.seen[order] = weights.reshape(3, lanes, -1), hits.reshape(lanes, -1), seen.reshape(lanes, -1)
    for k, (b, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
        out[b : b + n] = result[k, :n]
    return out


def runs(first: np.ndarray, row: np.ndarray, has: np.ndarray, true: np.ndarray) -> np.ndarray:
    """How many followers in a row have come true just before each token, in its text."""
    n = len(row)
    broken = np.maximum.accumulate(np.where(has & true, -1, np.arange(n)))
    broken = np.r_[-1, broken[:-1]]
    return np.arange(n) - 1 - np.maximum(broken, first[row] - 1)


def costs(t: Tokens, model: Model, symbol, count, train, follow, piece: int = 1 << 17, rate: float = 0.01, calm: float = 200.0) -> np.ndarray:
    """Natural log probability of each token.  Several texts must have at most ``piece`` tokens together; one alone may have any number."""
    symbol = model.leaves(symbol, count - train)
    t.kind = t.classes()
    run = runs(t.first, t.row, follow[0], follow[1])
    out = np.zeros(len(t.hash))
    state = State(t.rows)
    if t.rows == 1:
        done, a, held = 0, 0, None
        while a < len(t.hash):
            b = min(a + piece, len(t.hash))
            x, gate, begin, size, outside = decisions(t, model, a, b, symbol, count, train, follow, run)
            log = mixed(x, gate, np.array([x.shape[1]]), state, done, rate, calm)
            out[a:b] = outside + np.bincount(np.repeat(np.arange(b - a), size), weights=log, minlength=b - a)
            done, a = done + x.shape[1], b
        return out
    x, gate, begin, size, outside = decisions(t, model, 0, len(t.hash), symbol, count, train, follow, run)
    lengths = np.bincount(t.row, weights=size, minlength=t.rows).astype(np.int64)
    log = mixed(x, gate, lengths, state, 0, rate, calm)
    return outside + np.bincount(np.repeat(np.arange(len(size)), size), weights=log, minlength=len(size))
