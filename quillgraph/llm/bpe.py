"""Byte-pair encoding of whole batches of distinct pre-tokens at once, exact to the library's ids.

Texts are cut at ASCII white space, the words of a batch are deduplicated, the distinct ones are
cut into pre-tokens, and the distinct pre-tokens are merged together: each round applies, in every
pre-token that still has one, the leftmost pair of lowest rank.  Words outside the simple
alphabet (ASCII and the letters of Latin-1) go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import rows_of, utf8, words_at

#: The pre-token patterns of the two vocabularies, restricted to the simple alphabet; a line feed parts words.
WORD_PATTERN = r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"
BYTE_PATTERN = r"\n|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+"
SIMPLE = r"^[!-~À-ÖØ-öø-ÿ]{1,48}$"
LONGEST = 48
#: Bytes of words and their ids that a worker remembers.
REMEMBERED = 12 << 20
_NONE = np.int64(1 << 62)


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + i)] = b
    return table


class Vocabulary:
    """A tokenizers file with its merges as a vectorised hash table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.largest = max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.lower = bool(self.suffix)
        self.pattern = re.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        of = {b: c for c, b in byte_alphabet().items()}
        self.first = np.array([self.vocab[of[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[of[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self._index(left << 20 | right)
        self.single = self._prove()
        self.seen = _none_seen()

    def _index(self, keys: np.ndarray) -> None:
        self.bits = 19
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, _NONE, np.int64)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.slot_key[at[rest]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], put
            rest = np.setdiff1d(rest, put)
            at[rest] = (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or a value above all ranks."""
        keys = left << 20 | right
        at = self._slot(keys)
        found, out = self.slot_key[at], self.slot_rank[at]
        odd = np.flatnonzero((found != keys) & (found >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[odd]]
            out[odd] = self.slot_rank[at[odd]]
            odd = odd[(found != keys[odd]) & (found >= 0)]
        return out

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[offsets[i]:offsets[i+1]] (none empty), and their offsets."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        sym = self.first[data]
        ends = offsets[1:] - 1
        sym[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(n), lengths)
        done_sym, done_owner = [], []
        rank = np.full(len(sym), _NONE, np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else owner
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            key = np.minimum((rank << 32) | np.arange(len(sym)), _NONE) if len(sym) < (1 << 31) else None
            best = np.minimum.reduceat(np.where(rank == _NONE, _NONE, key), start)
            live = best < _NONE
            if not live.all():
                sizes = np.diff(np.r_[start, len(sym)])
                over = np.repeat(~live, sizes)
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                keep = ~over
                moved = np.cumsum(keep) - 1
                at = moved[best[live] & 0xFFFFFFFF]
                r = best[live] >> 32
                sym, owner, rank = sym[keep], owner[keep], rank[keep]
            else:
                at, r = best & 0xFFFFFFFF, best >> 32
            if not len(sym):
                break
            sym[at] = self.made[r]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = _NONE
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at = at - np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                p = p[p + 1 < len(sym)]
                same = owner[p] == owner[p + 1]
                rank[p[~same]] = _NONE
                p = p[same]
                rank[p] = self.ranks(sym[p], sym[p + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        out = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=n), out=out[1:])
        return sym[order], out

    def _prove(self) -> dict[bytes, int]:
        """Vocabulary strings that, as a pre-token, encode to their own single id (the whole-token table)."""
        back = byte_alphabet()
        names, ids = [], []
        for name, i in self.vocab.items():
            body = name[: len(name) - len(self.suffix)] if self.suffix and name.endswith(self.suffix) else (name if not self.suffix else "")
            if body and name not in self.special and all(c in back for c in body):
                names.append(bytes(back[c] for c in body))
                ids.append(i)
        sizes = np.array([len(x) for x in names])
        flat, at = self.merge(np.frombuffer(b"".join(names), np.uint8), np.r_[0, np.cumsum(sizes)])
        one = np.diff(at) == 1
        first = flat[at[:-1]]
        return {name: i for name, i, ok, got in zip(names, ids, one.tolist(), first.tolist(), strict=True) if ok and got == i}

    def pieces(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct pre-tokens: whole tokens by the table, the rest by merging."""
        n = len(tokens)
        whole = np.fromiter((self.single.get(t, -1) for t in tokens), np.int64, n)
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(n, np.int64)
        flat = at = None
        if len(rest):
            body = [tokens[i] for i in rest.tolist()]
            sizes = np.fromiter(map(len, body), np.int64, len(body))
            flat, at = self.merge(np.frombuffer(b"".join(body), np.uint8), np.r_[0, np.cumsum(sizes)])
            counts[rest] = np.diff(at)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        ids = np.empty(offsets[-1], np.int64)
        hit = np.flatnonzero(whole >= 0)
        ids[offsets[hit]] = whole[hit]
        if len(rest):
            ids[spread(offsets[rest], counts[rest])] = flat
        return ids, offsets

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words; words of the last few MB are remembered, the others are encoded."""
        n = len(words)
        seen, seen_ids, seen_at = self.seen
        at = pc.index_in(words, value_set=seen)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(~hit))
        ids, offsets = self.encode(new)
        known = at.drop_null().to_numpy().astype(np.int64)
        sizes = np.zeros(n, np.int64)
        sizes[hit], sizes[~hit] = seen_at[known + 1] - seen_at[known], np.diff(offsets)
        result = np.zeros(n + 1, np.int64)
        np.cumsum(sizes, out=result[1:])
        flat = np.empty(result[-1], np.int64)
        flat[spread(result[:-1][hit], sizes[hit])] = seen_ids[spread(seen_at[known], sizes[hit])]
        flat[spread(result[:-1][~hit], sizes[~hit])] = ids
        if seen.nbytes + seen_ids.nbytes > REMEMBERED:
            self.seen = _none_seen()
            seen, seen_ids, seen_at = self.seen
        self.seen = pa.concat_arrays([seen, new.cast(pa.string())]), np.concatenate([seen_ids, ids.astype(np.int32)]), np.concatenate([seen_at, seen_at[-1] + offsets[1:]])
        return flat, result

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words; in a byte vocabulary a word may start with one space."""
        n = len(words)
        if self.lower:
            simple = pc.match_substring_regex(words, SIMPLE)
        else:
            simple = pc.match_substring_regex(words, SIMPLE.replace("^", "^ ?"))
        for name in self.special:
            simple = pc.and_(simple, pc.invert(pc.match_substring(words, name)))
        simple = simple.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(simple)
        text = "\n".join(words.take(pa.array(at)).to_pylist()) if len(at) else ""
        found = self.pattern.findall(text.lower() if self.lower else text)
        coded = pa.array(found, pa.string()).dictionary_encode()
        names = [x.encode() for x in coded.dictionary.to_pylist()]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        brk = names.index(b"\n") if b"\n" in names else -1
        solid = [x for x in names if x != b"\n"]
        ids, offsets = self.pieces(solid)
        if brk >= 0:
            offsets = np.insert(offsets, brk + 1, offsets[brk])
        parts = code != brk
        word = np.cumsum(~parts)[parts]
        sizes = np.diff(offsets)[code[parts]] if len(code) else np.zeros(0, np.int64)
        out_flat = ids[spread(offsets[:-1][code[parts]], sizes)] if len(sizes) else np.zeros(0, np.int64)
        counts = np.zeros(n, np.int64)
        if len(at):
            counts[at] = np.bincount(word, weights=sizes, minlength=len(at)).astype(np.int64)
        odd = np.flatnonzero(~simple)
        odd_ids = []
        if len(odd):
            strings = words.take(pa.array(odd)).to_pylist()
            for i in range(0, len(odd), 2000):
                odd_ids += [e.ids for e in self.library.encode_batch_fast(strings[i : i + 2000], add_special_tokens=False)]
            counts[odd] = [len(x) for x in odd_ids]
        result = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=result[1:])
        flat = np.empty(result[-1], np.int64)
        if len(at):
            flat[spread(result[at], counts[at])] = out_flat
        for i, x in zip(odd.tolist(), odd_ids, strict=True):
            flat[result[i] : result[i + 1]] = x
        return flat, result


def _none_seen() -> tuple:
    """No words: their strings, ids and offsets."""
    return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start and size, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


_LOADED: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_texts(vocab: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of each text (nulls are empty) under a vocabulary that drops white space."""
    column = pc.fill_null(column, "")
    split = pc.ascii_split_whitespace(column)
    words = split.flatten()
    counts = np.diff(split.offsets.to_numpy())
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    coded = words.dictionary_encode()
    flat, at = vocab.words(coded.dictionary)
    code = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)[code]
    ids = flat[spread(at[:-1][code], sizes)]
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return ids, ends[offsets]


def count_texts(vocab: Vocabulary, column: pa.Array) -> np.ndarray:
    """Number of ids of each text (nulls are empty) under a byte-level vocabulary that keeps white space.

    A run of ASCII white space gives its last space to the next word and is a pre-token without
    it; texts with other white space, or with white space before a special string (at which the
    library cuts first, so that such a run stays whole), are left to the library as a whole.
    """
    column = pc.fill_null(column, "")
    n = len(column)
    out = np.zeros(n, np.int64)
    # U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000: white space in several bytes
    odd = pc.match_substring_regex(column, "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").to_numpy(zero_copy_only=False)
    for name in vocab.special:
        odd = odd | pc.match_substring_regex(column, "[\\x09-\\x0d\\x20]" + re.escape(name)).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(odd).tolist():
        out[i] = len(vocab.library.encode(column[i].as_py(), add_special_tokens=False).ids)
    rows = np.flatnonzero(~odd)
    column = column.take(pa.array(rows))
    data, offsets = utf8(column)
    if not len(data):
        return out
    starts, ends = words_at(data, offsets)
    row = rows_of(starts, offsets)
    total = np.zeros(len(rows), np.int64)
    if len(starts):
        first = np.r_[True, row[1:] != row[:-1]]
        gap_from = np.where(first, offsets[row], np.r_[0, ends[:-1]])
        spaced = (starts > gap_from) & (data[np.maximum(starts - 1, 0)] == 32)
        words = pa.StringArray.from_buffers(len(starts), *_strings(data, starts, ends)).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + spaced
        kinds, inverse = np.unique(code, return_inverse=True)
        plain = words.dictionary.take(pa.array(kinds >> 1))
        space = pa.array(np.where(kinds & 1, " ", "")).cast(pa.string())
        _, at = vocab.words(pc.binary_join_element_wise(space, plain, ""))
        total += np.bincount(row, weights=np.diff(at)[inverse], minlength=len(rows)).astype(np.int64)
        # white space before a word: its last character stands alone unless it is a space, the others are one pre-token
        lone = (starts > gap_from) & ~spaced
        total += np.bincount(row[lone], minlength=len(rows))
        long = np.flatnonzero(starts - gap_from > 1)
        total += np.bincount(row[long], weights=_spaces(vocab, data, gap_from[long], starts[long] - 1), minlength=len(rows)).astype(np.int64)
    final = offsets[:-1].copy()
    if len(starts):
        np.maximum.at(final, row, ends)
    tail = np.flatnonzero(final < offsets[1:])
    total[tail] += _spaces(vocab, data, final[tail], offsets[1:][tail])
    out[rows] = total
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """Arrow buffers of the spans as one string array."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    body = data[spread(starts, sizes)]
    return pa.py_buffer(offsets), pa.py_buffer(body)


def _spaces(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of ids of each run of white space."""
    runs = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    known = list(dict.fromkeys(runs))
    short = [x for x in known if len(x) <= LONGEST]
    sizes = {}
    if short:
        _, at = vocab.pieces(short)
        sizes = dict(zip(short, np.diff(at).tolist(), strict=True))
    for x in known:
        if len(x) > LONGEST:
            sizes[x] = len(vocab.library.encode(x.decode(), add_special_tokens=False).ids)
    return np.array([sizes[x] for x in runs], np.int64)
