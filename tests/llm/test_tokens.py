"""Token counts, token files and packing against the library itself."""

import random
import zlib
from collections import Counter, defaultdict

import helpers as h
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import bpe, packing, token_counts, token_files
from quillgraph.llm.common import tokenizer_path
from quillgraph.llm.huffman import Code, code_lengths
from quillgraph.plans import scratch

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    alphabet = "aàé A1'\n \t.,ßZ<|>endoftext½ 世ÿ÷×µ "
    return h.texts() + [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(300)]


def test_counts(spark, rows):
    lib = Tokenizer.from_file(BYTE)
    want = []
    for d, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    got = token_counts.count_tokens(h.table(spark, rows), BYTE)
    assert h.keyed(got, ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == sorted(want, key=str)
    assert token_counts.count_tokens(h.empty(spark), BYTE).count() == 0


def test_counts_beside_special_strings():
    """Special strings next to every kind of white space, words, and each other."""
    vocab, rng = bpe.load(BYTE), random.Random(9)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "a", "foo", "B1", "'s", "<|", "|>", "é", "世", ".", "12"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else parts[0] for _ in range(rng.randint(1, 9))) for _ in range(60_000)]
    want = [len(e.ids) for e in vocab.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert bpe.count_texts(vocab, pa.array(texts)).tolist() == want


def test_larger_ids_are_refused(spark):
    """The file format takes 16-bit ids; an end id beyond them raises before anything is written."""
    with pytest.raises(Exception, match="16-bit"):
        token_files.write(h.table(spark, [(1, "a")]), scratch.new_path(spark, "test-tokens"), WORD, end_id=1 << 16)


def test_whole_token_table_is_proven():
    vocab = bpe.load(BYTE)
    some = random.Random(1).sample(sorted(vocab.single), 500)
    back = {v: k for k, v in bpe.byte_alphabet().items()}
    for token in some:
        assert [x.id for x in vocab.library.model.tokenize("".join(back[b] for b in token))] == [vocab.single[token]]


def test_huffman_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        ids = np.minimum(rng.zipf(1.3, n), 60000).astype(np.int64)
        lengths = code_lengths(np.bincount(ids, minlength=1 << 16))
        code = Code(lengths)
        assert (code.decode(code.encode(ids)) == ids).all()
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765])
    lengths = code_lengths(fib, 6)
    assert lengths.max() == 6 and (2.0 ** -lengths).sum() <= 1
    free = code_lengths(fib, 16)
    assert (fib * free).sum() <= (fib * lengths).sum()


def test_files(spark, rows):
    lib = Tokenizer.from_file(WORD)
    path = scratch.new_path(spark, "test-tokens")
    token_files.write(h.table(spark, rows), path, WORD, block_ids=300)
    got = token_files.read(spark, path).collect()
    want = Counter((d, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    path = scratch.new_path(spark, "test-tokens")
    token_files.write(h.empty(spark), path, WORD)
    assert token_files.read(spark, path).count() == 0


def test_packing(spark, rows):
    lib = Tokenizer.from_file(WORD)
    got = packing.pack(h.table(spark, rows), WORD, capacity=64, with_ids=True).collect()
    want = Counter()
    for d, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    packed(got, 64)
    assert packing.pack(h.empty(spark), WORD).count() == 0


def packed(rows, capacity):
    """Sequences have no gaps; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def fewest(sizes, capacity):
    """Optimal number of bins of a few items, by search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                place(i + 1, bins)
                bins[b] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    threes = 0
    for _ in range(600):
        sizes = sorted((rng.randint(rng.choice([1, 4]), 20) for _ in range(rng.randint(1, 9))), reverse=True)
        count = Counter(sizes)
        fixed = packing.reduce_dominated(count, 20)
        threes += any(sum(k for _, k in content) == 3 for content, _ in fixed)
        assert all(sum(x * k for x, k in content) <= 20 for content, _ in fixed)
        rest = [x for x, n in count.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(sorted(rest, reverse=True), 20) == fewest(sizes, 20)
    assert threes > 20
