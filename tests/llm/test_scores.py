"""Toxicity, language-model scores, quality rules and archives."""

import base64
import hashlib
import io
import math
import random
import re
import uuid
import zlib
from collections import Counter

import duckdb
import helpers as h
import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import context_mixing, lm_scoring, quality, toxicity, warc
from quillgraph.llm.text import SpanHash


def test_toxicity_holds_out(spark):
    rng = random.Random(0)
    bad = ["vile", "awful", "rotten"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice(["good", "plain", "day", "tree", "river", "stone", "light"]) for _ in range(40)]
        if toxic:
            words[rng.randint(0, 39)] = rng.choice(bad) + rng.choice(["", ",", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(0, 1), (None, 1), (7, None), (100_000, 1)]
    label_table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = h.table(spark, rows + h.texts())
    model = toxicity.fit(docs, toxicity.learnable(label_table))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(h.texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = {r["doc_id"]: r["predicted"] for r in toxicity.score(h.table(spark, rows), model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([held[i] == int(i % 4 == 0) for i in held]) > 0.97
    again = toxicity.fit(docs.repartition(5), toxicity.learnable(label_table))
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_weights_one_by_one(spark):
    """The learned weights and scores against follow-the-regularised-leader over dictionaries, one coordinate at a time."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["vile", "plain", "day", "tree", "Rotten,", "naïve", "x1"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id long, toxic int")
    alpha, beta, l1, l2, bits = 0.7, 1.0, 0.4, 0.5, 14
    index, weight, bias = toxicity.fit(h.table(spark, rows), labels, bits=bits, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)

    def grams(text):
        from quillgraph.llm.text import utf8

        return sorted(set(toxicity.features(*utf8(pa.array([text])), bits)[1].tolist()))

    z, n, bias_z, bias_n = Counter(), Counter(), 0.0, 0.0
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for _, text, y in sorted((d * 0x9E3779B97F4A7C15 % (1 << 64), t, int("vile" in t)) for d, t in rows):
            own = grams(text)
            now = {i: w(i) for i in own}
            b = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            g = 1 / (1 + math.exp(-(sum(now.values()) + b))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * now[i]
                n[i] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    b = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
    want = {i: w(i) for i in z if w(i)}
    assert dict(zip(index.tolist(), weight.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(b)
    assert 0 < len(want) < len(z)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(h.table(spark, rows), (index, weight, bias), bits=bits).collect()}
    assert scores == pytest.approx({d: 1 / (1 + math.exp(-(sum(want.get(i, 0) for i in grams(t)) + b))) for d, t in rows})


def test_toxicity_without_labels(spark):
    docs = h.table(spark, h.texts())
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(h.empty(spark), model).count() == 0


def test_span_hash():
    data = np.frombuffer(b"abcabcab" * 3, np.uint8)
    s = SpanHash(data)
    assert s(np.array([0]), np.array([3])) == s(np.array([3]), np.array([6])) != s(np.array([1]), np.array([4]))


def test_lm_base_scores(spark):
    rows = h.texts(3)
    got = lm_scoring.score(h.table(spark, rows), unit_bytes=4000).collect()
    tokens = [[*h.words(t), "\0end"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for t, x in zip(tokens, held, strict=True) if not x for w in t)
    n, kinds = counts.total(), len(counts)
    want = Counter((d, x, len(t), sum(w in counts for w in t), n, round(sum(math.log10(counts[w] + 1) for w in t) - len(t) * math.log10(n + kinds + 1), 6)) for (d, _), t, x in zip(rows, tokens, held, strict=True))
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score(h.empty(spark)).count() == 0


def tokens_of(text):
    return context_mixing.Tokens(pa.array([text], pa.string()))


def plain_model(rows, held, bits):
    """(model, count of each word, followers of each two words) from dictionaries."""
    counts, after, classed, letters = Counter(), {}, Counter(), (np.zeros((256, 256)), np.zeros((1 << context_mixing.SPELL_BITS, 256)))
    seen = [t for (_, t), x in zip(rows, held, strict=True) if not x]
    for text in seen:
        t = tokens_of(text)
        counts.update(t.hash.tolist())
        for h, c in zip(t.hash.tolist(), (t.contexts() >> np.uint64(64 - bits)).tolist(), strict=True):
            after.setdefault(c, Counter())[h >> 24 & 0xFFFF] += 1
    end = int(context_mixing.END_HASH)
    book = sorted(h for h, n in counts.items() if n > 1 and h != end)
    place, done = {h: i for i, h in enumerate(book)}, set()
    for text in seen:
        t = tokens_of(text)
        for i, (h, c) in enumerate(zip(t.hash.tolist(), t.classes().tolist(), strict=True)):
            classed[c, place.get(h, len(book) + (h == end))] += 1
            if h not in place and h != end and h not in done:
                done.add(h)
                word = bytes(t.data[t.start[i] : t.end[i]]) + b" "
                _, slots = context_mixing.before(np.frombuffer(word, np.uint8), np.array([0]))
                for k, b in enumerate(word):
                    letters[0][word[k - 1] if k else 0, b] += 1
                    letters[1][slots[k], b] += 1
    table = np.zeros((context_mixing.CLASSES, len(book) + 2))
    for (c, leaf), n in classed.items():
        table[c, leaf] = n
    own = np.array([counts[h] for h in book], np.int64)
    return context_mixing.Model(np.array(book, np.uint64), own, 2, counts.total(), len(counts), counts[end], sum(n == 1 for n in counts.values()), table, letters), counts, after


def plain_score(text, train, model, counts, after, bits, rate, calm):
    """log10 probability of a text, one decision after the other."""
    t, n_book = tokens_of(text), len(model.words)
    place = {h: i for i, h in enumerate(model.words.tolist())}
    weights, hits, seen = model_weights(), np.zeros(context_mixing.BUCKETS), np.zeros(context_mixing.BUCKETS)
    waiting, total, run, done = [], 0.0, 0, 0
    sigma = lambda v: 1 / (1 + math.exp(-v))

    def decide(gate, *x):
        nonlocal total, done
        logit = sum(a * b for a, b in zip(weights[gate], x, strict=True))
        sure, bucket = sigma(min(abs(logit), 20)), min(int(min(abs(logit), 20) * 2), context_mixing.BUCKETS - 1)
        lack = min(max(1 - sure - hits[bucket] / (seen[bucket] + calm), (1 - sure) / 2), 0.99)
        total += math.log(1 - lack if logit >= 0 else lack)
        waiting.append((gate, x, 1 - sure if logit >= 0 else sure, bucket, 1 - sure if logit >= 0 else -sure))
        if len(waiting) == (64 if done < 1 << 13 else 256 if done < 1 << 16 else 1024):
            done += len(waiting)
            for g, v, miss, b, odd in waiting:
                for k in range(3):
                    weights[g][k] += rate * miss * v[k]
                hits[b] += odd
                seen[b] += 1
            waiting.clear()

    for i, (h, c, kind) in enumerate(zip(t.hash.tolist(), (t.contexts() >> np.uint64(64 - bits)).tolist(), t.classes().tolist(), strict=True)):
        own, found = h >> 24 & 0xFFFF, after.get(c, Counter())
        most = min(found, key=lambda f: (-found[f], f)) if found else None
        others = found.total() - train
        true = False
        if found and others > 0:
            left = found[most] - (train and own == most)
            true, n = own == most and left > 0, max(left, 1)
            sign, reach = 1 if true else -1, min(run, 8)
            decide(3 + 3 * min(reach, 2) + min(n, 3) - 1, sign * math.log((n + 0.2) / (max(others - n, 0) + 0.8)), sign, sign * reach)
        run = run + 1 if true else 0
        if true:
            continue
        left = counts[h] - train
        leaf = n_book + 1 if h == int(context_mixing.END_HASH) else place.get(h, n_book)
        leaf = n_book if leaf < n_book and left < model.least else leaf
        tree = model.tree
        for e in range(tree.begin[leaf], tree.begin[leaf] + min(tree.size[leaf], context_mixing.LEVELS)):
            decide([0, 0, 1, 1, 1, 1, 2, 2][tree.depth[e]], model.odds[e + train * model.paths], model.by_class[kind, tree.node[e]] / context_mixing.ODDS * (1 if tree.bit[e] else -1), 0)
        total += model.tail[kind, leaf]
        if leaf == n_book:
            known = left > 0
            decide(12, (1 if known else -1) * math.log((1 - model.single) / model.single), 1 if known else -1, 0)
            if known:
                total += math.log(left / model.n_rare)
                continue
            word = np.frombuffer(bytes(t.data[t.start[i] : t.end[i]]) + b" ", np.uint8)
            one, three = context_mixing.before(word, np.array([0]))
            for b, x, y in zip(word.tolist(), one.tolist(), three.tolist(), strict=True):
                tree = model.bytes
                for e in range(tree.begin[b], tree.begin[b] + tree.size[b]):
                    turn, node = 1 if tree.bit[e] else -1, tree.node[e]
                    decide(13 + (tree.depth[e] >= 2) + (tree.depth[e] >= 5), turn * model.byte_zero[node], turn * model.byte_one[x, node] / context_mixing.ODDS, turn * model.byte_three[y, node] / context_mixing.ODDS)
    return total / math.log(10)


def model_weights():
    return [[float(x) for x in row] for row in context_mixing.PRIOR]


def test_lm_scores_one_decision_after_the_other(spark):
    """Scores of a corpus dealt into several units against dictionaries and a loop."""
    rng = random.Random(12)
    rows = [(d, t) for d, t in h.texts(5) if d is not None] + [(2000 + i, h.sentence(rng, 60)) for i in range(30)]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    got = lm_scoring.score(h.table(spark, rows), unit_bytes=6000, rate=0.02).collect()
    model, counts, after = plain_model(rows, held, 30)
    want = {(d, t or ""): plain_score(t or "", int(not x), model, counts, after, 30, 0.02, 200.0) for (d, t), x in zip(rows, held, strict=True)}
    own, plain = (sorted(x) for x in ([(r["doc_id"], r["score"]) for r in got], [(d, float(want[d, t or ""])) for d, t in rows]))
    assert [d for d, _ in own] == [d for d, _ in plain]
    assert [x for _, x in own] == pytest.approx([x for _, x in plain], rel=2e-5, abs=1e-3)
    assert any(x for x in held) and len({r["held_out"] for r in got}) == 2


def test_lm_is_a_distribution():
    """The first token's probabilities over all words of the codebook, the end and a new word add up to one."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "cat", "tree", "x1", "und", "walks", f"n{rng.randint(0, 40)}"]) for _ in range(50))) for i in range(40)]
    model, counts, _ = plain_model(rows, [False] * len(rows), 30)
    total = 0.0
    words = {w for _, t in rows for w in t.split()}
    for text in [*words, "", "unheardof"]:
        t = tokens_of(text)
        train = np.zeros(len(t.hash), np.int64)
        none = np.zeros(len(t.hash), np.int64)
        follow = context_mixing.followers(none, train, none, none, none)
        t.kind = t.classes()
        count = np.array([counts[x] for x in t.hash.tolist()])
        leaf = model.leaves(model.symbols(t.hash), count)
        x, gate, begin, size, _ = context_mixing.decisions(t, model, 0, 1, leaf, count, train, follow, none)
        log = context_mixing.mixed(x, gate, np.array([x.shape[1]]), context_mixing.State(1))
        if leaf[0] == len(model.words) and text != "unheardof":
            continue
        total += math.exp(log[gate < 3].sum() + model.tail[0, leaf[0]])
    assert total == pytest.approx(1.0, abs=1e-4)
    # the letters that may follow two others
    tree, chance = model.bytes, np.zeros(256)
    for b in range(256):
        e = np.arange(tree.begin[b], tree.begin[b] + tree.size[b])
        turn = np.where(tree.bit[e], 1, -1)
        x = np.stack([model.byte_zero[tree.node[e]] * turn, model.byte_one[97, tree.node[e]] * turn / 14, model.byte_three[5, tree.node[e]] * turn / 14]).astype(np.float32)
        chance[b] = math.exp(context_mixing.mixed(x, np.full(len(e), 13, np.int8), np.array([len(e)]), context_mixing.State(1)).sum())
    assert chance.sum() == pytest.approx(1.0, abs=1e-4)


def test_lm_long_text_in_pieces():
    """One text alone is mixed in pieces; refinements fall at the same places but for the ends of pieces."""
    rng = random.Random(3)
    rows = [(0, h.sentence(rng, 4000)), (1, h.sentence(rng, 30))]
    model, counts, _ = plain_model(rows, [False, True], 30)
    t = tokens_of(rows[0][1])
    none, count = np.zeros(len(t.hash), np.int64), np.array([counts[x] for x in t.hash.tolist()])
    symbol, follow = model.symbols(t.hash), context_mixing.followers(none, none, none, none, none)
    whole, cut = (context_mixing.costs(tokens_of(rows[0][1]), model, symbol, count, none, follow, piece=p) for p in (1 << 20, 999))
    assert np.isfinite(whole).all() and abs(whole.sum() - cut.sum()) < 0.01 * abs(whole.sum())


def test_lm_takes_a_text_longer_than_a_slice(spark):
    """Five MB in one row, and copies of short rows in other units."""
    rng = random.Random(2)
    long = " ".join(rng.choice(["tree", "river", "stone", "light", "house"]) + str(rng.randint(0, 99)) for _ in range(650_000))
    rows = [(0, long), (2, "tree1 river2"), (2, "tree1 river2"), (3, "tree1 river2")]
    assert not any(zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scoring.score(h.table(spark, rows), unit_bytes=1 << 20).collect()}
    counts = Counter(w for _, t in rows for w in [*t.split(), "\0end"])
    n, kinds = counts.total(), len(counts)
    assert got[0, 650_001]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in [*long.split(), "\0end"]))
    # a word is one of 500, so its letters are known and its choice costs 2.7
    assert 2.6 < -got[0, 650_001]["score"] / 650_001 < 2.8
    assert got[2, 3]["score"] == got[3, 3]["score"]


def test_lm_scores_do_not_depend_on_partitions(spark):
    """Codebook, letters and followers are counted over the corpus, however it is cut into tasks and units."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", "cat", f"w{rng.randint(0, 60)}", f"rare{rng.randint(0, 10**6)}é"]) for _ in range(rng.randint(0, 150)))) for i in range(200)]
    got = []
    for partitions, unit_bytes, files in (("2", 16 << 20, 1), ("13", 1 << 12, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got.append({r["doc_id"]: (r["base_score"], r["score"]) for r in lm_scoring.score(h.table(spark, rows).repartition(files), unit_bytes=unit_bytes, codebook=40).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0].keys() == got[1].keys()
    for d, pair in got[0].items():
        assert pair == pytest.approx(got[1][d], rel=1e-6, abs=1e-6)


def test_lm_counts_of_any_size(spark):
    """A follower seen a million of ten million times, and a word of five thousand million occurrences, come back whole."""
    wide = np.array([0, 1, 65534, 65535, 65536, 10**7, 2**32 - 1, 2**32, 5 * 10**9], np.int64)
    for kind in (np.uint16, np.uint32):
        blob = b"x" + lm_scoring.narrow(wide, kind) + lm_scoring.narrow(wide[:3], kind)
        one, at = lm_scoring.widen(blob, len(wide), kind, 1)
        two, end = lm_scoring.widen(blob, 3, kind, at)
        assert one.tolist() == wide.tolist() and two.tolist() == wide[:3].tolist() and end == len(blob)
    pairs, words = np.array([5 << 16 | 7, 5 << 16 | 9], np.uint64), np.array([11], np.uint64)
    asked = [("p", 0, 0, lm_scoring.pack(pairs, np.array([10**6 << 1, 9 * 10**6 << 1]))), ("p", 1, 0, lm_scoring.pack(pairs[:1], np.array([1]))), ("w", 0, 0, lm_scoring.pack(words, np.array([3 * 10**9]))), ("w", 1, 0, lm_scoring.pack(words, np.array([2 * 10**9])))]
    df = spark.createDataFrame([(k, u, b, bytearray(x)) for k, u, b, x in asked], lm_scoring.ROWS)
    got = {(r["kind"], r["unit"]): bytes(r["blob"]) for r in lm_scoring.answer(df, np.zeros(0, np.uint64), 1).collect()}
    assert lm_scoring.widen(got["w", 1], 1, np.uint32)[0].tolist() == [5 * 10**9]
    blob = got["p", 1]
    total, at = lm_scoring.widen(blob, 1, np.uint16, 3)
    top_count, _ = lm_scoring.widen(blob, 1, np.uint16, at)
    assert np.frombuffer(blob, np.uint16, 1, 1)[0] == 9 and total.tolist() == [10**7] and top_count.tolist() == [9 * 10**6]
    has, true, count, others = context_mixing.followers(np.array([7, 9]), np.zeros(2, np.int64), np.repeat(total, 2), np.array([9, 9]), np.repeat(top_count, 2))
    assert has.all() and true.tolist() == [False, True] and count.tolist() == [9 * 10**6] * 2 and others.tolist() == [10**6] * 2


def test_lm_tells_long_words_apart(spark):
    """Words of 1,024 bytes and more whose polynomial hashes modulo 2**64 are equal have counts of their own."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    rows = list(zip(ids, (word[:1024], word[1024:2048], word[:2048], word[2048:]), strict=True))
    got = {r["doc_id"]: r for r in lm_scoring.score(h.table(spark, rows)).collect()}
    # five kinds: four words and the end
    assert all(got[i]["base_score"] == pytest.approx(math.log10(2 / (8 + 5 + 1)) + math.log10(5 / (8 + 5 + 1))) for i in ids)


def test_lm_prefers_what_it_has_seen(spark):
    rng = random.Random(6)
    syllables = ["ka", "to", "mi", "re", "lu"]
    make = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(120))
    odd = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, make()) for i in range(300)] + [(odd, "".join(rng.choice("qxzwvjk ") for _ in range(600)))]
    got = {r["doc_id"]: r for r in lm_scoring.score(h.table(spark, rows)).collect()}
    held = [r["bits_per_byte"] for d, r in got.items() if r["held_out"] and d < 1000]
    assert np.mean(held) < 2.2 < got[odd]["bits_per_byte"]


def test_lm_learns_every_context(spark):
    """Held-out copies of training texts are all but certain, however many contexts the corpus has and however it is dealt out."""
    rng = random.Random(8)
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    kept = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2][:400]
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(80))) for i in kept]
    rows += [(i, t) for i, (_, t) in zip(held, rows, strict=False)]
    got = [sorted((r["doc_id"], r["bits_per_byte"]) for r in lm_scoring.score(h.table(spark, rows), unit_bytes=u).collect()) for u in (16 << 20, 50_000)]
    assert np.mean([b for d, b in got[0] if d in held]) < 1.2
    assert [d for d, _ in got[0]] == [d for d, _ in got[1]]
    assert np.mean(np.abs(np.array([b for _, b in got[0]]) - [b for _, b in got[1]])) < 0.02


def test_quality(spark):
    rows = [(d, None if t is None else t.replace("\x00", "")) for d, t in h.texts()] + [(700, " ".join(f"w{i % 9}" for i in range(40))), (701, "# $ % " * 20), (702, "- item of a list here\n" * 3 + "word " * 30)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    duck = duckdb.connect()
    import pandas as pd

    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(map(tuple, duck.sql(quality.OP9_SQL).select(*columns).fetchall()))
    got = quality.quality(h.table(spark, rows), sample_rows=30)
    assert sorted(map(tuple, got.select(*columns).collect())) == want
    for (i, t), r in zip(rows, want, strict=True):
        w = [x for x in h.SPACE.split(t or "") if x]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert r[1] == len(w) and r[5] == len(cover), i
    assert quality.quality(h.empty(spark)).count() == 0
    assert quality.quality(h.table(spark, [(None, "x"), (None, None)])).where("not base_failed").count() == 0


def test_quality_order_does_not_matter(spark):
    df = h.table(spark, h.texts())
    a = quality.quality(df).select("doc_id", "kept")
    b = quality.quality(df, rules=tuple(reversed(quality.RULES))).select("doc_id", "kept")
    assert h.keyed(a, a.columns) == h.keyed(b, b.columns)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    contents = [b"", b"plain\n", b"with\n\nblank lines\nhttp://x 0.0.0.0 1 text/html 3\n", "é".encode() * 700]
    raw = warc.arc_header("a.arc", version) + b"".join(warc.arc_record(version, f"http://x/{i} y", "20010203040506", c) for i, c in enumerate(contents))
    records = list(warc.parse_arc(io.BytesIO(raw)))
    assert [r.content for r in records] == contents and {r.version for r in records} == {version}
    assert records[1].fields["URL"] == "http://x/1%20y" and records[1].fields["Archive-date"] == "20010203040506"
    text = warc.to_warc(records[3], uuid.UUID(int=5))
    ((fields, block),) = list(warc.parse_warc(io.BytesIO(text + b"\r\n\r\n")))
    assert fields["WARC-Date"] == "2001-02-03T04:05:06Z" and block.endswith(contents[3])
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(contents[3]).digest()).decode()
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(raw[:-300])))


def test_record_ids():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(uuid.UUID(str(warc.record_uuid(page, b"x")))) == page


def test_warc_files(spark, tmp_path):
    rows = [(1, "http://a b", "x" * 1200), (5, None, "x" * 1200), (5, "u", "x" * 1200), (None, "u", "x" * 1200), (7, "u", None), (8, "u", "é" * 600 + "\r\n\r\nWARC/1.1 "), (9, "u", "é" * 600 + "\r\n\r\nWARC/1.1 "), (10, "u", "short"), (11, "u", "short")]
    pages = spark.createDataFrame([(*r, "d", 1, True) for r in rows], "page_id long, url string, html string, digest string, top int, revisit boolean")
    for versions in ((1,), (2,), (1, 2)):
        path = f"file://{tmp_path}/w{''.join(map(str, versions))}"
        warc.write_warc(pages, path, arc_versions=versions)
        got = warc.read_warc(spark, path).collect()
        want = Counter()
        for p, _, t in rows:
            data = (t or "").encode()
            top = max((q for q, _, u in rows if (u or "") == (t or "") and q is not None), default=None)
            again = len(data) >= 1000 and p != top
            want[(p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None)] += 1
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
        assert all(bytes(r["payload"]).decode() in {t or "" for _, _, t in rows} for r in got if r["record_type"] == "response")
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_lm_mixes_the_whole_path():
    """A word has a decision for every level of its path, deep ones too, and costs nothing beside them."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(60)]
    model, counts, _ = plain_model(rows, [False] * len(rows), 30)
    t = tokens_of(" ".join(words[:50]))
    none, count = np.zeros(len(t.hash), np.int64), np.array([counts[x] for x in t.hash.tolist()])
    leaf = model.leaves(model.symbols(t.hash), count)
    t.kind = t.classes()
    _, gate, _, size, outside = context_mixing.decisions(t, model, 0, len(t.hash), leaf, count, none, context_mixing.followers(none, none, none, none, none), none)
    assert size.tolist() == model.tree.size[leaf].tolist() and size.max() > 7
    assert not outside.any() and set(gate.tolist()) == {0, 1, 2}
