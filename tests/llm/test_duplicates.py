"""SimHash components, repeated strings and benchmark leaks against brute force."""

import hashlib
import random
from collections import Counter

import helpers as h
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quillgraph.llm import decontaminate, dedup, simhash
from quillgraph.llm.gray_index import GrayIndex, forest, gray_rank, nearest_pairs
from quillgraph.llm.suffix_array import Block


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("flips", [2, 4, 6])
def test_index_links_what_brute_force_links(flips):
    rng = np.random.default_rng(flips)
    base, n = rng.integers(0, 2**63, 12, dtype=np.uint64), 800
    codes = base[rng.integers(0, 12, n)]
    for _ in range(flips):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    groups = rng.integers(0, 3, n)
    close = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (groups[:, None] == groups[None, :])
    a, b = forest(codes, groups, 4)
    assert roots(n, zip(a.tolist(), b.tolist(), strict=True)) == roots(n, zip(*(x.tolist() for x in np.nonzero(close)), strict=True))
    order = np.lexsort((gray_rank(codes), np.zeros(n)))
    index = GrayIndex(codes[order], np.zeros(n, np.int64))
    q, m = index.near(np.arange(n), 4)
    every = np.bitwise_count(codes[order][:, None] ^ codes[order][None, :]) <= 4
    assert {(x, y) for x, y in zip(q.tolist(), m.tolist(), strict=True)} == {(x, y) for x, y in zip(*(z.tolist() for z in np.nonzero(every)), strict=True) if x < y}


@pytest.mark.parametrize("barred", [None, lambda a, b: (a + b) % 3 == 0])
def test_nearest_pairs_span_what_is_near(barred):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 400)]
    for _ in range(7):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    groups, known = rng.integers(0, 4, 400), np.arange(400)
    known[1:40:2] = known[0:40:2]  # members joined before
    close = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 16) & (groups[:, None] == groups[None, :])
    if barred is not None:
        close &= ~barred(np.arange(400)[:, None], np.arange(400)[None, :])
    every = list(zip(*(x.tolist() for x in np.nonzero(close)), strict=True))
    a, b = nearest_pairs(codes, groups, 16, None, barred)
    found = list(zip(a.tolist(), b.tolist(), strict=True))
    assert set(found) <= set(every) and roots(400, found) == roots(400, every) and len(found) == 400 - len(set(roots(400, every)))
    before = [(i, i + 1) for i in range(0, 40, 2) if groups[i] == groups[i + 1]]
    a, b = nearest_pairs(codes, groups, 16, known, barred)
    assert roots(400, [*before, *zip(a.tolist(), b.tolist(), strict=True)]) == roots(400, [*before, *every])
    assert len(nearest_pairs(codes[:0], groups[:0], 16)[0]) == 0


def fingerprint(text):
    w = h.words(text)
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


@pytest.mark.parametrize("cap", [20_000, 1])
def test_near_duplicates(spark, cap):
    rows = h.texts()
    got = simhash.near_duplicates(h.table(spark, rows), bucket_cap=cap).collect()
    prints = [fingerprint(t) for _, t in rows]
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    links = [(i, j) for i in known for j in known if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4]
    root = roots(len(rows), links)
    least = {}
    for i in known:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    want = Counter()
    for i, (d, _) in enumerate(rows):
        same = next((j for j in known if prints[j] == prints[i]), None)
        want[(d, f"{prints[i]:016x}", least[root[i if d is not None else same]] if d is not None or same is not None else None)] += 1
    assert Counter(map(tuple, got)) == want
    assert {r["component_id"] for r in got if r["doc_id"] in (100, 101, 102)} == {100}


def test_similar_groups(spark):
    """Groups of the pipeline's stage against every pair of shingle sets, at and around the similarity asked for."""
    rng = random.Random(4)
    rows = h.texts(5)
    for k in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([4, 9, 30, 120, 300]))]
        rows.append((1000 + 10 * k, " ".join(words)))
        for j in range(1, 4):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * j // 120)):
                changed[at] = "other"
            rows.append((1000 + 10 * k + j, " ".join(changed).upper()))
    sets = []
    for d, t in rows:
        w = h.words(t)
        sets.append({" ".join(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if None not in (rows[i][0], rows[j][0]) and (rows[i][0] == rows[j][0] or sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    root = roots(len(rows), links)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, least[r]) for (d, _), r in zip(rows, root, strict=True) if d is not None)
    assert sum(1000 <= d != c for d, c in want) > 20 and any(d != c and abs(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) - 0.85) < 0.05 for i, j in links if sets[i] for d, c in [(i, j)])
    assert Counter(map(tuple, simhash.similar_groups(h.table(spark, rows)).collect())) == want
    assert Counter(map(tuple, simhash.similar_groups(h.table(spark, rows), bucket_cap=2).collect())) == want
    assert simhash.similar_groups(h.empty(spark)).count() == 0
    docs = h.table(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {r[0] for r in kept.select("doc_id").collect()} == {None} | set(least.values())


def test_no_documents(spark):
    assert simhash.near_duplicates(h.empty(spark)).count() == 0
    assert dedup.remove_repeats(h.empty(spark)).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(80):
        parts = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        block = Block(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])])
        order = block.suffixes(40)
        suffixes = [parts[block.text[p]][p - block.first[block.text[p]] :] for p in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(block.chars))) and suffixes == sorted(suffixes)

        def common(x, y):
            return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

        assert block.common(order, 20)[1:].tolist() == [min(20, common(a, b)) for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]


def removed(rows, size):
    """(id, bytes, removed, spans, sha256) with every window in a set; rows of one id and text are one document."""
    seen, out = set(), Counter()
    documents = Counter((dedup.LAST if d is None else d, t or "") for d, t in rows)
    for (d, t), n in sorted(documents.items(), key=lambda x: (x[0][0], xxhash.xxh64_intdigest(x[0][1].encode(), 42) & 0x7FFFFFFF)):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - size + 1):
            if data[i : i + size] in seen:
                gone[i : i + size] = True
            seen.add(data[i : i + size])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[(None if d == dedup.LAST else d, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())] += n
    return out


@pytest.mark.parametrize(("crowd", "most_runs"), [(24, 20_000), (1, 20_000), (1000, 2)])
def test_repeated_strings(spark, monkeypatch, crowd, most_runs):
    rng = random.Random(8)
    rows = h.texts() + [(400 + i, "".join(rng.choice(["ab", "ab ", "é", "\n", "x"]) for _ in range(rng.randint(0, 400)))) for i in range(40)]
    inner = dedup.repeated_spans
    monkeypatch.setattr(dedup, "repeated_spans", lambda texts, size: inner(texts, size, crowd=crowd, most_runs=most_runs))
    got = dedup.remove_repeats(h.table(spark, rows)).drop("kept")
    assert Counter(map(tuple, got.collect())) == removed(rows, 100)


def test_no_anchor_makes_a_large_block(spark):
    """Half of the texts have one phrase, each time among other words; its runs are dealt out by windows once they are too many."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, " ".join([*(word() for _ in range(20)), *(["the one phrase that many different texts have"] if i % 2 else []), *(word() for _ in range(20))])) for i in range(600)]
    texts = dedup.positioned(h.table(spark, rows))
    settled = dedup.settle(dedup.deal(texts, 100, 8, np.zeros(0, np.uint64)), 100, 8, 50).collect()
    asked = {k: Counter(a for r in settled if r["kind"] == k for a in dedup.unpack(r["body"], "u8,i4,i4")[0].tolist()) for k in "qc"}
    assert max(asked["q"].values(), default=0) <= 50 < max(asked["c"].values()) and not asked["q"].keys() & asked["c"].keys()


def test_cut_repeats_keeps_columns(spark):
    long = "".join(f"é{i}" for i in range(100))
    rows = [(1, long), (2, "x" + long), (3, None), (4, "kept"), (5, "ü" + long[1:])]
    df = h.table(spark, rows).selectExpr("*", "77L AS _pos", "5 AS _tie", "'s' AS _spans", "doc_id AS spans_", "1 AS TIE_")
    out = dedup.cut_repeats(df)
    assert out.columns == df.columns
    assert all((r["_pos"], r["_tie"], r["_spans"], r["spans_"], r["TIE_"]) == (77, 5, "s", r["doc_id"], 1) for r in out.collect())
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (long, len(long)), 2: ("x", 1), 3: (None, None), 4: ("kept", 4), 5: ("ü", 1)}


def leaks(rows, items):
    out = {}
    strip = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x00")
    normal = lambda t: h.words((t or "").translate(strip))
    grams = lambda w: Counter(" ".join(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1))
    for n, (_, t) in enumerate(rows):
        w = normal(t)
        for item, s in items:
            v = normal(s)
            for i in range(max(1, len(w) - len(v) + 1)) if v and w and item is not None else ():
                a, b = grams(w[i : i + len(v)]), grams(v)
                both = sum((a & b).values())
                similarity = both / (a.total() + b.total() - both)
                if similarity >= 0.8 and similarity > out.get((n, item), (0,))[0]:
                    out[(n, item)] = (similarity, i)
    return Counter((rows[n][0], item, round(s, 9), i) for (n, item), (s, i) in out.items())


@pytest.mark.parametrize("block", [8 << 20, 1500])
def test_decontamination(spark, block):
    rng = random.Random(5)
    items = [(i, h.sentence(rng, rng.choice([1, 3, 5, 12, 30, 60]))) for i in range(25)] + [(90, None), (91, ""), (None, "no id at all here")]
    rows = h.texts(2, 10)[:20] + [(500 + i, h.sentence(rng, 20) + " " + (s or "").upper() + " " + h.sentence(rng, 10)) for i, s in items[:20]]
    long = " ".join(f"w{i}" for i in range(50))
    items.append((70, long))
    rows += [(600, long.replace("w25 ", "changed ")), (601, long.replace("w2", "v2")), (602, "a " + long.replace("w49", "end") + " b")]
    # shorter than the item, much longer than any, and of one item again and again
    very = " ".join(f"u{i % 97}x{i}" for i in range(700))
    items.append((71, very))
    rows += [(603, long.rsplit(" ", 2)[0]), (604, long.rsplit(" ", 20)[0]), (605, "so " + very.replace("u5x", "y") + " and " + very + " on"), (606, " ".join([long] * 6))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(h.table(spark, rows), bench, block_bytes=block)
    assert Counter((d, i, round(s, 9), f) for d, i, s, f in got.collect()) == leaks(rows, items)
    hit = {d for d, *_ in leaks(rows, items)}
    kept = decontaminate.drop_contaminated(h.table(spark, rows), bench, block_bytes=block)
    assert kept.columns == h.table(spark, rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for n, (d, _) in enumerate(rows) if not any(k for k in leaks([rows[n]], items)))
    assert {600, 602, 603, 605, 606} <= hit and not {601, 604} & hit
    assert decontaminate.find(h.empty(spark), bench).count() == 0 and decontaminate.find(h.table(spark, rows), bench.limit(0)).count() == 0
