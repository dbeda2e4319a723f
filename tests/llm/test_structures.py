"""Prefix trie, Merkle manifest, cost-balanced packing and ranks in large groups, against plain versions."""

import hashlib
import heapq
import random
import statistics
import zlib
from collections import Counter, defaultdict

import helpers as h
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import balanced_packing, merkle, prefix_trie
from quillgraph.llm.common import tokenizer_path
from quillgraph.llm.scans import running
from quillgraph.plans import scratch

WORD = tokenizer_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ranks and running sums


def ranks(rows):
    """Plain (group, order, value, rank, before, through), sums modulo 2^64."""
    out, seen = [], defaultdict(lambda: [0, 0])
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        state = seen[g]
        state[0] += 1
        before, state[1] = state[1], (state[1] + v) % 2**64
        out.append((g, o, state[0], *(x - 2**64 if x >= 2**63 else x for x in (before, state[1]))))
    return sorted(out, key=str)


def test_running_over_partition_borders(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(-(2**62), 2**62)) for i in range(700)] + [(rng.choice(["a", "b", None, "zz"]), i, i) for i in range(100)] + [(f"g{i}", None, 5) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    for parts in ("4", "30"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = running(scratch.materialise(df, "rows"), ["g"], ["o"], ["v"])
        assert h.keyed(got, ["g", "o", "rank", "v_before", "v_through"]) == ranks(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_of_whole_and_of_equal_and_of_no_rows(spark):
    same = scratch.materialise(spark.range(0, 3000, 1, 7).select(F.lit("x").alias("g"), F.lit(1).cast("long").alias("o")), "same")
    got = running(same, ["g"], ["o"])
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))
    assert sorted(r["rank"] for r in running(same, [], ["o"]).collect()) == list(range(1, 3001))
    assert running(same.limit(0), ["g"], ["o"], ["o"]).collect() == []


# Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(digests):
    """(levels of digests from the lowest, the last one's only element the top)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path(levels, i):
    """(digests before, digests after) among the siblings of each level."""
    out = []
    for level in levels[:-1]:
        run = i - i % 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def manifest(rows):
    """Plain version: rows of (doc_id, source, lang, n_chars, text)."""
    leaves = [(r[1], r[0], sha(*map(field, r)), sha(*map(field, (*r[:4], lowered(r[4]))))) for r in rows]
    order = sorted({r[0] for r in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in leaves if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for s in order]
    trees = [climb([r[2] for r in g]) for g in groups]
    over = climb([t[-1][0] for t in trees])
    out = []
    for j, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, (_, doc, leaf, other) in enumerate(group):
            steps = path(tree, i) + path(over, j)
            folded = other if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else leaf
            for before, after in steps:
                folded = sha(*before, folded, *after)
            out.append((doc, leaf, tree[-1][0], over[-1][0], sha(*(x for s in steps for side in s for x in side)), folded, folded == over[-1][0]))
    return sorted(out, key=str)


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def merkle_rows(seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", None, "b", "", "=", "é", "\U0001f600", "￮"]), rng.choice(["en", None]), rng.choice([i, None]), t) for i, t in h.texts(seed, 30)]
    rows += [(10_000 + i, "hot", "en", 3, rng.choice(["Abc", "abc", None, ""])) for i in range(300)] + [(10_000, "hot", "en", 3, "Abc")] * 5 + [(1, "alone", None, 7, "x")]
    rng.shuffle(rows)
    return rows


def test_manifest(spark):
    rows = merkle_rows(1)
    df = spark.createDataFrame([(*r, "p", 1, 2, "q") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part string, idx long, rank long, path string").repartition(4)
    got = merkle.documents_manifest(df, tampered())
    assert h.keyed(got, MERKLE) == manifest(rows)


def test_manifest_of_run_borders(spark):
    rows = [(1000 * n + i, f"s{n}", "en", i, f"Text {i}") for n in (1, 2, 16, 17, 256, 257) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert h.keyed(merkle.documents_manifest(df, tampered()), MERKLE) == manifest(rows)


def test_manifest_of_one_row(spark):
    rows = [(5, None, "en", 4, "Text")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert h.keyed(merkle.documents_manifest(df, tampered()), MERKLE) == manifest(rows)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.documents_manifest(df, tampered()).collect() == []


def test_untouched_rows_verify(spark):
    """A text without A-Z stays as it is under tampering and verifies."""
    df = spark.createDataFrame([(i, "s", "en", i, "abc" if i % 2 else "AbC") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    assert {r["doc_id"] for r in merkle.documents_manifest(df, tampered()).where("not verified").collect()} == {i for i in range(0, 40, 2) if zlib.crc32(str(i).encode()) % 5 == 0}


# prefix trie


def plain_trie(paths):
    """paths: {conv_id: ((role, text), ..)} -> rows of the trie."""
    members, out = defaultdict(list), []
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(prefix)))
        out.append((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), sum(len(p) == len(prefix) + 1 for p in below), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: tuple(t for _, t in sorted(turns)) for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 6
        source = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(source, ())[:n] + turns[n:]
    return own, out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(95, 130), *range(-30, 5), 205, 206, 310, 10**12 + 7]:
        if c in (200, 300):
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "user", "assistant", None, ""]), rng.choice(["hi", "hi", "hello é", None, "", "x" * 50])))
    rows += [(7, t, "user", f"turn {t}") for t in range(120)] + [(c, t, "user", f"turn {t}") for c in (400, 411, 412) for t in range(60 + c % 7)]
    rows += [(None, 1, "user", "no conversation"), (9, 1, "user", "twice"), (9, 1, "user", "twice"), (9, 1, "assistant", "tie")]
    rng.shuffle(rows)
    return rows


def awkward(spark, rows):
    full = [(*r, 1, 2, "k", 3) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, depth long, rank long, k1 string, pos long").repartition(3)


def test_trie_of_rebuilt_conversations(spark):
    rows = conversations(5)
    _, want = plain_rebuilt(rows)
    assert any(not t for t in want.values())
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(awkward(spark, rows))))
    assert h.keyed(got, TRIE) == plain_trie(want)


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations(6)
    own, _ = plain_rebuilt(rows)
    df = awkward(spark, rows)
    assert h.keyed(prefix_trie.conversation_trie(df), TRIE) == plain_trie(own)


def test_texts_of_nodes(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "s", "b"), (2, 0, "u", "a"), (2, 1, "s", "c")]
    ordered = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), with_text=True).withColumnRenamed("rank", "pos")
    nodes = prefix_trie.trie(ordered, prefix_trie.own_lengths(ordered))
    got = prefix_trie.node_texts(nodes, ordered)
    assert h.keyed(got, ["conv_id", "depth", "role", "text"]) == sorted([(1, 0, None, None), (1, 1, "u", "a"), (1, 2, "s", "b"), (2, 2, "s", "c")], key=str)


def test_hot_node_and_no_conversations(spark):
    """Many equal conversations end at one node; their ids stream through in order, over many partitions."""
    df = spark.range(0, 30_000, 1, 9).selectExpr("id conv_id", "cast(0 as long) turn", "'u' role", "'same' text")
    rows = {r["depth"]: r for r in prefix_trie.conversation_trie(df).collect()}
    assert rows[1]["n_convs"] == 30_000 and rows[1]["saved_tokens"] == 29_999 * 4
    assert rows[1]["ends_sha256"] == sha(",".join(map(str, range(30_000)))) and rows[0]["ends_sha256"] == sha("")
    assert prefix_trie.conversation_trie(df.limit(0)).collect() == []


def test_trie_equals_its_sql_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert h.keyed(prefix_trie.op11_prefix_trie(spark, SF), TRIE) == plain_trie(plain_rebuilt(rows)[1])


# cost-balanced packing


def plain_costs(lengths, capacity, linear):
    """Costs of sequences filled one document at a time."""
    seqs = [[0, size] for size, n in balanced_packing.sequence_sizes(sum(lengths), capacity) for _ in range(n)]
    heap = [-x for x in lengths]
    heapq.heapify(heap)
    while heap:
        x = -heapq.heappop(heap)
        fits = [(s[0], i) for i, s in enumerate(seqs) if s[1] >= x]
        i = min(fits or [(s[0], i) for i, s in enumerate(seqs) if s[1]])[1]
        taken = min(x, seqs[i][1])
        seqs[i][0] += linear * taken + taken * taken
        seqs[i][1] -= taken
        if taken < x:
            heapq.heappush(heap, taken - x)
    return sorted(s[0] for s in seqs)


def replayed(count, capacity, linear):
    """{sequence: [(offset, tokens)]} that the plan gives."""
    runs, total, out = defaultdict(list), Counter(count), defaultdict(list)
    for p in balanced_packing.plan(count, capacity, linear):
        runs[p[0]].append(p)
    for x in range(capacity, 0, -1):
        for (_, rank, taken, first, at, left), after in zip(runs[x], [*(r[1] for r in runs[x][1:]), None], strict=True) if runs[x] else []:
            n = (total[x] if after is None else after) - rank
            for r in range(n):
                out[first + r].append((at, taken))
            if taken < x:
                assert left == total[x - taken]
                total[x - taken] += n
    return out


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_one_document_at_a_time(seed):
    rng = random.Random(seed)
    capacity, linear = rng.choice([(16, 1), (64, 10), (100, 6144), (2048, 6144)])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 1 + capacity // 7), capacity]) for _ in range(rng.randint(0, 90))]
    sequences = replayed(Counter(lengths), capacity, linear)
    for parts in sequences.values():
        ends = [0] + [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1]
        assert ends[-1] == capacity or ends[-1] & (ends[-1] - 1) == 0
    assert sorted(sum(linear * n + n * n for _, n in parts) for parts in sequences.values()) == plain_costs(lengths, capacity, linear)


def test_balance():
    """Costs of full sequences differ less than where documents fill one sequence after the other."""
    rng = random.Random(0)
    lengths = [min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    ours = [sum(6144 * n + n * n for _, n in p) for p in replayed(Counter(lengths), 2048, 6144).values() if sum(n for _, n in p) == 2048]
    other, room = [0], 2048
    for x in lengths:
        while x:
            n = min(x, room)
            other[-1] += 6144 * n + n * n
            x, room = x - n, room - n
            if not room:
                other.append(0)
                room = 2048
    assert statistics.pstdev(ours) < 0.6 * statistics.pstdev(other[:-1])


@pytest.mark.parametrize("capacity", [2048, 64])
def test_balanced_packing(spark, capacity):
    rows = h.texts(2)
    lib = Tokenizer.from_file(WORD)
    got = balanced_packing.pack_balanced(h.table(spark, rows), WORD, capacity=capacity).collect()
    want = sorted([(d, (*lib.encode(t or "", add_special_tokens=False).ids, 1)) for d, t in rows], key=str)
    # texts of one id are told apart by their sizes here
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(pieces, key=str) == sorted({(d, len(ids)) for d, ids in want}, key=str)
    for (doc, size), own in pieces.items():
        copies = [ids for d, ids in want if (d, len(ids)) == (doc, size)]
        assert sum(r["length"] for r in own) == size * len(copies)
        for r in own:
            assert any(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"] for ids in copies)
        if len(copies) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    padding = 0
    for parts in sequences.values():
        ends = [0] + [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else capacity - ends[-1]
    assert padding == 0
    assert balanced_packing.pack_balanced(h.empty(spark), WORD).count() == 0
