"""Methods that once came to the driver or one task, as distributed jobs: against plain versions, with hubs, wide vectors and long chains."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.vectors import vector_sums
from quillgraph.operators import community, metric, models, propagate, sampling, structure
from quillgraph.operators.graph import RelGraph, adjacency, undirected


def key(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def graph(spark, pairs, labels, features=None):
    g = RelGraph(spark.createDataFrame(sorted(labels.items()), "node_id long, label string").cache(), undirected(spark.createDataFrame(pairs, "src long, dst long")).cache())
    return g if features is None else RelGraph(g.nodes, g.edges, spark.createDataFrame([(i, list(map(float, x))) for i, x in sorted(features.items())], "node_id long, features array<double>").cache())


# sums of vectors


def test_vector_sums(spark):
    """Vectors of any lengths, with nulls; longer than a block of columns."""
    rng = random.Random(1)
    rows = [(k, float(rng.randint(1, 5)), [rng.random() for _ in range(n)]) for k, n in [("a", 130), ("a", 130), ("b", 3), ("b", 70), ("c", 0), ("d", 64), ("d", 65)]]
    rows.append(("d", 2.0, [None, 1.0]))
    df = spark.createDataFrame(rows, "k string, w double, v array<double>").repartition(3)
    want = {}
    for k, w, v in rows:
        have = want.setdefault(k, [])
        have += [0.0] * (len(v) - len(have))
        for i, x in enumerate(v):
            have[i] += w * (x or 0.0)
    got = {r["k"]: r["v"] for r in vector_sums(df, ["k"], "v", 130, F.col("w")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("width", [64, 65])
def test_vector_means(spark, width):
    rows = [(k, np.random.default_rng(i).random(width).tolist()) for i, k in enumerate("aabbbc")]
    got = {r["k"]: r["v"] for r in vector_sums(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v", width, mean=True).collect()}
    assert {k: pytest.approx(v) for k, v in got.items()} == {k: np.mean([v for j, v in rows if j == k], axis=0).tolist() for k in "abc"}
    assert vector_sums(spark.createDataFrame([], "k string, v array<double>"), ["k"], "v", 0).count() == 0


def test_wide_propagation(spark):
    """A thousand positions: as the dense product, and what is shuffled are vectors, not positions."""
    rng = np.random.default_rng(0)
    n, width = 60, 1000
    pairs = sorted({tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(150)} | {(0, i) for i in range(1, n)})
    x = rng.normal(size=(n, width))
    g = graph(spark, [*pairs, (5, 5)], {i: "a" for i in range(n)}, dict(enumerate(x)))
    a = np.zeros((n, n))
    for u, v in [*pairs, (5, 5)]:
        a[u, v] = a[v, u] = 1
    d = a.sum(axis=1) + 1
    s = (a + np.eye(n)) / np.sqrt(np.outer(d, d))
    got = {r["node_id"]: r["features"] for r in propagate.propagate(g.features, g.edges, "sym", 2).collect()}
    assert np.allclose([got[i] for i in range(n)], s @ s @ x)
    matrix = {(r["i"], r["j"]): r["w"] for r in propagate.weights(g.edges, g.features, "squared").collect()}
    assert all(matrix.get((i, j), 0.0) == pytest.approx((np.outer(d, d) * (a + np.eye(n)) ** 2)[i, j]) for i in range(n) for j in range(n))


# modularity


def leading(pairs, ids):
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for u, v in pairs:
        if u in at and v in at:
            a[at[u], at[v]] = a[at[v], at[u]] = 1
    k = a.sum(axis=1) + np.diag(a)
    values, vectors = np.linalg.eigh(a - np.outer(k, k) / k.sum())
    return values, vectors[:, -1]


def hub_graph(spokes):
    """Two cliques of 20, joined by an edge, and a hub with spokes, some of which reach the cliques."""
    pairs = [(b + i, b + j) for b in (0, 20) for i in range(20) for j in range(i)] + [(0, 20), (40, 1)]
    return [tuple(sorted(p)) for p in pairs] + [(40, 41 + i) for i in range(spokes)]


@pytest.mark.parametrize("spokes", [1500])
def test_leading_vector_beside_a_hub(spark, spokes):
    pairs = hub_graph(spokes)
    ids = sorted({x for p in pairs for x in p})
    _, want = leading(pairs, ids)
    e = undirected(spark.createDataFrame(pairs, "src long, dst long")).cache()
    members = spark.createDataFrame([(0, i) for i in ids], "part int, node_id long")
    got = {r["node_id"]: r["x"] for r in community.leading_vectors(members, adjacency(e)).collect()}
    x = np.array([got[i] for i in ids])
    assert abs(x @ want) / np.linalg.norm(x) > 0.999
    two = {r["node_id"]: r["cluster"] for r in community.power_bisection(e).collect()}
    assert two[0] == 0 and len({two[i] for i in range(20)}) == 1 and len({two[i] for i in range(20, 40)}) == 1


def test_parts_are_split_together(spark):
    """The same parts as the dense version's, whatever the level."""
    rng = random.Random(2)
    pairs = sorted({tuple(sorted((16 * c + rng.randrange(16), 16 * c + rng.randrange(16)))) for c in range(4) for _ in range(90)} | {(16 * c, (16 * c + 21) % 64) for c in range(4)})
    pairs = [tuple(sorted(p)) for p in pairs if p[0] != p[1]]
    e = undirected(spark.createDataFrame(pairs, "src long, dst long")).cache()
    groups = lambda df: sorted(sorted(r[1]) for r in df.groupBy("cluster").agg(F.collect_list("node_id")).collect())
    got = community.modularity_clusters(e, 6, "krylov")
    assert groups(got) == groups(community.modularity_clusters(e, 6, "leading_eigenvector")) and len(groups(got)) >= 4
    first = {r["cluster"]: r["least"] for r in got.groupBy("cluster").agg(F.min("node_id").alias("least")).collect()}
    assert [first[c] for c in sorted(first)] == sorted(first.values()) and sorted(first) == list(range(len(first)))


# collective inference


def in_order(near, x, labels, rc, names, kind, rounds):
    """The plain loop: one node after the other."""
    w, b = rc.coefficientMatrix.toArray(), np.array(rc.interceptVector.toArray())
    current = dict(labels)
    for _ in range(rounds):
        for v in sorted(x):
            agg = np.zeros(len(names))
            for u in near[v]:
                if u in current:
                    agg[names.index(current[u])] += 1
            agg = {"count": agg, "prop": agg / max(agg.sum(), 1), "exist": np.minimum(agg, 1)}[kind]
            current[v] = names[int(np.argmax(w @ np.r_[x[v], agg] + b))]
    return {v: current[v] for v in x}


@pytest.mark.parametrize(("kind", "rounds"), [("count", 10), ("prop", 2)])
def test_exact_order_by_levels(spark, kind, rounds):
    rng = random.Random(7)
    n = 30
    pairs = sorted({tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(60)})
    ids = sorted({v for p in pairs for v in p})
    label = {i: "abc"[(i // 7 + (rng.random() < 0.3)) % 3] for i in ids}
    x = {i: [("abc".index(label[i]) == c) * 0.4 + rng.random() for c in range(2)] for i in ids}
    g = graph(spark, pairs, label, x)
    near = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in ids}
    test = {i for i in ids if i % 3}
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(i, label[i], [*x[i], *(float(sum(label[u] == c for u in near[i])) for c in names)]) for i in ids if i not in test], "node_id long, label string, x array<double>")
    rc = models.logistic(rows, g.classes())
    start = {i: label[i] if i not in test else rng.choice(names) for i in ids if i % 11}
    current = spark.createDataFrame(sorted(start.items()), "node_id long, label string")
    target = g.nodes.where("node_id % 3 <> 0").select("node_id")
    got = models._in_order(g, rc, current, target, names, kind, True, rounds)
    assert {r["node_id"]: r["pred"] for r in got.collect()} == in_order(near, {i: x[i] for i in test}, start, rc, names, kind, rounds)


def test_levels_of_a_path_and_of_nothing(spark):
    arcs = adjacency(undirected(spark.createDataFrame([(1, 2), (2, 3), (5, 3), (5, 9)], "src long, dst long")))
    got = models.update_levels(arcs, spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 9, 12)], "node_id long"))
    assert {r["node_id"]: r["level"] for r in got.collect()} == {1: 0, 2: 1, 3: 2, 5: 3, 9: 4, 12: 0}
    assert models.update_levels(arcs, spark.createDataFrame([], "node_id long")).count() == 0


# structural sampler


def colours(members, near):
    primes = [p for p in range(2, 2000) if all(p % q for q in range(2, int(p**0.5) + 1))]
    colour = dict.fromkeys(members, 1)
    for _ in range(20):
        logs = {v: math.log(primes[colour[v] - 1]) for v in members}
        z = math.ceil(round(sum(logs.values()), 9))
        sign = {v: round(colour[v] + sum(logs[u] for u in near[v] if u in members) / z, 6) for v in members}
        rank = {s: i + 1 for i, s in enumerate(sorted(set(sign.values())))}
        new = {v: rank[sign[v]] for v in members}
        if new == colour:
            break
        colour = new
    return colour


def test_structural_sampler_by_optimistic_rounds(spark):
    """The picks of one draw at a time, on a graph with many conflicts between draws."""
    rng = random.Random(11)
    n, seed, size = 50, 4, 14
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(45)})
    ids = sorted({v for p in pairs for v in p})
    near = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in ids}
    g = graph(spark, pairs, {i: "a" for i in ids})
    left, want = {i for i in ids if i % 4}, []
    for turn in range(size):
        draw = min(left, key=lambda i: (key(seed * 1000 + turn, "rs", i), i))
        inner = {v: [u for u in near[v] if u in left] for v in left}
        level, wave = {draw: 0}, [draw]
        for hop in (1, 2):
            wave = sorted({u for v in wave for u in inner[v]} - set(level))
            level |= dict.fromkeys(wave, hop)
        members = set(level) if inner[draw] else set()
        if any(u in members for v in members for u in inner[v]):
            colour = colours(members, inner)
            pick = min(members, key=lambda v: (colour[v], v))
        else:
            pick = draw if not members else min(members, key=lambda v: (key(seed + turn, "wls", draw, v), v))
        want.append(pick)
        left.discard(pick)
        if not left:
            break
    got = sampling.by_colour(g, size, g.nodes.where("node_id % 4 <> 0").select("node_id"), seed, mode="exact")
    assert [r["node_id"] for r in got.orderBy("ord").collect()] == want


# nearest unused points


@pytest.mark.parametrize("points", [40, 600])
def test_nearest_unused_in_order(spark, points):
    """Centres in a heap want the same few points; ties go to the least id; equal points are told apart."""
    rng = np.random.default_rng(points)
    x = np.round(rng.normal(size=(points, 3)), 1)
    x[points // 2 :: 7] = x[0]
    centres = np.vstack([x[0] + 0.01 * rng.normal(size=(25, 3)), rng.normal(size=(10, 3))])
    want, left = [], list(range(points))
    for c in centres:
        if left:
            pick = min(left, key=lambda i: (float(np.sqrt(((x[i] - c) ** 2).sum())), i))
            want.append(pick)
            left.remove(pick)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(points)], "node_id long, features array<double>").repartition(5)
    got = sampling.nearest_unused(df, centres.tolist())
    assert [(r["node_id"], r["ord"]) for r in got.orderBy("ord").collect()] == [(v, i + 1) for i, v in enumerate(want)]


def test_nearest_by_index(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, size=(200, 8)) for c in range(6)])
    queries = rng.normal(2, 2, size=(30, 8))
    index = metric.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<double>").repartition(4), pivots=16)
    gaps = np.sqrt(((queries[:, None] - x[None]) ** 2).sum(axis=2))
    for near, row in zip(metric.nearest(index, queries, 4), gaps, strict=True):
        assert [n for _, n in near] == sorted(range(len(x)), key=lambda i: (row[i], i))[:4]
    # the triangle inequality leaves most cells out
    d = metric.distances(queries, index.pivots)
    kth = np.sort(gaps, axis=1)[:, 3]
    assert sum(len(q) for q in metric._open_cells(index, d, kth).values()) < 0.5 * len(queries) * len(index.cells)
    assert metric.nearest(metric.build(spark.createDataFrame([], "node_id long, features array<double>")), queries[:2], 3) == [[], []]


# path centralities, kernels


def test_path_centralities_by_levels(spark, monkeypatch):
    """Against accumulation from one source at a time, on a graph in two parts, in several batches of sources."""
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(18), 2))) for _ in range(45)} | {(30, 31), (31, 32)})
    near = {}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    n, node, load, pair, close = len(near), {}, {}, {}, {}
    for s in near:
        order, dist, ways, back, queue = [], {s: 0}, {s: 1.0}, {s: []}, [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w], back[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    back[w].append(v)
        total = sum(dist.values())
        close[s] = (len(dist) - 1) / total * (len(dist) - 1) / (n - 1)
        part, flow = dict.fromkeys(order, 0.0), dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in back[w]:
                c = ways[v] / ways[w] * (1 + part[w])
                pair[min(v, w), max(v, w)] = pair.get((min(v, w), max(v, w)), 0.0) + c
                part[v] += c
                flow[v] += flow[w] / len(back[w])
            if w != s:
                node[w] = node.get(w, 0.0) + part[w]
                load[w] = load.get(w, 0.0) + flow[w] - 1
    monkeypatch.setattr(structure, "BATCH_ROWS", n * n // 2)
    e = undirected(spark.createDataFrame([*pairs, (4, 4)], "src long, dst long"))
    got, edges = structure.path_centralities(e)
    got = {r["node_id"]: (r["betweenness"], r["load"], r["closeness"]) for r in got.collect()}
    scale = 1 / ((n - 1) * (n - 2))
    assert got == {v: pytest.approx((node.get(v, 0.0) * scale, load.get(v, 0.0) * scale, close[v])) for v in near}
    assert {(r["u"], r["v"]): r["betweenness"] for r in edges.collect()} == {k: pytest.approx(x / (n * (n - 1))) for k, x in pair.items()}
    some, _ = structure.path_centralities(e, pivots=12, seed=1)
    assert max(abs(r["betweenness"] - node.get(r["node_id"], 0.0) * scale) for r in some.collect()) < structure.pivot_error(12, n)


def test_path_centralities_in_blocks(spark, monkeypatch):
    """Many ranges of nodes and groups of sources give what one of each gives; no block has more cells than asked for."""
    from quillgraph.operators import path_blocks

    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)} | {(0, i) for i in range(20, 30)} | {(50, 51)})
    e = undirected(spark.createDataFrame(pairs, "src long, dst long")).cache()
    read = lambda: tuple({tuple(r)[:-k]: tuple(r)[-k:] for r in df.collect()} for df, k in zip(structure.path_centralities(e), (3, 1), strict=True))
    want = read()
    monkeypatch.setattr(path_blocks, "RANGE", 16)
    monkeypatch.setattr(path_blocks, "CELLS", 160)
    monkeypatch.setattr(path_blocks, "CHUNK", 4)
    got = read()
    for one, other in zip(got, want, strict=True):
        assert one.keys() == other.keys() and all(one[x] == pytest.approx(other[x]) for x in one)
    assert len(got[1]) == len(pairs)


def test_median_square(spark, monkeypatch):
    monkeypatch.setattr(metric, "_FEW", 40)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(3, 2)), 9, axis=0), np.zeros((5, 2))):
        gaps = np.array([((x[i] - x[j]) ** 2).sum() for i in range(len(x)) for j in range(i)])
        gaps = gaps[gaps > 1e-9]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<double>").repartition(3)
        assert metric.median_square(df) == pytest.approx(np.median(gaps) if len(gaps) else 0.0)


def test_thin_kernel_and_its_clusters(spark):
    """Close to the dense kernel, closer with more features; planted groups come out; the medoids are the dense ones of the clusters."""
    rng = np.random.default_rng(2)
    n = 90
    x = np.vstack([rng.normal(3 * c, 0.3, size=(30, 2)) for c in range(3)])
    pairs = sorted({tuple(sorted((30 * c + int(a), 30 * c + int(b)))) for c in range(3) for a, b in rng.integers(0, 30, size=(120, 2)) if a != b} | {(i, i + 1) for i in range(n - 1) if i % 30 != 29})
    g = graph(spark, pairs, {i: "a" for i in range(n)}, dict(enumerate(x)))
    gamma = 0.5
    a = np.zeros((n, n))
    for u, v in pairs:
        a[u, v] = a[v, u] = 1
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = np.diag(1 / a.sum(axis=1))
    dense = d @ a @ np.exp(-gamma * d2) @ a @ d
    kernel = community.thin_kernel(g.features, g.edges, gamma=gamma, count=512).cache()
    f = {r["node_id"]: r["f"] for r in kernel.collect()}
    f = np.array([f[i] for i in range(n)])
    assert np.abs(f @ f.T - dense).max() < 4 / np.sqrt(256)
    clusters = community.thin_spectral_clusters(kernel, 3).cache()
    of = {r["node_id"]: r["cluster"] for r in clusters.collect()}
    assert len(set(of.values())) == 3 and all(len({of[30 * c + i] for i in range(30)}) == 1 for c in range(3))
    for r in community.thin_medoids(kernel, clusters, g.nodes.where("node_id % 2 = 0")).collect():
        own = [i for i in range(0, n, 2) if of[i] == of[r["node_id"]]]
        mean = {i: (f[i] @ f[own].T).mean() for i in own}
        assert mean[r["node_id"]] == pytest.approx(max(mean.values()))


@pytest.mark.parametrize("mode", [True, False])
def test_labels_over_several_blocks(spark, monkeypatch, mode):
    """Labels inferred on blocks of a few nodes against plain loops: one after the other, and all at once."""
    from quillgraph.operators import label_blocks

    monkeypatch.setattr(label_blocks, "ARCS", 30)
    rng = np.random.default_rng(3)
    n, classes, rounds = 40, 3, 4
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, n, (90, 2)).tolist()})
    near = {v: sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) for v in range(n)}
    base = {v: rng.normal(size=classes) for v in range(n) if v % 4}
    weights = rng.normal(size=(classes, classes)) / 2
    now = {v: int(rng.integers(classes)) for v in range(n) if v % 7}
    rows = [(v * 10, now.get(v), base[v].tolist() if v in base else None) for v in range(n)]
    arcs = [(v * 10, u * 10) for v in base for u in near[v]]
    got = label_blocks.inferred(spark.createDataFrame(rows, "node_id long, c int, base array<double>"), spark.createDataFrame(arcs, "node long, nbr long"), weights, "count", rounds, mode)
    for _ in range(rounds):
        seen = now if mode else dict(now)
        for v in sorted(base):
            agg = np.bincount([seen[u] for u in near[v] if u in seen], minlength=classes)
            now[v] = int(np.argmax(base[v] + weights @ agg))
    assert {r["node_id"] // 10: r["c"] for r in got.collect()} == now
