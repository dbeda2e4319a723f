"""Samplers, models and structure against plain versions on small graphs."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.metrics import accuracy
from quillgraph.functions.vectors import principal_components
from quillgraph.operators import community, models, networks, relational, sampling, structure
from quillgraph.operators.graph import RelGraph, adjacency, dense_index, indexed, relabelled, undirected
from quillgraph.plans import experiment
from quillgraph.plans.synth import planted_graph
from quillgraph.sources.tables import ExperimentConfig

CLIQUES = [(a, b) for base in (0, 4) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 4)]


def key(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def uniform(*parts):
    return int(key(*parts)[:8], 16) / 2**32


@pytest.fixture(scope="module")
def small(spark):
    """A random graph of 40 nodes: the DataFrames, and plain neighbours, labels and features."""
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    ids = sorted({x for p in pairs for x in p})
    label = {i: "ab"[i % 2] for i in ids}
    feature = {i: [float(i % 2) + rng.random(), rng.random()] for i in ids}
    g = RelGraph(spark.createDataFrame(list(label.items()), "node_id long, label string").cache(), undirected(spark.createDataFrame(pairs, "src long, dst long")).cache(), spark.createDataFrame(list(feature.items()), "node_id long, features array<double>").cache())
    near = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in ids}
    return g, near, label, feature


def picks(df):
    return [r["node_id"] for r in df.orderBy("ord").collect()]


def test_forest_fire(small):
    g, near, *_ = small
    pool = g.nodes.where("node_id % 5 <> 0").select("node_id")
    inside = [i for i in near if i % 5]
    best = []
    for attempt in range(8):
        start = min(inside, key=lambda i: (key(3 + attempt, "rs", i), i))
        level, wave = {start: 0}, [start]
        while wave:
            wave = sorted({n for v in wave for n in near[v] if uniform(3, f"ffs{attempt}", v, n) <= 0.4 and n not in level})
            level |= dict.fromkeys(wave, max(level.values()) + 1)
        got = sorted((v for v in level if v in inside), key=lambda v: (level[v], v))[:12]
        if len(got) > len(best):
            best = got
        if len(best) >= 12:
            break
    assert picks(sampling.forest_fire(g, 12, pool, 3, p=0.4)) == best


def test_snowball_goes_on_beyond_fifty_levels(spark):
    e = undirected(spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long"))
    g = RelGraph(spark.range(71).select(F.col("id").alias("node_id"), F.lit("x").alias("label")), e)
    pool = g.nodes.where("node_id = 0 or node_id >= 60").select("node_id")
    seeds = spark.createDataFrame([(0,)], "node_id long")
    got = picks(sampling._spread(g, 5, pool, seeds, lambda adj: adj))
    assert got == [0, 60, 61, 62, 63]


def test_seeds_need_two_classes(spark, small):
    g, *_ = small
    one = g.nodes.where("label = 'a'")
    with pytest.raises(ValueError, match="one class"):
        sampling.seed_nodes(g, one, 3, 0, attempts=2)


def turns(members, size, seed):
    """The first member of each cluster by hash, then the second of each, .."""
    order = {c: sorted(m, key=lambda i: (key(seed, "rr", i), i)) for c, m in members.items()}
    rows = sorted((r, c, i) for c, m in order.items() for r, i in enumerate(m))
    return [i for _, _, i in rows[:size]]


def test_modularity_sampler(small):
    g, near, *_ = small
    pool = g.nodes.where("node_id % 5 <> 0").select("node_id")
    cap = 0.8 * len(near) / 4
    ids = sorted(near)
    a = np.array([[1.0 if j in near[i] else 0.0 for j in ids] for i in ids])
    parts = []

    def split(own):
        if len(own) < cap:
            return
        s = a[np.ix_(own, own)]
        k = s.sum(axis=1)
        values = np.linalg.eigvalsh(s - np.outer(k, k) / k.sum())
        positive = values > 1e-9
        yes, no = [v for v, x in zip(own, positive, strict=True) if x], [v for v, x in zip(own, positive, strict=True) if not x]
        if len(yes) < cap or len(no) < cap:
            parts.append(own)
            return
        split(yes)
        split(no)

    split(list(range(len(ids))))
    members = {c: [ids[i] for i in part if ids[i] % 5] for c, part in enumerate(parts)}
    assert picks(sampling.by_modularity(g, 9, pool, 2, k=4)) == turns(members, 9, 2)


def test_cluster_samplers(small):
    g, near, _, feature = small
    pool = g.nodes.where("node_id % 5 <> 0").select("node_id")
    found, _ = community.kmeans_clusters(g.features.join(pool, "node_id", "left_semi"), 4)
    members = {}
    for r in found.select("cluster", "node_id").collect():
        members.setdefault(r[0], []).append(r[1])
    assert picks(sampling.by_kmeans(g, 9, pool, 2, k=4)) == turns(members, 9, 2)
    # propagation: a node's features and its neighbours', weighted; then centres, each with the nearest pool node left
    size = {i: len(n) + 1 for i, n in near.items()}
    moved = {i: sum(np.array(feature[j]) * size[i] * size[j] for j in [i, *near[i]]) for i in near}
    got = picks(sampling.by_propagation(g, 5, pool, 2))
    assert len(set(got)) == 5 and all(i % 5 for i in got)
    from quillgraph.operators.propagate import propagate

    spread = {r["node_id"]: r["features"] for r in propagate(g.features, g.edges).collect()}
    assert all(np.allclose(spread[i], moved[i]) for i in near)
    _, centres = community.kmeans_clusters(propagate(g.features, g.edges).join(pool, "node_id", "left_semi"), 5)
    left, want = [i for i in near if i % 5], []
    for c in centres:
        want.append(min((i for i in left if i not in want), key=lambda i: (math.dist(feature[i], c), i)))
    assert sorted(got) == sorted(want) or got == want


def refined(members, near):
    """Colours after refinement inside a set of nodes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, p))]
    colour = dict.fromkeys(members, 1)
    for _ in range(20):
        logs = {v: math.log(primes[colour[v] - 1]) for v in members}
        z = math.ceil(round(sum(logs.values()), 9))
        sign = {v: round(colour[v] + sum(logs[n] for n in near[v] if n in members) / z, 6) for v in members}
        rank = {s: i + 1 for i, s in enumerate(sorted(set(sign.values())))}
        new = {v: rank[sign[v]] for v in members}
        if new == colour:
            break
        colour = new
    return colour


@pytest.mark.parametrize("hops", [2, 3])
def test_colour_sampler_in_order(small, hops):
    g, near, *_ = small
    pool = g.nodes.where("node_id % 3 <> 0").select("node_id")
    left, want, seed = {i for i in near if i % 3}, [], 4
    for turn in range(5):
        draw = min(left, key=lambda i: (key(seed * 1000 + turn, "rs", i), i))
        inner = {v: [n for n in near[v] if n in left] for v in left}
        level, wave = {draw}, {draw}
        for _ in range(hops):
            wave = {n for v in wave for n in inner[v]}
            level |= wave
        members = level - {draw} | ({draw} if inner[draw] else set())
        if any(n in members for v in members for n in inner[v]):
            colour = refined(members, inner)
            pick = min(members, key=lambda v: (colour[v], v))
        else:
            pick = draw if not members else min(members, key=lambda v: (key(seed + turn, "wls", draw, v), v))
        want.append(pick)
        left.discard(pick)
    assert picks(sampling.by_colour(g, 5, pool, seed, nhops=hops, mode="exact")) == want


def test_collective_in_order(small):
    g, near, label, feature = small
    train, test = g.nodes.where("node_id % 2 = 0 or node_id % 3 = 0"), g.nodes.where("node_id % 2 = 1 and node_id % 3 <> 0")
    train = g.nodes.where("node_id < 25")
    test = g.nodes.where("node_id >= 25")
    names = ["a", "b"]
    x = g.features.select("node_id", F.col("features").alias("x"))
    observed = {i: label[i] for i in near if i < 25}
    co = models.logistic(g.nodes.join(train.select("node_id"), "node_id", "left_semi").join(x, "node_id"), g.classes())
    w, b = co.coefficientMatrix.toArray(), np.array(co.interceptVector.toArray())
    first = {i: names[int(np.argmax(w @ np.array(feature[i]) + b))] for i in near}
    counts = lambda known: {i: [sum(known.get(n) == c for n in near[i]) for c in names] for i in near}
    cond = first | observed
    table = [(i, label[i], feature[i] + [float(v) for v in counts(cond)[i]]) for i in observed]
    rc = models.logistic(g.nodes.sparkSession.createDataFrame(table, "node_id long, label string, x array<double>"), g.classes())
    w, b = rc.coefficientMatrix.toArray(), np.array(rc.interceptVector.toArray())
    current = {i: first[i] for i in near if i >= 25} | observed
    for _ in range(10):
        for i in sorted(v for v in near if v >= 25):
            current[i] = names[int(np.argmax(w @ np.array(feature[i] + counts(current)[i]) + b))]
    got = {r["node_id"]: r["pred"] for r in models.collective(g, train, test, mode="exact").collect()}
    assert got == {i: current[i] for i in near if i >= 25}
    content = {r["node_id"]: r["pred"] for r in models.content_only(g, train, test).collect()}
    assert content == {i: first[i] for i in near if i >= 25}
    proba = {r["node_id"]: r["proba"] for r in models.probabilities(co, x).collect()}
    assert all(sum(p) == pytest.approx(1) and names[int(np.argmax(p))] == first[i] for i, p in proba.items())


def test_disagreement_sampler(small):
    """Seeds first, then draws from the pool (or the chosen clusters) until the budget is reached."""
    g, near, label, _ = small
    train = g.nodes.where("node_id % 4 <> 0")
    members = g.nodes.select((F.col("node_id") % 3).cast("int").alias("cluster"), "node_id")
    seeds = picks(sampling.seed_nodes(g, train, 4, 1))
    got = picks(models.alfnet(g, train, members, 10, k=4, seed=1, rounds=2))
    assert got[:4] == seeds and len(set(got)) == len(got) == 10 and all(v % 4 for v in got)


def test_dense_methods_are_bounded(small, monkeypatch):
    g, *_ = small
    monkeypatch.setattr(community, "MOST_NODES", 3)
    monkeypatch.setattr(community, "MOST_ROWS", 3)
    for f, word in ((lambda: community.modularity_clusters(g.edges, 5), "power"), (lambda: community.relational_kernel(g.features, g.edges), "power_iteration")):
        with pytest.raises(ValueError, match=word):
            f()
    monkeypatch.setattr(networks, "MOST_LABELLED", 3)
    with pytest.raises(ValueError, match="labelled"):
        models.simple_convolution(g, g.nodes, g.nodes)


def test_any_size_clusters(spark):
    e = undirected(spark.createDataFrame(CLIQUES, "src long, dst long"))
    parts = {}
    for r in community.modularity_clusters(e, 4, "power").collect():
        parts.setdefault(r["cluster"], set()).add(r["node_id"])
    assert sorted(map(sorted, parts.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert community.modularity_clusters(e, 100, "power").count() == 0
    pairs = e.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.when((F.col("u") == 3) & (F.col("v") == 4), 0.01).otherwise(1.0).alias("weight"))
    two = {r["id"]: r["cluster"] for r in community.power_iteration_clusters(pairs, 2).collect()}
    assert set(two) == set(range(8))


def test_kernel(small):
    g, near, _, feature = small
    ids, kernel = community.relational_kernel(g.features, g.edges)
    v = np.array([feature[i] for i in ids])
    z = (v - v.mean(axis=0)) / v.std(axis=0)
    gaps = [((z[i] - z[j]) ** 2).sum() for i in range(len(z)) for j in range(i)]
    gamma = np.median(gaps)
    a = np.array([[1.0 if j in near[i] else 0.0 for j in ids] for i in ids])
    rbf = np.exp(-gamma * np.array([[((x - y) ** 2).sum() for y in v] for x in v]))
    d = np.diag(1 / a.sum(axis=1))
    assert np.allclose(kernel, d @ a @ rbf @ a @ d)
    got = picks(community.medoids(g.features, g.edges, g.nodes, 3))
    clusters = dict(community.spectral_clusters(g.features, g.edges, 3)[0].collect())
    at = {x: i for i, x in enumerate(ids)}
    for m in got:
        own = [x for x in ids if clusters[x] == clusters[m]]
        mean = {x: np.mean([kernel[at[x], at[y]] for y in own]) for x in own}
        assert mean[m] == pytest.approx(max(mean.values()))


def paths(near):
    """(betweenness of nodes, of pairs) by all shortest paths."""
    ids = sorted(near)
    node, pair = dict.fromkeys(ids, 0.0), {}
    for s in ids:
        dist, wave, ways = {s: 0}, [s], {s: [[s]]}
        while wave:
            later = []
            for v in wave:
                for n in near[v]:
                    if n not in dist:
                        dist[n], ways[n] = dist[v] + 1, []
                        later.append(n)
                    if dist[n] == dist[v] + 1:
                        ways[n] += [w + [n] for w in ways[v]]
            wave = later
        for t, all_ in ways.items():
            for w in all_ if t != s else ():
                for v in w[1:-1]:
                    node[v] += 1 / len(all_)
                for u, v in zip(w[:-1], w[1:], strict=True):
                    pair[min(u, v), max(u, v)] = pair.get((min(u, v), max(u, v)), 0) + 1 / len(all_)
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in node.items()}, {k: x / (n * (n - 1)) for k, x in pair.items()}


def test_structural_features(small):
    g, near, *_ = small
    node, pair = paths(near)
    got = {r["node_id"]: r["features"] for r in structure.structural_features(g.edges).collect()}
    assert set(got) == set(near)
    for v, f in got.items():
        three = sum(b in near[a] for a in near[v] for b in near[v] if a < b)
        assert f[:4] == pytest.approx([len(near[v]), len(near[v]) / (len(near) - 1), three, node[v]])
    inside = structure.inside_betweenness(g.edges, g.nodes.where("node_id < 20")).first()[0]
    assert inside == pytest.approx(np.mean([x for (u, v), x in pair.items() if u < 20 and v < 20]))


def test_walks_and_capped_neighbourhoods(spark, small):
    g, near, *_ = small
    rows = {r["start"]: r["path"] for r in structure.walks_with_retries(g.adj, g.nodes, 6, 1).collect()}
    assert set(rows) == set(near) and any(rows.values())
    for start, path in rows.items():
        if path is not None:
            assert path[0] == start and len(set(path)) == 7 and all(b in near[a] for a, b in zip(path[:-1], path[1:], strict=True))
    line = undirected(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    short = {r["start"]: r["path"] for r in structure.walks_with_retries(adjacency(line), spark.createDataFrame([(1,), (2,)], "node_id long"), 2, 1).collect()}
    assert short == {1: [1, 2, 3], 2: None}
    got = {}
    for r in structure.capped_egos(g.edges, g.nodes, 2, 2, 9).collect():
        got.setdefault(r["ego"], set()).add(r["node"])
    for ego in near:
        members, wave = {ego}, {ego}
        for hop in range(2):
            wave = {near[v][int(uniform(9, "capped", ego, v, hop, i) * len(near[v]))] for v in wave for i in range(2)}
            members |= wave
        parts, left = [], set(members)
        while left:
            part, todo = set(), [min(left)]
            while todo:
                v = todo.pop()
                if v not in part:
                    part.add(v)
                    todo += [n for n in near[v] if n in left]
            parts.append(part)
            left -= part
        assert got[ego] == min(parts, key=lambda p: (-len(p), min(p)))


def test_index_and_names(spark, small):
    g, near, label, _ = small
    nodes, edges = indexed(g)
    at = {r["node_id"]: (r["idx"], r["class_idx"]) for r in nodes.collect()}
    assert at == {v: (i, "ab".index(label[v])) for i, v in enumerate(sorted(near))}
    assert {tuple(r) for r in edges.collect()} == {(at[u][0], at[v][0]) for u, v in g.edges.collect()}
    assert dense_index(g.nodes.limit(0), "node_id").count() == 0
    assert {r["label"] for r in relabelled(g.nodes, {"a": "z"}).collect()} == {"z", "b"}
    members = g.nodes.select("node_id", (F.col("node_id") % 3).alias("cluster"))
    got = {(r["node_id"], r["cluster"]): r["n"] for r in relational.neighbour_clusters(g.adj, members).collect()}
    assert got == {(v, c): sum(n % 3 == c for n in near[v]) for v in near for c in range(3) if any(n % 3 == c for n in near[v])}


def test_principal_components(small):
    g, _, _, feature = small
    ids = sorted(feature)
    v = np.array([feature[i] for i in ids])
    u, s, _ = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    got = {r["node_id"]: r["components"] for r in principal_components(g.features, 2).collect()}
    assert np.allclose(np.abs([got[i] for i in ids]), np.abs(u * s))


def test_network_loss_is_the_weighted_cross_entropy(spark):
    logits = np.array([[2.0, -1.0], [0.5, 0.25], [-40.0, 3.0], [0.0, 0.0]])
    y, w = np.array([0, 1, 0, 1]), np.array([2.0, 2.0, 2.0, 2.0])
    loss, gradient = networks.loss_and_gradient(logits, y, w)
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([("ab"[k], q.tolist()) for k, q in zip(y, p, strict=True)], "label string, proba array<double>")
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "label string, class_idx int")
    weights = relational.class_counts(rows)
    assert models.weighted_cross_entropy(rows, classes, weights).first()[0] == pytest.approx(loss)
    for i in (0, 1, 3):
        for j in range(2):
            moved = logits.copy()
            moved[i, j] += 1e-6
            assert (networks.loss_and_gradient(moved, y, w)[0] - loss) / 1e-6 == pytest.approx(gradient[i, j], abs=1e-4)


def test_networks_learn_planted_classes(spark):
    g = planted_graph(spark, 300, classes=3, homophily=0.9, signal=0.75, mean_degree=6.0, seed=2)
    g = RelGraph(g.nodes.cache(), g.edges.cache(), g.features.cache())
    split = sampling.stratified_split(g.nodes, 0.4, 1)
    train, test = split.where("is_train"), split.where("not is_train")
    content = accuracy(models.content_only(g, train, test), []).first()[0]
    for f in (models.simple_convolution, models.sampled_means):
        out = f(g, train, test)
        assert accuracy(out, []).first()[0] > max(0.75, content - 0.05), f.__name__
        assert out.count() == test.join(g.edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi").count()


def test_factory_matrix_and_log(spark, tmp_path):
    model, sample = experiment.method("wvrn", "ns_dc_h")
    assert model is models.wvrn
    with pytest.raises(ValueError, match="unknown method"):
        experiment.method("wvrn", "nothing")
    g = planted_graph(spark, 120, seed=4)
    g = RelGraph(g.nodes.cache(), g.edges.cache(), g.features.cache())
    pool = g.nodes.select("node_id")
    assert picks(sample(g, 5, pool, 1)) == picks(sampling.by_degree(g, 5, pool, 1))
    log = experiment.log_to(str(tmp_path / "log.txt"))
    configs = [ExperimentConfig("p", "wvrn", 1, 1, 16, 8, 16, ("rs", "ns_dc_h"))]
    out = experiment.run_matrix({"p": g}, configs, f"file://{tmp_path}/trials")
    assert {(r["algo"], r["budget"]) for r in out.collect()} == {("rs", 16), ("ns_dc_h", 16)}
    again = experiment.run_matrix({"p": g}, configs, f"file://{tmp_path}/trials", cached=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    for h in list(log.handlers):
        h.close()
        log.removeHandler(h)
    assert (tmp_path / "log.txt").read_text().count("budget 16") == 2
