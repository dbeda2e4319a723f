"""Grown graphs against the rule carried out one node and one link after the other."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.rng import plain_fine
from quillgraph.plans import growth
from quillgraph.sources.tables import load_graph


def draw(u, ends):
    return next(c for upper, c in ends if u < upper)


def one_by_one(n, classes, homophily, balance, seed, roots=10):
    shares, out = growth.class_shares(classes, balance, seed), []
    for v in range(n):
        u = plain_fine(seed, "class", v)
        if v < roots:
            out.append((None, draw(u, growth.cuts(shares))))
            continue
        parent = int(plain_fine(seed, "parent", v) * v)
        c = out[parent][1]
        out.append((parent, c if plain_fine(seed, "same", v) < homophily else draw(u, growth.cuts(shares, c))))
    return out


def link_by_link(grown, links, homophily, seed, rounds=30):
    n, members = len(grown), {}
    for v, (_, c) in enumerate(grown):
        members.setdefault(c, []).append(v)
    edges = {(p, v) for v, (p, _) in enumerate(grown) if p is not None}
    for turn in range(rounds):
        new = set()
        for i in range(links - len(edges)):
            a = int(plain_fine(seed, "from", turn, i) * n)
            same = plain_fine(seed, "alike", turn, i) < homophily
            near = [v for c in sorted(members) for v in members[c] if (c == grown[a][1]) == same and v != a]
            if near:
                b = near[int(plain_fine(seed, "to", turn, i) * len(near))]
                new.add((min(a, b), max(a, b)))
        edges |= new
        if len(edges) >= links:
            break
    return edges


@pytest.mark.parametrize(("n", "classes", "homophily", "balance", "head"), [(400, 3, 0.7, 0.4, 50), (300, 5, 0.1, 1.0, 65_536), (12, 2, 0.5, 0.9, 65_536), (7, 2, 0.5, 1.0, 10), (60, 1, 0.2, 1.0, 20)])
def test_classes_are_those_of_the_sequence(spark, n, classes, homophily, balance, head):
    got = {r["node_id"]: (r["parent"], r["c"]) for r in growth.grown_nodes(spark, n, classes, homophily, balance, 5, head=head).collect()}
    assert got == dict(enumerate(one_by_one(n, classes, homophily, balance, 5)))


def test_no_nodes(spark):
    assert growth.grown_nodes(spark, 0).isEmpty()
    g = growth.grown_graph(spark, 0)
    assert g.nodes.isEmpty() and g.edges.isEmpty() and g.features.isEmpty()


def test_a_chain_is_composed(spark):
    # every node hangs on the one before it: the deepest tree there is
    rows = [(v, v - 1, v - 1, [1, 2, 0] if v % 3 else [0, 1, 2]) for v in range(1, 40)]
    chain = spark.createDataFrame(rows, "node_id long, parent long, ptr long, to_class array<int>")
    known = spark.createDataFrame([(0, 1)], "node_id long, c int")
    got = {r["node_id"]: r["c"] for r in growth._resolve(chain, known, 1).collect()}
    c, want = 1, {}
    for v, _, _, f in rows:
        c = want[v] = f[c]
    assert got == want


@pytest.mark.parametrize(("links", "homophily"), [(120, 0.8), (20, 0.5), (1200, 0.3)])
def test_links_are_those_of_the_sequence(spark, links, homophily, monkeypatch):
    monkeypatch.setattr(growth, "BLOCK", 7)
    nodes = growth.grown_nodes(spark, 60, 3, homophily, 0.5, 3)
    got = [tuple(r) for r in growth.grown_links(nodes, 60, links, homophily, 3).select("u", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == link_by_link(one_by_one(60, 3, homophily, 0.5, 3), links, homophily, 3)
    assert len(got) == max(links, 50) if links < 1000 else len(got) > 900


def test_features_follow_their_distributions(spark):
    n, kinds, seed = 20_000, ("binomial", "normal", "beta"), 1
    rules = growth.attribute_rules(1, 9, kinds, seed)[0]
    assert {k for k, _, _ in rules} == set(kinds)
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.lit(0).alias("c"))
    table = growth.grown_features(nodes, 1, 9, kinds, seed)
    for i, (kind, a, b) in enumerate(rules):
        values = [r[0] for r in table.select(F.col("features")[i]).collect()]
        mean, variance = {"binomial": (a, a * (1 - a)), "normal": (a, b * b), "beta": (a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1)))}[kind]
        assert statistics.fmean(values) == pytest.approx(mean, abs=5 * math.sqrt(variance / n))
        assert statistics.pvariance(values) == pytest.approx(variance, rel=0.06, abs=1e-3)


def test_homophily_is_near_what_was_asked(spark):
    g = growth.grown_graph(spark, 3000, classes=4, links=9000, homophily=0.85, balance=0.8, attributes=3, seed=2)
    label = {r[0]: r[1] for r in g.nodes.collect()}
    edges = g.edges.collect()
    assert len(edges) == 9000 and sum(label[a] == label[b] for a, b in edges) / 9000 == pytest.approx(0.85, abs=0.03)


def test_categories_are_written_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/synth"
    table = growth.write_categories(spark, path, {"num_nodes": 120, "density": 0.04}, [{"homophily": 0.9}, {"num_attributes": 4, "density": 0.15}], 2, 0.4, 1, ("normal", "beta"))
    values = {(r["category"], r["graph"], r["name"]): r["value"] for r in table.collect()}
    assert len(values) == 24 and all(0.05 <= values[0, i, "homophily"] <= 0.95 and values[1, i, "homophily"] == 0.8 and 0.0001 <= values[1, i, "density"] <= 0.2 for i in (0, 1))
    assert values[1, 0, "density"] != values[1, 1, "density"]
    for c, i in [(0, 0), (0, 1), (1, 0), (1, 1)]:
        g = load_graph(spark, path, f"cat{c:02d}.graph{i:02d}")
        assert g.edges.count() == max(math.ceil(values[c, i, "density"] * 120 * 119 / 2), 110)
        assert g.features.select(F.size("features")).distinct().collect() == [(int(values[c, i, "num_attributes"]),)]


def test_kinds_are_known():
    with pytest.raises(ValueError, match="binomial"):
        growth.attribute_rules(2, 2, ("poisson",), 0)
