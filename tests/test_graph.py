"""Small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.metrics import accuracy, label_entropy, micro_f1
from quillgraph.operators import community, models, propagate, relational, sampling, structure
from quillgraph.operators.components import connected_components
from quillgraph.operators.graph import RelGraph, adjacency, build, components, counts, degrees, homophily, largest_component, undirected
from quillgraph.plans.synth import parameter_grid, planted_graph

TAIL = [(1, 2), (2, 3), (1, 3), (3, 4)]
CLIQUES = [(a, b) for base in (0, 4) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 4)]


def edges(spark, pairs):
    return undirected(spark.createDataFrame(pairs, "src long, dst long"))


def nodes(spark, labels):
    return spark.createDataFrame(list(labels.items()), "node_id long, label string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def colours(spark, pairs):
    e = edges(spark, pairs)
    members = e.select(F.explode(F.array("u", "v")).alias("node")).distinct().select(F.lit(0).alias("ego"), "node")
    return {r["node"]: r["colour"] for r in structure.refine_colours(members, adjacency(e).select(F.lit(0).alias("ego"), "node", "nbr")).collect()}


def test_triangle_with_tail(spark):
    e = edges(spark, TAIL)
    assert as_dict(degrees(e)) == {1: 2, 2: 2, 3: 3, 4: 1}
    assert as_dict(structure.triangles(e)) == {1: 1, 2: 1, 3: 1, 4: 0}
    assert as_dict(structure.clustering(e)) == pytest.approx({1: 1.0, 2: 1.0, 3: 1 / 3, 4: 0.0})
    assert counts(RelGraph(nodes(spark, dict.fromkeys(range(1, 5), "x")), e)).first()["density"] == pytest.approx(4 / 6)
    assert colours(spark, TAIL) == {1: 2, 2: 2, 3: 3, 4: 1}


def test_other_colours(spark):
    assert colours(spark, [(0, i) for i in range(1, 6)]) == {0: 2} | dict.fromkeys(range(1, 6), 1)
    assert colours(spark, [(1, 2), (2, 3), (3, 4), (4, 5)]) == {1: 1, 2: 2, 3: 3, 4: 2, 5: 1}
    assert colours(spark, CLIQUES) == {i: 2 if i in (3, 4) else 1 for i in range(8)}


def test_hops_take_the_seed_back(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    seed = spark.createDataFrame([(1,)], "node_id long")
    assert {r["node"] for r in structure.hops(adjacency(e), seed, 2).collect()} == {1, 2, 3}
    assert {r["node"] for r in structure.hops(adjacency(e), seed, 1).collect()} == {2}


def test_build_makes_a_simple_graph(spark):
    g = build(nodes(spark, dict.fromkeys((1, 2, 3, 5), "x")), spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (1, 9), (None, 2)], "src long, dst long"))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2), (3, 3)]
    assert sorted(r[0] for r in g.nodes.collect()) == [1, 2, 3]
    assert as_dict(degrees(g.edges)) == {1: 1, 2: 1, 3: 2}


def test_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (4, 5), (6, 7), (8, 8)])
    assert as_dict(components(e)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    g = largest_component(RelGraph(nodes(spark, dict.fromkeys(range(1, 9), "x")), e))
    assert sorted(r[0] for r in g.nodes.collect()) == [1, 2, 3]
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["component"] for r in connected_components(path).collect()} == {0}


def test_cliques(spark):
    e = edges(spark, CLIQUES)
    n = nodes(spark, {i: "a" if i < 4 else "b" for i in range(8)})
    assert homophily(e, n).first()[0] == pytest.approx(12 / 13)
    parts = community.modularity_clusters(e, 1, "leading_eigenvector").groupBy("cluster").agg(F.sort_array(F.collect_set("node_id"))).collect()
    assert community.modularity_clusters(e, 100).count() == 0
    assert {frozenset(community.modularity_clusters(e, 4, "leading_eigenvector").where(F.col("cluster") == c).select("node_id").toPandas()["node_id"]) for c in (0, 1)} == {frozenset(range(4)), frozenset(range(4, 8))}
    assert sum(len(p[1]) for p in parts) == 8
    two = as_dict(community.power_bisection(e).select("node_id", "cluster"))
    assert len({two[i] for i in range(4)}) == 1 and two[0] != two[7]


def test_neighbour_vote(spark):
    e = edges(spark, [(0, 1), (0, 2), (0, 3), (0, 4)] + [(10, i) for i in range(11, 16)])
    labels = {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"} | {10: "b"} | dict.fromkeys(range(11, 16), "b")
    g = RelGraph(nodes(spark, labels), e)
    train = g.nodes.where("node_id in (1, 2, 3, 11, 12, 13, 14, 15)")
    got = {r["node_id"]: r["pred"] for r in models.wvrn(g, train, g.nodes.where("node_id = 0")).collect()}
    assert got == {0: "a"}  # a: 2 + 2/8, b: 1 + 6/8


def test_measures(spark):
    rows = spark.createDataFrame(list(zip("aabc", "abbb", strict=True)), "label string, pred string")
    assert micro_f1(rows, []).first()["f1"] == pytest.approx(4 / 7)
    assert accuracy(rows, []).first()["accuracy"] == 0.5
    got = spark.createDataFrame([(["0", "1"],), (["0", "0"],), (["0", "1", "1"],), ([],)], "l array<string>").select(label_entropy(F.col("l"))).collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 0.0, 0.9182958, 0.0])


def test_aggregators(spark):
    e = edges(spark, [(0, 1), (0, 2), (0, 3), (4, 5)])
    g = RelGraph(nodes(spark, {0: "a", 1: "a", 2: "a", 3: "b", 4: "a", 5: None}), e)
    known = g.nodes.where("node_id <> 5")
    for kind, want in (("count", [2.0, 1.0]), ("prop", [2 / 3, 1 / 3]), ("exist", [1.0, 1.0])):
        got = as_dict(relational.neighbour_vectors(g.nodes, g.adj, known, ["a", "b"], kind))
        assert got[0] == pytest.approx(want) and got[4] == [0.0, 0.0]
    with pytest.raises(ValueError):
        relational.neighbour_vectors(g.nodes, g.adj, known, ["a"], "other")


def test_propagation_matches_dense(spark):
    import numpy as np

    e = edges(spark, [*TAIL, (4, 4)])
    x = np.array([[1.0, 2.0], [0.0, 1.0], [3.0, 1.0], [2.0, 2.0]])
    f = spark.createDataFrame([(i + 1, x[i].tolist()) for i in range(4)], "node_id long, features array<double>")
    a = np.zeros((4, 4))
    for u, v in [*TAIL, (4, 4)]:
        a[u - 1, v - 1] = a[v - 1, u - 1] = 1
    d = a.sum(axis=1) + 1
    for norm, s in (("squared", np.outer(d, d) * (a + np.eye(4)) ** 2), ("sym", (a + np.eye(4)) / np.sqrt(np.outer(d, d)))):
        got = as_dict(propagate.propagate(f, e, norm))
        assert np.allclose([got[i + 1] for i in range(4)], s @ x)


def test_path_centralities(spark):
    n, pairs = structure.path_centralities(edges(spark, [(1, 2), (2, 3)]))
    got = {r["node_id"]: (r["betweenness"], r["closeness"]) for r in n.collect()}
    assert got[2] == (1.0, 1.0) and got[1] == (0.0, pytest.approx(2 / 3))
    assert {(r["u"], r["v"]): r["betweenness"] for r in pairs.collect()} == pytest.approx({(1, 2): 4 / 6, (2, 3): 4 / 6})


def test_walks(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    got = structure.random_walks(adjacency(e), spark.createDataFrame([(1,)], "node_id long"), 5, 3, True).first()["path"]
    assert got == [1, 2, 3, 4]


def test_samplers_keep_their_bounds(spark):
    g = planted_graph(spark, 80, seed=3)
    pool = sampling.stratified_split(g.nodes, 0.8, 1).where("is_train").select("node_id").cache()
    inside = {r[0] for r in pool.collect()}
    for name in sorted(set(sampling.REGISTRY) - {"wls_3"}):
        first = [tuple(r) for r in sampling.select(name, g, 10, pool, 5).orderBy("ord").collect()]
        ids = [i for i, _ in first]
        assert len(ids) == len(set(ids)) <= 10 and set(ids) <= inside, name
        assert [o for _, o in first] == list(range(1, len(ids) + 1)), name
        if name in ("rs", "es_rs", "ss", "ns_dc_h"):
            again = [tuple(r) for r in sampling.select(name, g, 10, pool.repartition(7), 5).orderBy("ord").collect()]
            assert first == again, name
    assert sampling.select("rs", g, 10_000, pool, 5).count() == len(inside)


def test_models_find_planted_classes(spark):
    g = planted_graph(spark, 240, classes=2, homophily=0.9, signal=0.8, seed=2)
    split = sampling.stratified_split(g.nodes, 0.5, 1)
    train, test = split.where("is_train"), split.where("not is_train")
    for f in (models.content_only, models.simple_convolution, models.wvrn):
        assert accuracy(f(g, train, test), []).first()[0] > 0.7, f.__name__
    both = [models.collective(g, train, test, rounds=3, mode=m) for m in ("parallel", "exact")]
    assert all(accuracy(x, []).first()[0] > 0.8 for x in both)


def test_parameter_grid(spark):
    rows = parameter_grid(spark, {"h": 0.9, "n": 100.0}, 5, 0.1).collect()
    assert len(rows) == 10 and all(0 <= r["value"] <= 1 for r in rows if r["name"] == "h")


def test_nearest_unused(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "node_id long, features array<double>")
    got = sampling.nearest_unused(points, [[0.1], [0.2], [0.3]]).orderBy("ord").collect()
    assert [r["node_id"] for r in got] == [1, 2, 3]
