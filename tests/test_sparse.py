"""Sparse vectors from the reader to propagation and regression, against whole arrays."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import sparse
from quillgraph.operators import models
from quillgraph.operators.graph import RelGraph, build
from quillgraph.operators.propagate import propagate
from quillgraph.plans.synth import planted_graph
from quillgraph.sources import tables


def as_dict(df, column="features"):
    return {r["node_id"]: [(e["pos"], e["value"]) for e in r[column]] for r in df.collect()}


def test_there_and_back(spark):
    rows = spark.createDataFrame([(0, [0.0, 2.0, None, -1.0]), (1, []), (2, [0.0])], "node_id int, features array<double>")
    thin = rows.withColumn("features", sparse.from_dense("features"))
    assert sparse.is_sparse(thin, "features") and not sparse.is_sparse(rows, "features")
    assert as_dict(thin) == {0: [(1, 2.0), (3, -1.0)], 1: [], 2: []}
    assert sparse.width_of(thin) == 4 and sparse.width_of(thin.where("node_id > 0")) == 0
    back = {r[0]: r[1] for r in thin.select("node_id", sparse.to_dense("features", 4)).collect()}
    assert back == {0: [0, 2, 0, -1], 1: [0, 0, 0, 0], 2: [0, 0, 0, 0]}


def test_several_files_with_headers(spark, tmp_path):
    (tmp_path / "a.tab").write_text("NODE\tpaper\ncat=1,2:label\tnumeric:w-a:0.0\tnumeric:w-b:0.0\tsummary\n1\tlabel=2\tw-b=0.5\tsummary=w-b\n2\tlabel=1\tw-a=x\tw-z=3\tsummary=\n")
    (tmp_path / "b.tab").write_text("NODE\tpaper\ncat=1,2:label\tnumeric:w-c:0.0\tnumeric:w-b:0.0\tsummary\n3\tlabel=1\tw-c=1.5\tw-b=2\tsummary=w-c\n")
    (tmp_path / "c.tab").write_text("4\tlabel=a=b\n")
    rows, words = tables.sparse_content(spark, f"file://{tmp_path}")
    assert {r["word"]: r["pos"] for r in words.collect()} == {"w-a": 0, "w-b": 1, "w-c": 2}
    assert as_dict(rows) == {"1": [(1, 0.5)], "2": [], "3": [(1, 2.0), (2, 1.5)], "4": []}
    assert {r["node_id"]: r["label"] for r in rows.collect()} == {"1": "2", "2": "1", "3": "1", "4": "a=b"}


def test_wide_vocabulary(spark, tmp_path):
    rng, width = random.Random(4), 50_000
    (tmp_path / "head.tab").write_text("NODE\ncat=1,2:label\t" + "\t".join(f"numeric:w{i}:0.0" for i in range(width)) + "\tsummary\n")
    truth = {str(n): sorted(rng.sample(range(width), 12)) for n in range(300)}
    (tmp_path / "rows.tab").write_text("".join(f"{n}\tlabel={int(n) % 2}\t" + "\t".join(f"w{i}=1" for i in at) + "\tsummary\n" for n, at in truth.items()))
    rows, words = tables.sparse_content(spark, f"file://{tmp_path}")
    assert words.count() == width and as_dict(rows) == {n: [(i, 1.0) for i in at] for n, at in truth.items()}
    edges = spark.createDataFrame([(str(n), str(n + 1)) for n in range(299)], "u string, v string")
    got = as_dict(propagate(rows.select("node_id", "features"), edges, "squared"))
    degree = lambda n: 2 if n in (0, 299) else 3
    want = {}
    for i in range(300):
        for j in (i - 1, i, i + 1):
            for at in truth.get(str(j), []):
                want[i, at] = want.get((i, at), 0) + degree(i) * degree(j)
    assert {(int(n), pos): v for n, e in got.items() for pos, v in e} == want


@pytest.mark.parametrize(("norm", "hops"), [("squared", 1), ("sym", 2)])
def test_propagation_as_with_arrays(spark, norm, hops):
    g = planted_graph(spark, 80, features=7, seed=6)
    whole = {r[0]: r[1] for r in propagate(g.features, g.edges, norm, hops).collect()}
    thin = propagate(g.features.withColumn("features", sparse.from_dense("features")), g.edges, norm, hops)
    got = {r[0]: r[1] for r in thin.select("node_id", sparse.to_dense("features", 7)).collect()}
    assert set(got) == set(whole) and all(got[n] == pytest.approx(whole[n], rel=1e-9) for n in whole)


def test_regression_as_with_arrays(spark):
    g = planted_graph(spark, 200, classes=2, features=9, signal=0.8, seed=8)
    thin = RelGraph(g.nodes, g.edges, g.features.withColumn("features", sparse.from_dense("features")))
    train, test = g.nodes.where("node_id % 2 = 0"), g.nodes.where("node_id % 2 = 1")
    a, b = ({r["node_id"]: r["pred"] for r in models.content_only(x, train, test).collect()} for x in (g, thin))
    assert a == b and len(a) == test.count()


def test_nodes_with_nothing(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "node_id int, label string")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "u int, v int")
    features = nodes.select("node_id", F.when(F.col("node_id") == 0, sparse.from_dense(F.array(F.lit(0.0), F.lit(3.0)))).otherwise(F.array().cast(sparse.TYPE)).alias("features"))
    g = build(nodes, edges, features)
    assert as_dict(propagate(g.features, g.edges)) == {0: [(1, 12.0)], 1: [(1, 18.0)], 2: []}
    assert as_dict(propagate(g.features.limit(0), g.edges)) == {}
