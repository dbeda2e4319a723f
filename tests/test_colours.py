"""Colour refinement inside tasks and by joins, and neighbourhoods that have the same nodes."""

from __future__ import annotations

import random

from quillgraph.functions.vectors import primes
from quillgraph.operators import sampling, structure
from quillgraph.operators.graph import RelGraph


def _random_edges(spark, n, m, loops=0):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(i, i) for i in range(loops)}
    return spark.createDataFrame(sorted(pairs), "u long, v long")


def _egos(spark, n=40, m=60):
    edges = _random_edges(spark, n, m, 3)
    members, inner = structure.egos(edges, spark.range(n).withColumnRenamed("id", "node_id"), 2)
    return members.localCheckpoint(), inner.localCheckpoint()


def test_primes_by_sieve():
    assert primes(0) == [] and primes(10) == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert len(primes(200_000)) == 200_000 and primes(200_000)[-1] == 2_750_159


def test_colours_in_tasks_equal_joins(spark, monkeypatch):
    members, inner = _egos(spark)
    for rounds in (1, 2, 20):
        plain = sorted(map(tuple, structure._refine_by_joins(members, inner, rounds).collect()))
        assert sorted(map(tuple, structure.refine_colours(members, inner, rounds).collect())) == plain
    # egos cut over many batches, and some too large for a task
    monkeypatch.setattr(structure, "IN_ONE_TASK", 60)
    assert 0 < members.groupBy("ego").count().where("count > 15").count()
    assert sorted(map(tuple, structure.refine_colours(members, inner).collect())) == plain


def test_rows_are_gathered_to_whole_egos(spark):
    members, inner = _egos(spark)
    plain = sorted(map(tuple, structure._refine_by_joins(members, inner).collect()))
    rows = members.selectExpr("ego", "node", "cast(null as long) nbr").unionByName(inner).orderBy("ego").toArrow()
    before, structure.GATHERED = structure.GATHERED, 50
    try:
        got = [r for b in structure._refined_batches(rows.to_batches(max_chunksize=7), 20) for r in zip(*b.to_pydict().values(), strict=True)]
    finally:
        structure.GATHERED = before
    assert sorted(got) == plain


def test_same_neighbourhoods_are_refined_once(spark, monkeypatch):
    # in a complete graph all neighbourhoods are the pool: one of the eight is refined in each turn
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)], "u long, v long")
    nodes = spark.range(12).selectExpr("id AS node_id", "'a' AS label")
    seen, whole = [], structure.refine_colours
    monkeypatch.setattr(sampling, "refine_colours", lambda m, i: seen.append(m.select("ego").distinct().count()) or whole(m, i))
    got = sampling.select("wls_3", RelGraph(nodes, edges), 2, nodes, 7).collect()
    assert len(got) == 2 and set(seen) == {1}


def test_turns_in_one_task_equal_jobs(spark, monkeypatch):
    """The picks of the jobs of joins, without any of them: dense and sparse pools, self-loops, nodes alone, ids as texts."""
    for n, m, kind in ((14, 60, "long"), (60, 50, "long"), (30, 60, "string")):
        edges = _random_edges(spark, n, m, 3).selectExpr(f"cast(u as {kind}) u", f"cast(v as {kind}) v")
        nodes = spark.range(n + 2).selectExpr(f"cast(id as {kind}) AS node_id", "'a' AS label")
        pool = nodes.where("cast(node_id as long) % 5 <> 1")
        if kind == "string":
            edges = edges.selectExpr("least(u, v) u", "greatest(u, v) v")
        g = RelGraph(nodes, edges)
        want = sorted(map(tuple, sampling.by_colour(g, 6, pool, 7, k=4, nhops=3).select("ord", "node_id").collect()))
        with monkeypatch.context() as c:
            c.setattr(sampling, "FEW_EDGES", 0)
            c.setattr(sampling, "_colour_picks", None)
            got = sorted(map(tuple, sampling.by_colour(g, 6, pool, 7, k=4, nhops=3).select("ord", "node_id").collect()))
        assert got == want and len(got) == 6
