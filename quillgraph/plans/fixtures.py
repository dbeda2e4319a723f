"""Graph views over the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import min_max
from ..operators.graph import RelGraph, build
from . import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the first and second line of one order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    b = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src <> dst").select("src", "dst")


def co_order(spark: SparkSession, sf_dir: str) -> RelGraph:
    """Parts that were ordered together; labels are part types, features size and price, scaled."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label"))
    raw = part.select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("p"))
    scaled = min_max(min_max(raw, "s"), "p")
    return build(nodes, co_order_edges(spark, sf_dir), scaled.select("node_id", F.array("s", "p").alias("features")))


def vector_graph(spark: SparkSession, sf_dir: str) -> RelGraph:
    """Embeddings joined by keys of line items modulo their number; has self-loops."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    nodes = e.select(F.col("vec_id").alias("node_id"), F.col("label").cast("string").alias("label"))
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == 1)
    edges = lines.select((F.col("l_partkey") % n).alias("src"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("dst"))
    return build(nodes, edges, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("features")))


def written(g: RelGraph) -> RelGraph:
    """The graph as scratch tables, so that what uses it often doesn't derive it each time."""
    return RelGraph(scratch.materialise(g.nodes, "nodes"), scratch.materialise(g.edges, "graph"), None if g.features is None else scratch.materialise(g.features, "features"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(algo, trial, budget, f1) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("algo"), (F.col("user_id") % 5).cast("int").alias("trial"), (32 * (1 + F.col("event_id") % 7)).cast("int").alias("budget"), F.col("value").alias("f1"))


#: SQL of ``co_order``: n (nodes), e (edges), a (both directions), g (nodes with an edge), f (features).
F1 = """
e AS (SELECT DISTINCT least(x.l_partkey, y.l_partkey) AS u, greatest(x.l_partkey, y.l_partkey) AS v
      FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey
      WHERE x.l_linenumber = 1 AND y.l_linenumber = 2 AND x.l_partkey <> y.l_partkey),
a AS (SELECT u AS node, v AS nbr FROM e UNION SELECT v, u FROM e),
g AS (SELECT p_partkey AS node_id, p_type AS label FROM part WHERE p_partkey IN (SELECT node FROM a)),
m AS (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS p0, max(p_retailprice) AS p1 FROM part),
f AS (SELECT p_partkey AS node_id, (p_size - s0) / CAST(s1 - s0 AS DOUBLE) AS s, (p_retailprice - p0) / (p1 - p0) AS p FROM part, m WHERE p_partkey IN (SELECT node FROM a))
"""
#: SQL of ``vector_graph``, the same names; features stay in the embeddings.
F2 = """
c AS (SELECT count(*) AS n FROM embeddings),
r AS (SELECT l_partkey % n AS x, (l_orderkey * 7 + l_suppkey) % n AS y FROM lineitem, c WHERE l_linenumber = 1),
e AS (SELECT DISTINCT least(x, y) AS u, greatest(x, y) AS v FROM r),
a AS (SELECT u AS node, v AS nbr FROM e UNION SELECT v, u FROM e),
g AS (SELECT vec_id AS node_id, CAST(label AS VARCHAR) AS label FROM embeddings WHERE vec_id IN (SELECT node FROM a))
"""
TRIALS = "t AS (SELECT event_type AS algo, CAST(user_id % 5 AS INT) AS trial, CAST(32 * (1 + event_id % 7) AS INT) AS budget, value AS f1 FROM events)"
