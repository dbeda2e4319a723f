"""Connected components by alternating star contractions, with a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns u, v); component is the least node reachable.

    Every round rewires each node to the least neighbour it knows, first from above, then from
    below, until the edges are stars.  A hub costs no more than its degree: minima are combined
    before the shuffle and the joins can be split where a key is hot.  Null ends are dropped,
    self-loops keep their node, repeated edges count once, no edges give no rows.
    """
    valid = edges.select("u", "v").where("u is not null and v is not null")
    current = scratch.materialise(valid.distinct(), "edges")
    nodes = current.select(F.col("u").alias("node")).union(current.select(F.col("v").alias("node"))).distinct()
    mark = None
    work = current.where("u <> v")
    for _ in range(max_rounds):
        following = scratch.materialise(_small_star(_large_star(work)), "stars")
        if mark is not None:
            scratch.drop(work)
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work = following
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(work.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
