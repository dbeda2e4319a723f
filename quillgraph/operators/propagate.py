"""Feature propagation over edges, as joins and sums of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sparse import TYPE, gathered, is_sparse
from ..functions.vectors import scaled, vector_sums, width_of
from .graph import adjacency


def coo(edges: DataFrame) -> DataFrame:
    """Adjacency matrix as (i, j, w)."""
    return adjacency(edges).select(F.col("node").alias("i"), F.col("nbr").alias("j"), F.lit(1.0).alias("w"))


def row_sums(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node").agg(F.count("*").cast("double").alias("d"))


def weights(edges: DataFrame, nodes: DataFrame, norm: str = "squared") -> DataFrame:
    """(i, j, w) of the propagation matrix over A + I.

    'squared': (1 + d_i)(1 + d_j) (A + I)_ij^2, d the row sums of A and a self-loop giving 2 on the
    diagonal; 'sym': (A + I)_ij / sqrt((1 + d_i)(1 + d_j)), the usual symmetric normalisation.
    """
    side = nodes.select(F.col("node_id").alias("i")).join(_sides(edges, nodes, norm).withColumnRenamed("node_id", "i"), "i")
    arcs = arc_weights(edges, nodes, norm)
    joined = arcs.join(side, "i").join(side.select(F.col("i").alias("j"), F.col("side").alias("other")), "j")
    return joined.select("i", "j", (F.col("w") * F.col("side") * F.col("other")).alias("w"))


def _sides(edges: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """(node_id, side): the factor of a node's row and column."""
    d = nodes.select("node_id").join(row_sums(edges).withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", (F.coalesce("d", F.lit(0.0)) + 1).alias("d"))
    return d.select("node_id", (F.col("d") if norm == "squared" else 1 / F.sqrt("d")).alias("side"))


def arc_weights(edges: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """(i, j, w) of A + I, its elements squared for 'squared'; an element for each pair, so nothing has to be added up."""
    power = 2.0 if norm == "squared" else 1.0
    loops = edges.where("u = v").select(F.col("u").alias("i"), F.lit(1.0).alias("own"))
    diagonal = nodes.select(F.col("node_id").alias("i")).join(loops, "i", "left").select("i", F.col("i").alias("j"), F.pow(1 + F.coalesce("own", F.lit(0.0)), F.lit(power)).alias("w"))
    return coo(edges.where("u <> v")).unionByName(diagonal)


def propagate(features: DataFrame, edges: DataFrame, norm: str = "squared", hops: int = 1) -> DataFrame:
    """(node_id, features) after ``hops`` multiplications by the matrix.

    The factors of rows and columns are applied to the vectors, so a hop is one join of arcs with vectors and one sum of
    vectors: what is shuffled is a vector for each node on the way in and for each node and task on the way out.
    Arcs of a node without features bring nothing.  Sparse vectors stay sparse.
    """
    if is_sparse(features, "features"):
        return _propagate_sparse(features, edges, norm, hops)
    width = width_of(features)
    side = _sides(edges, features, norm)
    arcs = arc_weights(edges, features, norm)
    current = features.select("node_id", "features").join(side, "node_id")
    for hop in range(hops):
        sent = current.select(F.col("node_id").alias("j"), scaled(F.col("features"), F.col("side")).alias("features"))
        near = arcs.join(sent, "j").select(F.col("i").alias("node_id"), "w", "features")
        summed = vector_sums(near, ["node_id"], "features", width, F.col("w")).join(side, "node_id")
        current = summed.withColumn("features", scaled(F.col("features"), F.col("side")))
    return current.select("node_id", "features")


def _propagate_sparse(features: DataFrame, edges: DataFrame, norm: str, hops: int) -> DataFrame:
    """As ``propagate``: an arc brings the elements that its vector has, added up in each task before they are shuffled."""
    side = _sides(edges, features, norm)
    arcs = arc_weights(edges, features, norm)
    nodes, current = features.select("node_id"), features.select("node_id", "features").join(side, "node_id")
    for _ in range(hops):
        sent = current.select(F.col("node_id").alias("j"), "side", F.explode("features").alias("e"))
        near = arcs.join(sent, "j").select(F.col("i").alias("node_id"), F.col("e.pos").alias("pos"), (F.col("w") * F.col("side") * F.col("e.value")).alias("value"))
        back = side.join(gathered(near, "node_id"), "node_id")
        current = back.withColumn("features", F.transform("features", lambda e: F.struct(e["pos"].alias("pos"), (e["value"] * F.col("side")).alias("value"))))
    # a node whose neighbours have nothing keeps an empty vector
    return nodes.join(current, "node_id", "left").select("node_id", F.coalesce("features", F.array().cast(TYPE)).alias("features"))
