"""Label aggregates over neighbourhoods and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import label_entropy
from .graph import degrees, induced


def class_counts(labelled: DataFrame) -> DataFrame:
    """(label, n, prior, balanced_weight, support_weight) of the classes that occur.

    prior: share; balanced_weight: rows / (classes x count); support_weight: rows / count.
    """
    per = labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # a row for each class
    total, kinds = F.sum("n").over(every), F.count("*").over(every)
    return per.select("label", "n", (F.col("n") / total).alias("prior"), (total / (kinds * F.col("n"))).alias("balanced_weight"), (total / F.col("n")).alias("support_weight"))


def overlay(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(node_id, label): the observed label where there is one, else the predicted."""
    seen = observed.select("node_id", F.col("label").alias("_seen"))
    return predicted.select("node_id", "label").join(seen, "node_id", "full").select("node_id", F.coalesce("_seen", "label").alias("label"))


def neighbour_counts(adj: DataFrame, cond: DataFrame) -> DataFrame:
    """(node_id, label, cnt): labelled neighbours of each class; only pairs that occur."""
    known = cond.where("label is not null").select(F.col("node_id").alias("nbr"), "label")
    return adj.join(known, "nbr").groupBy(F.col("node").alias("node_id"), "label").agg(F.count("*").alias("cnt"))


def neighbour_vectors(nodes: DataFrame, adj: DataFrame, cond: DataFrame, classes: list[str], kind: str = "count") -> DataFrame:
    """(node_id, agg): an array over ``classes`` of each node's neighbour counts, shares ('prop') or presence ('exist').

    Shares of a node without labelled neighbours are zeros.
    """
    if kind not in ("count", "prop", "exist"):
        raise ValueError(f"unknown aggregator {kind}")
    per = neighbour_counts(adj, cond).groupBy("node_id").agg(*[F.sum(F.when(F.col("label") == c, F.col("cnt"))).alias(f"_c{i}") for i, c in enumerate(classes)])
    cells = [F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("double") for i in range(len(classes))]
    return nodes.select("node_id").join(per, "node_id", "left").select("node_id", aggregate(F.array(*cells), kind).alias("agg"))


def aggregate(counts: Column, kind: str) -> Column:
    """Counts as they are, as shares of their sum, or clipped to one."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return {"count": counts, "prop": F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))), "exist": F.transform(counts, lambda x: F.least(x, F.lit(1.0)))}[kind]


def directed_vectors(nodes: DataFrame, arcs: DataFrame, cond: DataFrame, classes: list[str], kind: str = "count") -> DataFrame:
    """(node_id, agg): the aggregates over incoming and then over outgoing arcs (src, dst)."""
    into = neighbour_vectors(nodes, arcs.select(F.col("dst").alias("node"), F.col("src").alias("nbr")).distinct(), cond, classes, kind)
    out = neighbour_vectors(nodes, arcs.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct(), cond, classes, kind)
    return into.join(out.withColumnRenamed("agg", "_out"), "node_id").select("node_id", F.concat("agg", "_out").alias("agg"))


def majority_labels(members: DataFrame) -> DataFrame:
    """(cluster, label): the most frequent label of each cluster's labelled members, of equal ones the first in order."""
    per = members.where("label is not null").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "label")
    return per.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("cluster", "label")


def disagreement(members: DataFrame) -> DataFrame:
    """(cluster, score) from (cluster, node_id, label or null, co, cc): summed vote entropy of the unlabelled members.

    A node's votes are the cluster's majority label, if any member is labelled, and its two predictions.
    """
    top = majority_labels(members).withColumnRenamed("label", "_top")
    votes = F.filter(F.array("_top", "co", "cc"), lambda x: x.isNotNull())
    scored = members.join(top, "cluster", "left").select("cluster", F.when(F.col("label").isNull(), label_entropy(votes)).otherwise(F.lit(0.0)).alias("e"))
    return scored.groupBy("cluster").agg(F.sum("e").alias("score"))


def neighbour_clusters(adj: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, cluster, n): how many neighbours each node has in each cluster that they are in."""
    of = members.select(F.col("node_id").alias("nbr"), "cluster")
    return adj.join(of, "nbr").groupBy(F.col("node").alias("node_id"), "cluster").agg(F.count("*").alias("n"))


def cluster_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, u, v): the edges inside each cluster, which with its members are its graph."""
    u, v = (members.select(F.col("node_id").alias(c), F.col("cluster").alias(f"_{c}")) for c in "uv")
    return edges.join(u, "u").join(v, "v").where("_u = _v").select(F.col("_u").alias("cluster"), "u", "v")


def top_clusters(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "cluster").limit(k)


def label_statistics(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """(avg_degree, share_std, count_std): mean degree among the labelled, and the spread of their classes."""
    inner = induced(edges, labelled)
    d = labelled.select("node_id").distinct().join(degrees(inner), "node_id", "left").agg(F.avg(F.coalesce("degree", F.lit(0))).alias("avg_degree"))
    per = class_counts(labelled)
    return d.crossJoin(per.agg(F.stddev_pop("prior").alias("share_std"), F.stddev_pop("n").alias("count_std")))
