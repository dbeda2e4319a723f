"""Relational classifiers: model(graph, train, test, ...) -> (node_id, label, pred)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sparse import is_sparse, ml_vectors
from ..functions.sparse import width_of as sparse_width
from ..functions.vectors import vector_sums, width_of
from ..plans import scratch
from .graph import RelGraph
from .networks import sampled_means, simple_convolution
from .relational import class_counts, disagreement, neighbour_vectors, overlay, top_clusters
from .sampling import random_nodes, seed_nodes
from .structure import sampled_neighbours


def wvrn(g: RelGraph, train: DataFrame, test: DataFrame) -> DataFrame:
    """Weighted vote of the neighbours, in one pass: a labelled neighbour votes for its label, any other by the class shares.

    Ties go to the first class in order; test nodes without neighbours get no row.
    """
    labelled = g.nodes.join(train.select("node_id"), "node_id", "left_semi").select("node_id", "label")
    prior = class_counts(labelled).select("label", "prior")
    near = test.select("node_id").join(g.adj.withColumnRenamed("node", "node_id"), "node_id")
    marked = near.join(labelled.select(F.col("node_id").alias("nbr"), F.col("label").alias("vote")), "nbr", "left")
    votes = marked.where("vote IS NOT NULL").groupBy("node_id", F.col("vote").alias("label")).agg(F.count("*").cast("double").alias("score"))
    unknown = marked.groupBy("node_id").agg(F.sum(F.when(F.col("vote").isNull(), 1).otherwise(0)).alias("unknown"))
    # a row for each class
    spread = unknown.crossJoin(F.broadcast(prior)).select("node_id", "label", (F.col("unknown") * F.col("prior")).alias("score"))
    total = spread.unionByName(votes).groupBy("node_id", "label").agg(F.round(F.sum("score"), 9).alias("score"))
    best = total.groupBy("node_id").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "label")).alias("all"))
    pred = best.select("node_id", F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("top")), lambda x: x["label"])).alias("pred"))
    return pred.join(g.nodes, "node_id").select("node_id", "label", "pred")


def _vectors(rows: DataFrame, width: int | None = None) -> DataFrame:
    """Rows with a Spark ML vector v from an array or sparse vector x; sparse ones are ``width`` long, by default as the longest."""
    if is_sparse(rows, "x"):
        return ml_vectors(rows, "x", max(sparse_width(rows, "x"), 1) if width is None else width).drop("x")
    return rows.withColumn("v", array_to_vector("x")).drop("x")


def _weighted(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node_id, label, x) with class index y, vector v and balanced weight w."""
    w = class_counts(rows).select("label", F.col("balanced_weight").alias("w"))
    return _vectors(rows).join(F.broadcast(classes), "label").join(F.broadcast(w), "label").select("node_id", F.col("class_idx").cast("double").alias("y"), "v", "w")


def logistic(rows: DataFrame, classes: DataFrame, max_iter: int = 200, reg: float | None = None):
    """Balanced, L2-penalised multinomial logistic regression of (node_id, label, x); penalty 1 / n is C = 1."""
    data = _weighted(rows, classes)
    n = max(rows.count(), 1)
    return LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", predictionCol="p", probabilityCol="q", regParam=1.0 / n if reg is None else reg, elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=max_iter, tol=1e-9).fit(data)


def predict(model, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node_id, pred) of (node_id, x); of sparse vectors, positions beyond those learned from have no weight."""
    out = model.transform(_vectors(rows.select("node_id", "x"), model.numFeatures))
    return out.select("node_id", F.col("p").cast("int").alias("class_idx")).join(F.broadcast(classes), "class_idx").select("node_id", F.col("label").alias("pred"))


def probabilities(model, rows: DataFrame) -> DataFrame:
    """(node_id, proba): an array over the class indices."""
    return model.transform(_vectors(rows.select("node_id", "x"), model.numFeatures)).select("node_id", vector_to_array("q").alias("proba"))


def content_only(g: RelGraph, train: DataFrame, test: DataFrame) -> DataFrame:
    """Logistic regression on the features alone, arrays or sparse vectors."""
    classes = g.classes()
    x = g.features.select("node_id", F.col("features").alias("x"))
    labelled = g.nodes.join(train.select("node_id"), "node_id", "left_semi").join(x, "node_id")
    model = logistic(labelled, classes)
    return predict(model, x.join(test.select("node_id"), "node_id", "left_semi"), classes).join(g.nodes, "node_id").select("node_id", "label", "pred")


def relational_rows(g: RelGraph, cond: DataFrame, classes: list[str], kind: str = "count", attributes: bool = True) -> DataFrame:
    """(node_id, x): features, if wanted, and the aggregate of the neighbours' labels."""
    agg = neighbour_vectors(g.nodes, g.adj, cond, classes, kind)
    if not attributes:
        return agg.select("node_id", F.col("agg").alias("x"))
    return g.features.join(agg, "node_id").select("node_id", F.concat("features", "agg").alias("x"))


def collective(g: RelGraph, train: DataFrame, test: DataFrame, kind: str = "count", rounds: int = 10, mode: str = "parallel", semi_supervised: bool = True, attributes: bool = True) -> DataFrame:
    """Iterative collective classification.

    A content model labels all nodes; with the observed labels on top the relational model is
    fitted on features and neighbour labels; then the test nodes are predicted again and again.
    'parallel' updates all of them at once in each round; 'exact' gives what updating them one after the
    other in order of id gives, at any size.
    ``semi_supervised`` False fits the relational model on observed labels alone.
    """
    classes = g.classes()
    names = [r["label"] for r in classes.orderBy("class_idx").collect()]
    x = g.features.select("node_id", F.col("features").alias("x"))
    observed = scratch.materialise(g.nodes.join(train.select("node_id"), "node_id", "left_semi").select("node_id", "label"), "observed")
    co = logistic(observed.join(x, "node_id"), classes)
    first = scratch.materialise(predict(co, x, classes).select("node_id", F.col("pred").alias("label")), "content")
    cond = overlay(first, observed) if semi_supervised else observed
    rc = logistic(observed.join(relational_rows(g, cond, names, kind, attributes), "node_id"), classes)
    target = test.select("node_id")
    current = overlay(first.join(target, "node_id", "left_semi"), observed)
    if mode == "exact":
        return _in_order(g, rc, current, target, names, kind, attributes, rounds)
    # what is observed stays
    free = target.join(observed, "node_id", "left_anti")
    got = _inferred(g, rc, current, free, names, kind, attributes, rounds, False)
    return got.join(target, "node_id", "left_semi").join(g.nodes, "node_id").select("node_id", "label", "pred")


def update_levels(arcs: DataFrame, target: DataFrame) -> DataFrame:
    """(node_id, level): 0 without a smaller neighbour in ``target``, else one more than the highest of these.

    ``arcs``: (node, nbr) of target nodes, both ways.  Nodes of one level are not adjacent, and in an update in order of id
    each sees its smaller neighbours updated and its larger ones not yet, so a level can be updated at once.
    """
    down = scratch.materialise(arcs.where("nbr < node").select("node", F.col("nbr").alias("small")), "smaller")
    left = scratch.materialise(target.select("node_id"), "unlevelled")
    done: list[DataFrame] = []
    while not left.isEmpty():
        held = down.join(left.select(F.col("node_id").alias("small")), "small", "left_semi").select(F.col("node").alias("node_id")).distinct()
        ready = scratch.materialise(left.join(held, "node_id", "left_anti").withColumn("level", F.lit(len(done))), "level")
        following = scratch.materialise(left.join(held, "node_id", "left_semi"), "unlevelled")
        scratch.drop(left)
        left = following
        done.append(ready)
    return scratch.stacked(done) if done else target.select("node_id", F.lit(0).alias("level"))


def _in_order(g: RelGraph, rc, current: DataFrame, target: DataFrame, names: list[str], kind: str, attributes: bool, rounds: int) -> DataFrame:
    """As if one node were updated after the other in order of id, in so many rounds; a round without a change is the last."""
    got = _inferred(g, rc, current, target, names, kind, attributes, rounds, True)
    if attributes:
        target = target.join(g.features, "node_id", "left_semi")
    return got.join(target, "node_id", "left_semi").join(g.nodes, "node_id").select("node_id", "label", "pred")


def _inferred(g: RelGraph, rc, current: DataFrame, free: DataFrame, names: list[str], kind: str, attributes: bool, rounds: int, in_order: bool) -> DataFrame:
    """(node_id, pred): the labels of ``current``, those of ``free`` predicted again by the relational model, round by round."""
    from .label_blocks import inferred
    from .networks import _apply

    if kind not in ("count", "prop", "exist"):
        raise ValueError(f"unknown aggregator {kind}")
    size = len(names)
    of = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    w, b = rc.coefficientMatrix.toArray(), np.array(rc.interceptVector.toArray())
    known = w.shape[1] - size
    rows = g.features.join(free.select("node_id"), "node_id", "left_semi") if attributes else free
    base = _apply(rows, ["features"], lambda x: x.reshape(len(x), known) @ w[:, :known].T + b, "base", "array<double>") if known else rows.select("node_id", F.array(*map(F.lit, b.tolist())).alias("base"))
    marks = current.select("node_id", F.element_at(of, F.col("label")).alias("c"))
    nodes = g.nodes.select("node_id").join(marks, "node_id", "full").join(base, "node_id", "left").select("node_id", "c", "base")
    arcs = g.adj.join(free.select(F.col("node_id").alias("node")), "node", "left_semi").select("node", "nbr")
    named = F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1)
    return inferred(nodes, arcs, w[:, known:], kind, rounds, in_order).select("node_id", named.alias("pred"))


def mean_layers(g: RelGraph, samples: tuple[int, ...] = (10, 5), seed: int = 0) -> DataFrame:
    """(node_id, x): the features, and their means over sampled neighbours, once for each layer."""
    out = current = g.features.select("node_id", F.col("features").alias("x"))
    width = width_of(g.features)
    for layer, cap in enumerate(samples):
        near = sampled_neighbours(g.adj, cap, seed + layer).join(current.withColumnRenamed("node_id", "nbr"), "nbr")
        current = vector_sums(near.withColumnRenamed("node", "node_id"), ["node_id"], "x", width, mean=True)
        out = out.join(current.withColumnRenamed("x", "_m"), "node_id").select("node_id", F.concat("x", "_m").alias("x"))
    return out


def weighted_cross_entropy(rows: DataFrame, classes: DataFrame, weights: DataFrame) -> DataFrame:
    """(loss): mean of -w log p of the true class over (label, proba), proba normalised and clipped to [1e-7, 1 - 1e-7]."""
    w = weights.select("label", F.col("support_weight").alias("w"))
    total = F.aggregate("proba", F.lit(0.0), lambda s, v: s + v)
    p = F.least(F.greatest(F.get("proba", F.col("class_idx")) / total, F.lit(1e-7)), F.lit(1 - 1e-7))
    return rows.join(F.broadcast(classes), "label").join(F.broadcast(w), "label").agg(F.avg(-F.log(p) * F.col("w")).alias("loss"))


def alfnet(g: RelGraph, train: DataFrame, clusters: DataFrame, budget: int, k: int = 8, seed: int = 0, within_cluster: bool = False, rounds: int = 10) -> DataFrame:
    """(node_id, ord): nodes chosen by cluster disagreement of a content and a collective model.

    Each turn fits both models, scores the clusters, takes the ``k`` highest, and draws as many
    nodes for each from the whole pool (or, if asked, from that cluster).
    """
    chosen = scratch.materialise(seed_nodes(g, train, k, seed), "chosen")
    n, turn = chosen.count(), 0
    while n < budget:
        turn += 1
        co = content_only(g, chosen, g.nodes).select("node_id", F.col("pred").alias("co"))
        cc = collective(g, chosen, g.nodes, rounds=rounds).select("node_id", F.col("pred").alias("cc"))
        seen = g.nodes.join(chosen.select("node_id"), "node_id", "left_semi").select("node_id", "label")
        members = clusters.join(seen, "node_id", "left").join(co, "node_id").join(cc, "node_id")
        top = scratch.materialise(top_clusters(disagreement(members), k), "top")
        pool = train.select("node_id").join(chosen, "node_id", "left_anti")
        want = min(k, budget - n)
        if within_cluster:
            pool = pool.join(clusters.join(top, "cluster", "left_semi"), "node_id", "left_semi")
        picks = random_nodes(g, want, pool, seed + turn).select("node_id", (F.col("ord") + F.lit(n)).alias("ord"))
        following = scratch.materialise(chosen.unionByName(picks), "chosen")
        grown = following.count()
        if grown == n:
            break
        chosen, n = following, grown
    return chosen


MODELS: dict[str, Callable] = {"wvrn": wvrn, "co": content_only, "cc": collective, "sgc": simple_convolution, "gsage": sampled_means}
