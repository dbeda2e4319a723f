"""Collective inference on blocks of nodes: labels are predicted again and again from those of the neighbours, at any size.

Each block of consecutive nodes keeps the arcs into it and what the features alone say of its nodes; a step sends to every other
block only the labels that its arcs ask for, so neither arcs nor features move between the rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from .graph import dense_index
from .krylov import ARCS, FEW_NODES, NODES, _pack_arcs, _same


def inferred(nodes: DataFrame, arcs: DataFrame, weights: np.ndarray, kind: str, rounds: int, in_order: bool) -> DataFrame:
    """(node_id, c) of the labelled nodes after so many rounds, or once a round changes nothing.

    ``nodes``: (node_id, c, base): class index or null, and the scores of its features where it is to be predicted; ``arcs``: (node, nbr)
    of nodes to predict; ``weights``: classes x classes, of the neighbours' classes.  Not ``in_order``, a round updates all at once.
    In order, it gives what updating one after the other in order of id gives: smaller neighbours count with
    their new labels, so a round is repeated on its own result until that is the same, and inside a block until the block's is.
    That point is the only one, as a node depends on smaller ones alone, and is reached in as many steps as the longest chain of
    changes from block to block.
    """
    spark = nodes.sparkSession
    scratch.ship(spark)
    index = scratch.materialise(dense_index(nodes, "node_id"), "index")
    n, m = index.count(), arcs.count()
    count = max(-(-n // NODES), -(-m // ARCS), min(spark.sparkContext.defaultParallelism, -(-n // FEW_NODES)), 1)
    size = -(-max(n, 1) // count)
    ends = [index.select(F.col("node_id").alias(c), F.col("idx").alias(f"_{c}")) for c in ("node", "nbr")]
    block, at = (lambda c: (F.col(c) / size).cast("int")), (lambda c: (F.col(c) % size).cast("int"))
    cut = arcs.join(ends[0], "node").join(ends[1], "nbr").select(block("_node").alias("k"), block("_nbr").alias("i"), F.struct(at("_node").alias("to"), at("_nbr").alias("of")).alias("arc"))
    # the arcs between two blocks
    listed = cut.groupBy("k", "i").agg(F.collect_list("arc").alias("arcs")).select("k", "i", F.col("arcs.to").alias("to"), F.col("arcs.of").alias("of"))
    pairs = scratch.materialise(listed.mapInArrow(_pack_arcs, "k int, i int, to binary, of binary, need binary"), "pairs")
    # the nodes of a block
    own = index.select(block("idx").alias("k"), F.struct(at("idx").alias("at"), "c", "base").alias("node")).groupBy("k").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    packed = scratch.materialise(own.select("k", F.col("nodes.c").alias("c"), F.col("nodes.base").alias("base")).mapInArrow(_pack(len(weights)), "k int, base binary, chosen binary, old binary, now binary, moved long"), "nodes")

    def placed(rows: RDD) -> RDD:
        return rows.partitionBy(count, _same)

    def here(tables: list[RDD], work: Callable, stay: bool = True) -> RDD:
        return spark.sparkContext.union(tables).mapPartitions(work, preservesPartitioning=stay)

    into = pairs.select("k", "i", "to", "of").rdd.map(lambda r: (r[0], ("to", r[1], np.frombuffer(bytes(r[2]), np.int32), np.frombuffer(bytes(r[3]), np.int32))))
    out = pairs.select("i", "k", "need").rdd.map(lambda r: (r[0], ("need", r[1], np.frombuffer(bytes(r[2]), np.int32))))
    base = packed.select("k", "base", "chosen").rdd.map(lambda r: (r[0], ("base", np.frombuffer(bytes(r[1])).reshape(-1, len(weights)), np.frombuffer(bytes(r[2]), bool))))
    kept = placed(into.union(out).union(base)).persist(StorageLevel.MEMORY_AND_DISK)
    state = scratch.materialise(packed.select("k", "old", "now", "moved"), "state")

    def step(state: DataFrame, settle: bool) -> DataFrame:
        """One step; ``settle``: the labels before the round are those now."""
        now = placed(state.select("k", "old", "now").rdd.map(lambda r: (r[0], ("now", np.frombuffer(bytes(r[2 if settle else 1]), np.int16), np.frombuffer(bytes(r[2]), np.int16)))))
        sent = placed(here([kept, now], _send(in_order), stay=False))
        following = here([kept, now, sent], _step(weights, kind, in_order))
        return scratch.materialise(spark.createDataFrame(following, "k int, old binary, now binary, moved long"), "state")

    try:
        for _ in range(rounds):
            moved, settle, changed = True, True, False
            while moved:
                following = step(state, settle)
                scratch.drop(state)
                state, settle = following, False
                moved = bool(state.agg(F.sum("moved")).first()[0])
                changed |= moved
                if not in_order:
                    break
            if not changed:
                break
    finally:
        kept.unpersist()

    def values(batches):
        import pyarrow as pa

        for batch in batches:
            for k, c in zip(batch.column("k").to_pylist(), batch.column("now"), strict=True):
                c = np.frombuffer(c.as_buffer(), np.int16)
                for a in range(0, len(c), 1 << 16):
                    piece = c[a : a + (1 << 16)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(piece)) + (k * size + a), pa.int64()), pa.array(piece)], names=["idx", "c"])

    return index.select("idx", "node_id").join(state.mapInArrow(values, "idx long, c int").where("c >= 0"), "idx").select("node_id", "c")


def _pack(classes: int) -> Callable:
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                c, base = (batch.column(x)[r].values for x in ("c", "base"))
                chosen = base.is_valid().to_numpy(zero_copy_only=False)
                scores = np.zeros((len(c), classes))
                scores[chosen] = base.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
                labels = c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int16).tobytes()
                cells = [pa.array([x], pa.binary()) for x in (scores.tobytes(), chosen.tobytes(), labels, labels)]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(r, 1), *cells, pa.array([0], pa.int64())], names=["k", "base", "chosen", "old", "now", "moved"])

    return work


def _send(in_order: bool) -> Callable:
    """To every other block the labels that it needs: in order, larger ones get the new labels of this one."""

    def work(rows):
        need, now = {}, None
        for k, (tag, *v) in rows:
            if tag == "need":
                need[v[0]] = v[1]
            elif tag == "now":
                now = v
        for t, at in need.items():
            if t != k:
                yield t, ("sent", k, now[1 if in_order and k < t else 0][at])

    return work


def _counted(to, labels, n: int, classes: int) -> np.ndarray:
    known = labels >= 0
    return np.bincount(to[known].astype(np.int64) * classes + labels[known], minlength=n * classes).reshape(n, classes)


def _step(weights: np.ndarray, kind: str, in_order: bool) -> Callable:
    def work(rows):
        k, into, sent, now = None, {}, {}, None
        for k, (tag, *v) in rows:
            if tag == "to":
                into[v[0]] = v[1:]
            elif tag == "need":
                if v[0] == k:
                    own_need = v[1]
            elif tag == "base":
                base, chosen = v
            elif tag == "sent":
                sent[v[0]] = v[1]
            else:
                now = v
        if k is None:
            return
        old, first = now
        n, classes = base.shape
        fixed = np.zeros((n, classes))
        for i, (to, of) in into.items():
            if i != k:
                fixed += _counted(to, sent[i][of], n, classes)
        lower = None
        if k in into:
            to, of = into[k][0], own_need[into[k][1]]
            new = in_order & (of < to)
            fixed += _counted(to[~new], old[of[~new]], n, classes)
            if new.any():
                lower = to[new], of[new]
        current = first
        while True:
            counts = fixed if lower is None else fixed + _counted(lower[0], current[lower[1]], n, classes)
            if kind == "prop":
                counts = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            elif kind == "exist":
                counts = np.minimum(counts, 1)
            following = np.where(chosen, (base + counts @ weights.T).argmax(axis=1), current).astype(np.int16)
            same = np.array_equal(following, current)
            current = following
            if same or lower is None:
                break
        yield k, bytearray(old.tobytes()), bytearray(current.tobytes()), int((current != first).sum())

    return work
