"""Power iteration with the row-normalised matrix of weighted pairs, on blocks of nodes that stay in place (as ``krylov``)."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..plans import scratch
from .graph import dense_index
from .krylov import _same

#: Nodes of a block at most, and nodes that are worth a block of their own; arcs into a block on average, at most.
NODES, FEW_NODES, ARCS = 1 << 18, 1 << 14, 1 << 20
#: Multiplications that one job does.
TOGETHER = 5


def power_iteration(pairs: DataFrame, rounds: int, seed: int = 7) -> DataFrame:
    """(id, x): x of unit absolute sum after so many multiplications, or as soon as the change of a step hardly differs from that of the step before.

    ``pairs`` (src, dst, weight) count both ways, self-loops don't, equal ones add up.  The start is drawn by hash of the id.
    """
    spark = pairs.sparkSession
    scratch.ship(spark)
    plain = scratch.materialise(pairs.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")), "pairs")
    least, m = plain.agg(F.min("weight"), F.count("*")).first()
    if least is not None and least < 0:
        raise ValueError(f"weights can't be negative: {least}")
    index = scratch.materialise(dense_index(plain.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id"), "index")
    n = index.count()
    if not n:
        return index.select("id", F.lit(0.0).alias("x"))
    count = max(-(-n // NODES), -(-2 * m // ARCS), min(spark.sparkContext.defaultParallelism, -(-n // FEW_NODES)))
    size = -(-n // count)
    block, at = (lambda c: (F.col(c) / size).cast("int")), (lambda c: (F.col(c) % size).cast("int"))
    a, b = (index.select(F.col("id").alias(c), F.col("idx").alias(i)) for c, i in (("src", "a"), ("dst", "b")))
    known = plain.join(a, "src").join(b, "dst")
    ways = F.explode(F.array(F.struct(F.col("a").alias("to"), F.col("b").alias("of")), F.struct(F.col("b").alias("to"), F.col("a").alias("of"))))
    arcs = known.select(ways.alias("_w"), "weight").select(F.col("_w.to").alias("_to"), F.col("_w.of").alias("_of"), "weight")
    cut = arcs.select(block("_to").alias("k"), block("_of").alias("i"), F.struct(at("_to").alias("to"), at("_of").alias("of"), "weight").alias("arc"))
    # the arcs between two blocks, in order, so that sums don't depend on who was first
    listed = cut.groupBy("k", "i").agg(F.sort_array(F.collect_list("arc")).alias("arcs")).select("k", "i", *[F.col(f"arcs.{c}").alias(c) for c in ("to", "of", "weight")])
    packed = scratch.materialise(listed.mapInArrow(_pack, "k int, i int, to binary, of binary, weight binary, need binary"), "blocks")
    start = index.select(block("idx").alias("k"), F.struct(at("idx").alias("at"), (uniform(seed, "pic", "id") - 0.5).alias("x")).alias("node")).groupBy("k").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return index.join(_Blocks(spark, packed, start.select("k", F.col("nodes.x").alias("x")), n, size, count).iterate(rounds), "idx").select("id", "x")


class _Blocks:
    """Block k of arcs and of the vector is partition k of every RDD."""

    def __init__(self, spark, packed: DataFrame, start: DataFrame, n: int, size: int, count: int):
        self.spark, self.n, self.size, self.count = spark, n, size, count
        into = packed.select("k", "i", "to", "of", "weight").rdd.map(lambda r: (r[0], ("to", r[1], *map(bytes, r[2:]))))
        out = packed.select("i", "k", "need").rdd.map(lambda r: (r[0], ("need", r[1], bytes(r[2]))))
        self.arcs = self._placed(into.union(out)).mapPartitions(_gather(size), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self.first = self._placed(start.rdd.map(lambda r: (r[0], ("now", np.array(r[1]), None, 0))))

    def _placed(self, rows):
        return rows.partitionBy(self.count, _same)

    def _here(self, tables: list, work, stay: bool = True):
        return self.spark.sparkContext.union(tables).mapPartitions(work, preservesPartitioning=stay)

    def iterate(self, rounds: int) -> DataFrame:
        """(idx, x)."""
        now, done, change = self.first.persist(StorageLevel.MEMORY_AND_DISK), 0, {}
        scale, tolerance, fresh = now.map(_length).treeReduce(_added), max(1e-5 / self.n, 1e-8), []
        try:
            while True:
                fresh = []
                for _ in range(min(TOGETHER, rounds - done)):
                    last = fresh[-1] if fresh else now
                    sent = self._placed(self._here([self.arcs, last], _send, stay=False))
                    fresh.append(self._here([self.arcs, last, sent], _step).persist(StorageLevel.MEMORY_AND_DISK))
                both = self.spark.sparkContext.union(fresh)
                scale |= both.map(_length).treeReduce(_added)
                change |= both.map(_change(dict(scale))).treeReduce(_added)
                steps = range(done + 1, done + len(fresh) + 1)
                still = next((t for t in steps if t > 1 and abs(change[t] - change[t - 1]) < tolerance), None)
                if still or steps[-1] == rounds:
                    t = still or rounds
                    found = self.spark.createDataFrame(fresh[t - done - 1].flatMap(_values(self.size, scale[t])), "start long, x binary")
                    return scratch.materialise(found.mapInArrow(_spread, "idx long, x double"), "power")
                for t in [now, *fresh[:-1]]:
                    t.unpersist()
                now, done = fresh[-1], steps[-1]
        finally:
            for t in [self.arcs, now, *fresh]:
                t.unpersist()


def _pack(batches):
    """Arcs between two blocks; ``need``: the nodes that they ask for, ``of``: positions among these."""
    import pyarrow as pa

    for batch in batches:
        for r in range(batch.num_rows):
            to, of, weight = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("to", "of", "weight"))
            need, place = np.unique(of, return_inverse=True)
            cells = [to.astype(np.int32), place.astype(np.int32), weight.astype(float), need.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(r, 1), batch.column("i").slice(r, 1), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["k", "i", "to", "of", "weight", "need"])


def _gather(size: int):
    """The block's arcs, their weights over the sums at the nodes that they lead to, and what other blocks need."""

    def work(rows):
        k, into, need = None, {}, {}
        for k, (tag, i, *v) in rows:
            if tag == "to":
                into[i] = (np.frombuffer(v[0], np.int32), np.frombuffer(v[1], np.int32), np.frombuffer(v[2]))
            else:
                need[i] = np.frombuffer(v[0], np.int32)
        if k is not None:
            total = sum(np.bincount(to, w, minlength=size) for to, _, w in (into[i] for i in sorted(into)))
            total = np.maximum(total, np.finfo(float).eps)
            yield k, ("arcs", {i: (to, of, w / total[to]) for i, (to, of, w) in into.items()}, need)

    return work


def _send(rows):
    """To every block the values that it needs."""
    got = {v[0]: (k, v) for k, v in rows}
    if "arcs" in got:
        k, (_, _, need) = got["arcs"]
        x = got["now"][1][1]
        for t, which in need.items():
            yield t, ("sent", k, x[which])


def _step(rows):
    """The next vector and the one before it."""
    k, sent, own = None, {}, {}
    for k, (tag, *v) in rows:
        if tag == "sent":
            sent[v[0]] = v[1]
        else:
            own[tag] = v
    if k is None:
        return
    (into, _), (now, _, t) = own["arcs"], own["now"]
    y = np.zeros(len(now))
    for i in sorted(into):
        to, of, w = into[i]
        y += np.bincount(to, w * sent[i][of], minlength=len(now))
    yield k, ("now", y, now, t + 1)


def _length(row) -> dict:
    _, (_, x, _, t) = row
    return {t: float(np.abs(x).sum())}


def _change(scale: dict):
    """By how much a step changes the vector, both of unit absolute sum."""

    def work(row):
        _, (_, x, before, t) = row
        return {t: float(np.abs(x / scale[t] - before / scale[t - 1]).sum())}

    return work


def _added(a: dict, b: dict) -> dict:
    return {t: a.get(t, 0.0) + b.get(t, 0.0) for t in a | b}


def _values(size: int, scale: float):
    def work(row):
        k, (_, x, *_) = row
        for a in range(0, len(x), 1 << 16):
            yield k * size + a, bytearray((x[a : a + (1 << 16)] / scale).tobytes())

    return work


def _spread(batches):
    import pyarrow as pa

    for batch in batches:
        for start, x in zip(batch.column("start").to_pylist(), batch.column("x"), strict=True):
            x = np.frombuffer(x.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + start, pa.int64()), pa.array(x)], names=["idx", "x"])
