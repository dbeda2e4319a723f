"""Leading eigenvectors of modularity matrices on blocks of nodes, all parts of a graph at once, at any size.

Each block of nodes keeps the arcs into it and its pieces of the vectors; a multiplication sends to every other block only the values
that its arcs ask for.  Blocks stay where they are (one partitioner for arcs, vectors and values), so those values are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from .graph import dense_index

#: Nodes of a block at most, and nodes that are worth a block of their own; arcs into a block on average, at most.
NODES, FEW_NODES, ARCS = 1 << 18, 1 << 14, 1 << 21
#: Multiplications between two Rayleigh-Ritz steps, and how many such cycles at most.
STEPS, MOST_CYCLES = 20, 40
#: Multiplications that one job does.
TOGETHER = 5
#: Residual of the leading eigenpair, as a share of the eigenvalue, that ends the iteration.
TOLERANCE = 1e-3


def ritz(mu: np.ndarray, bound: float) -> tuple[np.ndarray, float, float, float]:
    """(coefficients, leading value, its residual, largest absolute value) of the best vector of unit length in a Krylov space.

    The space is spanned by x, T1(M/b)x, .., Td-1(M/b)x of Chebyshev polynomials; ``mu`` are the products of x with T0 x, .., T2d x,
    and the product of Ti x and Tj x is the mean of moments i + j and |i - j|.
    """
    d = (len(mu) - 1) // 2
    i = np.arange(d + 1)
    gram = (mu[i[:, None] + i] + mu[abs(i[:, None] - i)]) / 2
    length = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    unit = gram / length[:, None] / length
    # M Tj x = b / 2 (Tj+1 x + T|j-1| x)
    moved = np.zeros((d + 1, d))
    for j in range(d):
        moved[j + 1, j] += bound / 2
        moved[abs(j - 1), j] += bound / 2
    moved *= length[:, None] / length[:d]
    values, axes = np.linalg.eigh(unit[:d, :d])
    kept = values > 1e-11 * max(values[-1], 1e-300)
    white = axes[:, kept] / np.sqrt(values[kept])
    inner = white.T @ unit[:d] @ moved @ white
    found, mix = np.linalg.eigh((inner + inner.T) / 2)
    best, top = white @ mix[:, -1], float(found[-1])
    rest = moved @ best - top * np.r_[best, 0]
    return best / length[:d], top, float(np.sqrt(max(rest @ unit @ rest, 0.0))), float(max(abs(found[0]), abs(top)))


def leading_vectors(members: DataFrame, arcs: DataFrame, seed: int = 7) -> DataFrame:
    """(part, node_id, x): the leading eigenvector of the modularity matrix of each part, all parts in the same jobs.

    ``members``: (part, node_id); ``arcs``: (node, nbr) inside the parts, both ways, a self-loop once.  A cycle multiplies a vector ``STEPS``
    times by the sparse matrix less its rank-one term, in the three-term recurrence of Chebyshev polynomials, which needs no products
    on the way; the products that the Rayleigh-Ritz step needs are summed by part and come to the driver.  The next cycle starts from the best vector,
    until the residual of each part's leading pair is below ``TOLERANCE`` of its value (or of the mean degree, where that is
    larger); what does not get there in ``MOST_CYCLES`` cycles raises.  x is zero in parts without edges.
    """
    spark = members.sparkSession
    scratch.ship(spark)
    index = scratch.materialise(dense_index(members.select("part", "node_id"), "node_id"), "index")
    n, m = index.count(), arcs.count()
    names = sorted(r[0] for r in index.select("part").distinct().collect())
    count = max(-(-n // NODES), -(-m // ARCS), min(spark.sparkContext.defaultParallelism, -(-n // FEW_NODES)), 1)
    blocks = _Blocks(index, arcs, names, -(-max(n, 1) // count), count, seed)
    try:
        state = blocks.iterate()
    finally:
        blocks.arcs.unpersist()
    return index.join(blocks.values(state), "idx").select("part", "node_id", "x")


class _Blocks:
    """Arcs and vectors by block of ``size`` consecutive nodes; block k is partition k of every RDD."""

    def __init__(self, index: DataFrame, arcs: DataFrame, names: list, size: int, count: int, seed: int):
        from ..functions.rng import uniform

        self.spark, self.size, self.count, self.names = index.sparkSession, size, count, np.array(names)
        ends = [index.select(F.col("node_id").alias(c), F.col("idx").alias(f"_{c}")) for c in ("node", "nbr")]
        block, at = (lambda c: (F.col(c) / size).cast("int")), (lambda c: (F.col(c) % size).cast("int"))
        cut = arcs.join(ends[0], "node").join(ends[1], "nbr").select(block("_node").alias("k"), block("_nbr").alias("i"), F.struct(at("_node").alias("to"), at("_nbr").alias("of")).alias("arc"))
        # the arcs between two blocks
        listed = cut.groupBy("k", "i").agg(F.collect_list("arc").alias("arcs")).select("k", "i", F.col("arcs.to").alias("to"), F.col("arcs.of").alias("of"))
        self.pairs = scratch.materialise(listed.mapInArrow(_pack_arcs, "k int, i int, to binary, of binary, need binary"), "pairs")
        start = index.select(block("idx").alias("k"), F.struct(at("idx").alias("at"), "part", (uniform(seed, "krylov0", "node_id") - 0.5).alias("x")).alias("node"))
        nodes = start.groupBy("k").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("k", F.col("nodes.part").alias("part"), F.col("nodes.x").alias("x"))
        self.nodes = scratch.materialise(nodes.mapInArrow(_pack_nodes(self.names), "k int, part binary, x binary"), "nodes")
        into = self.pairs.select("k", "i", "to", "of").rdd.map(lambda r: (r[0], ("to", r[1], bytes(r[2]), bytes(r[3]))))
        out = self.pairs.select("i", "k", "need").rdd.map(lambda r: (r[0], ("need", r[1], bytes(r[2]))))
        own = self.nodes.select("k", "part").rdd.map(lambda r: (r[0], ("part", bytes(r[1]))))
        self.arcs = self._placed(into.union(out).union(own)).mapPartitions(_gather, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    def _placed(self, rows: RDD) -> RDD:
        return rows.partitionBy(self.count, _same)

    def _here(self, tables: list[RDD], work: Callable, stay: bool = True) -> RDD:
        """``work`` on the rows of each block; nothing moves, as all have the same partitions.  ``stay``: what it yields is the block's own."""
        return self.spark.sparkContext.union(tables).mapPartitions(work, preservesPartitioning=stay)

    def iterate(self) -> DataFrame:
        """(k, x): the pieces of the vectors found."""
        parts = len(self.names)
        sums = self.arcs.values().map(_degrees(parts)).treeReduce(lambda a, b: np.vstack([a[:3] + b[:3], np.maximum(a[3:], b[3:])]))
        n, total, squares, most = sums
        mean, m2 = total / np.maximum(n, 1), np.maximum(total, 1.0)
        # where a graph has no structure its eigenvalues end about here
        bound = 1.1 * np.maximum(2 * np.sqrt(squares / m2), np.sqrt(np.maximum(most, 1.0)))
        state = self.nodes.select("k", "x")
        for cycle in range(MOST_CYCLES):
            chain = [self._placed(state.rdd.map(lambda r: (r[0], ("x", np.frombuffer(bytes(r[1]))))))]
            chain[0] = self._here([self.arcs, chain[0]], _first(parts)).persist(StorageLevel.MEMORY_AND_DISK)
            dots = {}
            while len(chain) <= STEPS:
                # a few steps in a job: one with a long chain of tables takes long to place its tasks
                for _ in range(min(TOGETHER, STEPS + 1 - len(chain))):
                    sent = self._placed(self._here([self.arcs, chain[-1]], _send(self.count, parts), stay=False))
                    chain.append(self._here([self.arcs, chain[-1], sent], _step(parts, m2, bound)).persist(StorageLevel.MEMORY_AND_DISK))
                dots |= self.spark.sparkContext.union(chain[len(dots) :]).map(lambda row: {row[1][4]: row[1][3]}).treeReduce(_added)
            dots = np.array([dots[j] for j in range(STEPS + 1)])
            found = [ritz(moments(dots[:, :, p]), bound[p]) for p in range(parts)]
            mix = np.array([np.where(total[p] > 0, f[0], 0.0) for p, f in enumerate(found)])
            mixed = self._here([self.arcs, *chain[:-1]], _mixed(mix))
            following = scratch.materialise(self.spark.createDataFrame(mixed, "k int, x binary"), "krylov")
            for t in chain:
                t.unpersist()
            if cycle:
                scratch.drop(state)
            state = following
            if all(total[p] == 0 or residual <= TOLERANCE * max(abs(top), mean[p]) for p, (_, top, residual, _) in enumerate(found)):
                return state
            bound = np.array([max(far, 1e-3 * mean[p], 1e-12) for p, (*_, far) in enumerate(found)])
        raise RuntimeError(f"leading eigenvectors did not converge: residuals {[(self.names[p].item(), top, r) for p, (_, top, r, _) in enumerate(found)]}")

    def values(self, state: DataFrame) -> DataFrame:
        """(idx, x) of pieces."""
        size = self.size

        def work(batches):
            import pyarrow as pa

            for batch in batches:
                for k, x in zip(batch.column("k").to_pylist(), batch.column("x"), strict=True):
                    x = np.frombuffer(x.as_buffer())
                    for a in range(0, len(x), 1 << 16):
                        piece = x[a : a + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(piece)) + (k * size + a), pa.int64()), pa.array(piece)], names=["idx", "x"])

        return state.mapInArrow(work, "idx long, x double")


def _same(k: int) -> int:
    return k


def _pack_arcs(batches):
    """Arcs between two blocks sorted by where they lead; ``need``: the nodes that they ask for, ``of``: positions among these."""
    import pyarrow as pa

    for batch in batches:
        for r in range(batch.num_rows):
            to, of = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("to", "of"))
            order = np.argsort(to, kind="stable")
            need, place = np.unique(of[order], return_inverse=True)
            cells = [x.astype(np.int32).tobytes() for x in (to[order], place, need)]
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(r, 1), batch.column("i").slice(r, 1), *[pa.array([c], pa.binary()) for c in cells]], names=["k", "i", "to", "of", "need"])


def _pack_nodes(names: np.ndarray) -> Callable:
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                part, x = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("part", "x"))
                cells = [np.searchsorted(names, part).astype(np.int32).tobytes(), x.astype(float).tobytes()]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(r, 1), *[pa.array([c], pa.binary()) for c in cells]], names=["k", "part", "x"])

    return work


def _gather(rows):
    """The block's arcs: parts and degrees of its nodes, where arcs lead and from which of the values sent, and what other blocks need."""
    k, part, into, need = None, None, {}, {}
    for k, (tag, *v) in rows:
        if tag == "part":
            part = np.frombuffer(v[0], np.int32)
        elif tag == "to":
            into[v[0]] = (np.frombuffer(v[1], np.int32), np.frombuffer(v[2], np.int32))
        else:
            need[v[0]] = np.frombuffer(v[1], np.int32)
    if k is None:
        return
    degree = np.zeros(len(part))
    for to, _ in into.values():
        degree += np.bincount(to, minlength=len(part))
    if k in into:
        # a self-loop counts two in a degree
        to, of = into[k]
        degree += np.bincount(to[need[k][of] == to], minlength=len(part))
    yield k, ("arcs", part, degree, into, need)


def _degrees(parts: int) -> Callable:
    """A row each for the number of nodes, the sum of their degrees, of squares, and the largest; a column for each part."""

    def work(arcs):
        _, part, degree, *_ = arcs
        most = np.zeros(parts)
        np.maximum.at(most, part, degree)
        return np.array([np.bincount(part, minlength=parts), *[np.bincount(part, degree**e, minlength=parts) for e in (1, 2)], most])

    return work


def _first(parts: int) -> Callable:
    def work(rows):
        got = {v[0]: (k, v) for k, v in rows}
        if got:
            k, (_, part, *_) = got["arcs"]
            x = got["x"][1][1]
            yield k, ("now", x, None, np.array([np.bincount(part, x * x, minlength=parts), np.zeros(parts)]), 0)

    return work


def _send(count: int, parts: int) -> Callable:
    """To every block the values that it needs, and the sums over this one of degree times value."""

    def work(rows):
        got = {v[0]: (k, v) for k, v in rows}
        if got:
            k, (_, part, degree, _, need) = got["arcs"]
            x = got["now"][1][1]
            pull = np.bincount(part, degree * x, minlength=parts)
            for t in range(count):
                yield t, ("sent", k, x[need[t]] if t in need else None, pull)

    return work


def _step(parts: int, m2: np.ndarray, bound: np.ndarray) -> Callable:
    """The next vector of the recurrence, and by part its products with itself and with the one before."""

    def work(rows):
        k, sent, own = None, {}, {}
        for k, (tag, *v) in rows:
            if tag == "sent":
                sent[v[0]] = v[1:]
            else:
                own[tag] = v
        if k is None:
            return
        part, degree, into, _ = own["arcs"]
        # in the order of the blocks, so that sums don't depend on who was first
        pull = sum(sent[i][1] for i in sorted(sent))
        y = -degree * (pull / m2)[part]
        for i in sorted(into):
            to, of = into[i]
            y += np.bincount(to, sent[i][0][of], minlength=len(part))
        y /= bound[part]
        now, before, _, j = own["now"]
        x = 2 * y - before if before is not None else y
        yield k, ("now", x, now, np.array([np.bincount(part, a * x, minlength=parts) for a in (x, now)]), j + 1)

    return work


def _added(a: dict, b: dict) -> dict:
    return {j: a[j] + b[j] if j in a and j in b else a.get(j, b.get(j)) for j in a | b}


def moments(dots: np.ndarray) -> np.ndarray:
    """Products of x with T0 x, T1 x, .. from those of each vector with itself and with the one before."""
    own, near = dots[:, 0], dots[1:, 1]
    out = np.zeros(2 * len(own) - 1)
    out[::2], out[1::2] = 2 * own - own[0], 2 * near - near[0]
    out[0], out[1] = own[0], near[0]
    return out


def _mixed(mix: np.ndarray) -> Callable:
    """The sum of the vectors times the coefficients of each part."""

    def work(rows):
        k, own, part = None, {}, None
        for k, (tag, *v) in rows:
            if tag == "arcs":
                part = v[0]
            else:
                own[v[3]] = v[0]
        if k is not None:
            total = sum(mix[part, j] * own[j] for j in sorted(own))
            yield k, bytearray(total.tobytes())

    return work
