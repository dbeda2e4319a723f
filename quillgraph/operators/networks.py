"""Graph networks learned by gradient descent: a few labelled nodes are learned from in one place, many in tasks; all nodes are scored in parallel.

The loss is the weighted cross-entropy of ``models.weighted_cross_entropy`` with support weights;
weights follow Adam, inputs of every layer are dropped at random while learning, and squared
weights are penalised.  The labelled nodes are a labelling budget; above ``MOST_LABELLED`` of them
tasks learn from the rows they read, a job for each step (``fit_in_tasks``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_sums, width_of
from ..plans import scratch
from .graph import RelGraph, drop_isolates
from .propagate import propagate
from .relational import class_counts
from .structure import sampled_neighbours

MOST_LABELLED = 20_000


def loss_and_gradient(logits: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean of -w log p of the true class, p clipped to [1e-7, 1 - 1e-7], and its gradient by the logits."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = np.clip(p[np.arange(len(y)), y], 1e-7, 1 - 1e-7)
    gradient = p.copy()
    gradient[np.arange(len(y)), y] -= 1
    return float((-w * np.log(own)).mean()), gradient * (w / len(y))[:, None]


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.m, self.v = ([np.zeros_like(x) for x in weights] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.turn += 1
        for x, g, m, v in zip(self.weights, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-7)


def glorot(rng, rows: int, columns: int) -> np.ndarray:
    edge = np.sqrt(6 / (rows + columns))
    return rng.uniform(-edge, edge, (rows, columns))


def fit_softmax(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, epochs: int = 50, rate: float = 0.2, drop: float = 0.5, penalty: float = 5e-4, seed: int = 0) -> list[np.ndarray]:
    """[weights, bias] of one softmax layer."""
    rng = np.random.default_rng(seed)
    layer = [glorot(rng, x.shape[1], classes), np.zeros(classes)]
    adam = Adam(layer, rate)
    for _ in range(epochs):
        kept = x * (rng.random(x.shape) >= drop) / (1 - drop)
        _, g = loss_and_gradient(kept @ layer[0] + layer[1], y, w)
        adam.step([kept.T @ g + 2 * penalty * layer[0], g.sum(axis=0)])
    return layer


def means_gradient(net: list[np.ndarray], own, mean, near, near_mean, of, y, w, masks: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """(loss, gradient of each weight) of two layers of means and a softmax; masks are what dropout multiplies the four inputs and the two first layers by."""
    n, half = len(own), net[0].shape[1]
    share = 1 / np.maximum(np.bincount(of, minlength=n), 1)
    a, b, c, d = (v * m for v, m in zip((own, mean, near, near_mean), masks[:4], strict=True))
    h0, h1 = (np.hstack([u @ net[0], v @ net[1]]) for u, v in ((a, b), (c, d)))
    k0, k1 = masks[4:]
    d0, d1 = np.maximum(h0, 0) * k0, np.maximum(h1, 0) * k1
    pooled = np.zeros((n, 2 * half))
    np.add.at(pooled, of, d1 * share[of][:, None])
    z = np.hstack([d0 @ net[2], pooled @ net[3]])
    rz = np.maximum(z, 0)
    loss, g = loss_and_gradient(rz @ net[4] + net[5], y, w)
    gz = (g @ net[4].T) * (z > 0)
    g0 = (gz[:, :half] @ net[2].T) * k0 * (h0 > 0)
    g1 = (gz[:, half:] @ net[3].T)[of] * share[of][:, None] * k1 * (h1 > 0)
    return loss, [a.T @ g0[:, :half] + c.T @ g1[:, :half], b.T @ g0[:, half:] + d.T @ g1[:, half:], d0.T @ gz[:, :half], pooled.T @ gz[:, half:], rz.T @ g, g.sum(axis=0)]


def means_weights(rng, width: int, hidden: int, classes: int) -> list[np.ndarray]:
    half = hidden // 2
    return [glorot(rng, width, half), glorot(rng, width, half), glorot(rng, hidden, half), glorot(rng, hidden, half), glorot(rng, hidden, classes), np.zeros(classes)]


def fit_means(own: np.ndarray, mean: np.ndarray, near: np.ndarray, near_mean: np.ndarray, of: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, hidden: int = 32, epochs: int = 50, rate: float = 0.2, drop: float = 0.5, seed: int = 0) -> list[np.ndarray]:
    """[own 1, mean 1, own 2, mean 2, dense, bias] of two layers of means and a softmax, learned together.

    own, mean: features of the labelled nodes and the means over their sampled neighbours; near,
    near_mean: the same of those neighbours, of: the labelled node of each.
    """
    rng = np.random.default_rng(seed)
    net = means_weights(rng, own.shape[1], hidden, classes)
    adam = Adam(net, rate)
    shapes = [own.shape, mean.shape, near.shape, near_mean.shape, (len(own), hidden), (len(near), hidden)]
    for _ in range(epochs):
        masks = [(rng.random(s) >= drop) / (1 - drop) for s in shapes]
        adam.step(means_gradient(net, own, mean, near, near_mean, of, y, w, masks)[1])
    return net


def _streams(seed: int, turn: int, marks):
    """A generator for each mark (a 64-bit hash), the same object set anew: its numbers depend on seed, turn and mark alone."""
    bits = np.random.Philox(key=[0, 0])
    start, rng = bits.state, np.random.Generator(bits)
    for mark in marks:
        # as Philox itself takes a list: large marks are rounded to 53 bits
        start["state"]["key"] = np.array([(seed & 0xFFFFFFFF) << 32 | turn, mark & 0xFFFFFFFFFFFFFFFF]).astype(np.uint64)
        bits.state = start
        yield rng


def row_masks(seed: int, turn: int, marks, sizes: list[int], drop: float) -> np.ndarray:
    """Dropout factors, ``sizes[i]`` for row i, one after the other, from the row's mark alone, so they don't depend on which task has the row."""
    ends = np.cumsum(sizes).tolist()
    out = np.empty(ends[-1] if ends else 0)
    for rng, size, end in zip(_streams(seed, turn, map(int, marks)), sizes, ends, strict=True):
        rng.random(out=out[end - size : end])
    return (out >= drop) / (1 - drop)


def means_rows_gradient(net: list[np.ndarray], rows: dict, seed: int, turn: int, samples: int, drop: float) -> tuple[float, list[np.ndarray]]:
    """(sum of the losses, sums of the gradients) over rows of labelled nodes that carry their neighbours, of which ``samples`` are drawn anew each turn.

    rows: ``mark``, ``x``, ``m0``, ``class_idx``, ``w`` and the lists ``near_x``, ``near_m`` of each node.  A row of a pool with ``samples`` or fewer uses it all.
    """
    n, width, hidden = len(rows["mark"]), net[0].shape[0], net[2].shape[0]
    own, mean = (np.array(rows[c], float).reshape(n, width) for c in ("x", "m0"))
    near_x, near_m = (Lists.of(rows[c], width) for c in ("near_x", "near_m"))
    streams = _streams(seed, turn, (~int(m) for m in rows["mark"]))
    picks = [np.sort(rng.permutation(size)[:samples]) for rng, size in zip(streams, np.diff(near_x.begin).tolist(), strict=True)]
    taken = np.array([len(p) for p in picks], np.int64)
    of = np.repeat(np.arange(n), taken)
    near, near_mean = (x.picked(picks).astype(float) for x in (near_x, near_m))
    each = 2 * width + hidden
    # a node's own factors, then those of its neighbours
    factors = row_masks(seed, turn, rows["mark"], (each * (1 + taken)).tolist(), drop).reshape(-1, each)
    top = np.zeros(len(factors), bool)
    top[np.cumsum(1 + taken) - (1 + taken)] = True
    a, b = factors[top], factors[~top]
    masks = [a[:, :width], a[:, width : 2 * width], b[:, :width], b[:, width : 2 * width], a[:, 2 * width :], b[:, 2 * width :]]
    loss, gradients = means_gradient(net, own, mean, near, near_mean, of, np.array(rows["class_idx"]), np.array(rows["w"], float), masks)
    return loss * n, [g * n for g in gradients]


def softmax_rows_gradient(layer: list[np.ndarray], rows: dict, seed: int, turn: int, drop: float) -> tuple[float, list[np.ndarray]]:
    """(sum of the losses, sums of the gradients) of one softmax layer over rows ``mark``, ``x``, ``class_idx``, ``w``."""
    n, width = len(rows["mark"]), layer[0].shape[0]
    kept = np.array(rows["x"], float).reshape(n, width) * row_masks(seed, turn, rows["mark"], [width] * n, drop).reshape(n, width)
    loss, g = loss_and_gradient(kept @ layer[0] + layer[1], np.array(rows["class_idx"]), np.array(rows["w"], float))
    return loss * n, [n * (kept.T @ g), n * g.sum(axis=0)]


#: Numbers of a block of rows that tasks learn from, 8 bytes each at most.
BLOCK_VALUES = 1_000_000


@dataclass(frozen=True)
class Lists:
    """Lists of vectors, one for each row: all vectors one after the other, and where each row's begin, and the end."""

    values: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, lists, width: int) -> Lists:
        if isinstance(lists, cls):
            return lists
        return cls(np.array([v for row in lists for v in row], float).reshape(-1, width), np.cumsum([0, *map(len, lists)]))

    def __len__(self) -> int:
        return len(self.begin) - 1

    def __iter__(self):
        return (self.values[a:b] for a, b in zip(self.begin[:-1], self.begin[1:], strict=True))

    def picked(self, picks: list[np.ndarray]) -> np.ndarray:
        """The vectors at these places of each row's list."""
        return self.values[np.concatenate([a + p for a, p in zip(self.begin, picks, strict=False)] or [np.zeros(0, np.int64)]).astype(np.int64)]

    def rows(self, which: np.ndarray) -> Lists:
        return Lists(self.picked([np.arange(n if w else 0) for n, w in zip(np.diff(self.begin), which, strict=True)]), np.cumsum([0, *np.diff(self.begin)[which]]))


def _compact(x: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes, where 32 bits hold them exactly."""
    if x.dtype == np.float64:
        short = x.astype(np.float32)
        if np.array_equal(short, x):
            return short
    return np.array(x)


def _numpy(column) -> np.ndarray | Lists:
    """An Arrow column as an array: of numbers, of vectors of one length, or the lists of vectors of each row."""
    from pyarrow import types

    if not types.is_list(column.type):
        return np.array(column.to_numpy(zero_copy_only=False))
    if not types.is_list(column.type.value_type):
        return _compact(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
    inner = column.flatten()
    vectors = inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1) if len(inner) else np.zeros((0, 0))
    return Lists(_compact(vectors), np.cumsum([0, *column.value_lengths().to_pylist()]))


def _drawn(block: dict, batches: int, turn: int) -> dict:
    """The rows of a block that a step learns from: of several batches those that a hash of the mark and the epoch deals to it."""
    if batches == 1:
        return block
    epoch = ((turn // batches + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    h = np.array(block["mark"], np.int64).view(np.uint64) ^ np.uint64(epoch)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    own = (h ^ h >> np.uint64(33)) % np.uint64(batches) == turn % batches
    return {c: x.rows(own) if isinstance(x, Lists) else x[own] for c, x in block.items()}


def fit_in_tasks(rows: DataFrame, weights: list[np.ndarray], gradient, epochs: int, rate: float, batches: int = 1, penalty: float = 0.0, row_values: int = 4000) -> tuple[list[np.ndarray], list[float]]:
    """(weights, mean loss of each step), learned by tasks that each keep to the rows they read.

    The rows become arrays once, which stay where they are (on the executors' disks) during the steps, so a step
    neither reads tables nor turns rows into arrays, and executors hold a block for each task, however many rows there are.  A step is one job: every task adds up the gradients of its rows, gradients are
    added in parallel, and their sum (as long as the weights) comes to the driver, which takes an Adam
    step.  ``batches`` above 1 deals the rows out by hash anew in each epoch, a step a batch.
    ``gradient(weights, rows, turn)``; ``row_values``: numbers in
    the longest row, so a block holds ``BLOCK_VALUES`` or so; ``penalty`` of the squared first weights.  A lost task is run again with equal results.
    """
    adam, losses, scale = Adam(weights, rate), [], sum(x.size for x in weights)
    spark, names = rows.sparkSession, rows.columns
    scratch.ship(spark)
    with scratch.small_batches(spark, max(1, min(1000, BLOCK_VALUES // row_values))):
        kept = _kept(rows, names)
        try:
            for turn in range(epochs * batches):
                now = [x.copy() for x in weights]

                def work(blocks, now=now, turn=turn):
                    total = np.zeros(scale + 2)
                    for block in blocks:
                        part = _drawn(block, batches, turn)
                        if len(part["mark"]):
                            loss, g = gradient(now, part, turn)
                            total += np.concatenate([[len(part["mark"]), loss], *[x.ravel() for x in g]])
                    yield total

                total, at, steps = kept.mapPartitions(work).treeReduce(np.add), 2, []
                if not total[0]:
                    continue
                for x in weights:
                    steps.append(total[at : at + x.size].reshape(x.shape) / total[0])
                    at += x.size
                steps[0] = steps[0] + 2 * penalty * weights[0]
                losses.append(float(total[1] / total[0]))
                adam.step(steps)
        finally:
            kept.unpersist()
    return weights, losses


def _kept(rows: DataFrame, names: list[str]):
    """An RDD of dictionaries of arrays, kept on the executors' disks; a table of few partitions is dealt out to all cores."""
    import pickle

    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                block = {c: _numpy(batch.column(c)) for c in names}
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))).persist(StorageLevel.DISK_ONLY)


def _labelled(g: RelGraph, train: DataFrame, classes: DataFrame, in_tasks: bool | None) -> tuple[DataFrame, bool]:
    """((node_id, class_idx, w) of the nodes to learn from, whether tasks learn from them: by default where they are more than ``MOST_LABELLED``)."""
    rows = g.nodes.join(train.select("node_id"), "node_id", "left_semi")
    n = rows.count()
    if not n:
        raise ValueError("the networks need a labelled node")
    if in_tasks is False and n > MOST_LABELLED:
        raise ValueError(f"{n} labelled nodes; {MOST_LABELLED} are learned from in one place, any number in tasks")
    w = class_counts(rows).select("label", F.col("support_weight").alias("w"))
    return rows.join(F.broadcast(classes), "label").join(F.broadcast(w), "label").select("node_id", "class_idx", "w"), n > MOST_LABELLED if in_tasks is None else in_tasks


def _dense(rows: DataFrame, *columns: str) -> tuple:
    """The collected rows, ordered: arrays of their vectors and values; the rows are of labelled nodes and their neighbours."""
    got = rows.orderBy("node_id").toArrow()
    out = []
    for c in columns:
        values = got.column(c).combine_chunks()
        out.append(np.array(values.to_pylist(), float) if str(values.type).startswith("list") else values.to_numpy(zero_copy_only=False))
    return tuple(out)


def _apply(rows: DataFrame, columns: list[str], work, out: str, kind: str) -> DataFrame:
    """(node_id, out): a numpy function of vector columns, batch by batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                vectors = [np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(float) for c in columns]
                got = work(*vectors)
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(got if got.ndim == 1 else list(got))], names=["node_id", out])

    scratch.ship(rows.sparkSession)
    node = rows.schema["node_id"].dataType.simpleString()
    return rows.select("node_id", *columns).mapInArrow(run, f"node_id {node}, {out} {kind}")


def _named(scored: DataFrame, g: RelGraph, classes: DataFrame, test: DataFrame) -> DataFrame:
    """(node_id, label, pred) of the test nodes from (node_id, class_idx)."""
    pred = scored.join(F.broadcast(classes.withColumnRenamed("label", "pred")), "class_idx").select("node_id", "pred")
    return pred.join(test.select("node_id"), "node_id", "left_semi").join(g.nodes, "node_id").select("node_id", "label", "pred")


def simple_convolution(g: RelGraph, train: DataFrame, test: DataFrame, hops: int = 2, epochs: int = 50, rate: float = 0.2, drop: float = 0.5, penalty: float = 5e-4, seed: int = 0, in_tasks: bool | None = None, batches: int = 1) -> DataFrame:
    """Features averaged over ``hops`` rounds of the symmetric normalisation, then one softmax layer with dropout, weighted classes, and Adam."""
    classes = g.classes()
    x = scratch.materialise(propagate(g.features, g.edges, "sym", hops).select("node_id", "features"), "convolved")
    known, spread = _labelled(g, train, classes, in_tasks)
    if spread:
        rows = scratch.materialise(known.join(x.withColumnRenamed("features", "x"), "node_id").select(F.xxhash64("node_id").alias("mark"), "x", "class_idx", "w"), "labelled")
        start = [glorot(np.random.default_rng(seed), width_of(x), classes.count()), np.zeros(classes.count())]
        layer, _ = fit_in_tasks(rows, start, lambda now, part, turn: softmax_rows_gradient(now, part, seed, turn, drop), epochs, rate, batches, penalty, start[0].shape[0])
    else:
        rows, y, w = _dense(known.join(x, "node_id"), "features", "class_idx", "w")
        layer = fit_softmax(rows, y.astype(int), w.astype(float), classes.count(), epochs, rate, drop, penalty, seed)
    scored = _apply(x, ["features"], lambda v: (v @ layer[0] + layer[1]).argmax(axis=1).astype(np.int32), "class_idx", "int")
    return _named(scored, g, classes, test)


def neighbour_means(near: DataFrame, x: DataFrame, column: str) -> DataFrame:
    """(node_id, m): the mean of a vector over each node's neighbours in ``near`` (node, nbr)."""
    joined = near.join(x.select(F.col("node_id").alias("nbr"), F.col(column).alias("m")), "nbr")
    return vector_sums(joined.withColumnRenamed("node", "node_id"), ["node_id"], "m", width_of(x, column), mean=True)


def _fit_in_place(known: DataFrame, means: DataFrame, outer: DataFrame, classes: int, hidden: int, epochs: int, rate: float, drop: float, seed: int) -> list[np.ndarray]:
    """The weights of ``sampled_means`` from the collected rows of at most ``MOST_LABELLED`` labelled nodes."""
    own, mean, y, w, ids = _dense(known.join(means, "node_id"), "x", "m0", "class_idx", "w", "node_id")
    around = outer.join(known.select(F.col("node_id").alias("node")), "node", "left_semi").join(means.select(F.col("node_id").alias("nbr"), "x", "m1"), "nbr").select(F.col("node").alias("node_id"), "x", "m1")
    near, near_mean, of = _dense(around, "x", "m1", "node_id")
    at = {v: i for i, v in enumerate(ids.tolist())}
    return fit_means(own, mean, near, near_mean, np.array([at[v] for v in of.tolist()]), y.astype(int), w.astype(float), classes, hidden, epochs, rate, drop, seed)


def sampled_means(g: RelGraph, train: DataFrame, test: DataFrame, samples: tuple[int, int] = (10, 5), hidden: int = 32, epochs: int = 50, rate: float = 0.2, drop: float = 0.5, seed: int = 0, in_tasks: bool | None = None, batches: int = 1, pool: int = 4) -> DataFrame:
    """Two layers that join a node with the mean of sampled neighbours, learned end to end; isolates are left out.

    The neighbours are sampled once, by hash: ``samples[0]`` of each node, and ``samples[1]`` of
    each of these.  Learning in tasks draws ``samples[0]`` neighbours anew in each step, from a pool of ``pool`` times as many of each node.
    """
    nodes = drop_isolates(g.nodes, g.edges)
    inner = RelGraph(nodes, g.edges, g.features.join(nodes.select("node_id"), "node_id", "left_semi"))
    classes = inner.classes()
    x = inner.features.select("node_id", F.col("features").alias("x"))
    outer = scratch.materialise(sampled_neighbours(inner.adj, samples[0], seed), "near")
    means = x.join(neighbour_means(outer, x, "x").withColumnRenamed("m", "m0"), "node_id").join(neighbour_means(sampled_neighbours(inner.adj, samples[1], seed + 1), x, "x").withColumnRenamed("m", "m1"), "node_id")
    means = scratch.materialise(means, "means")
    known, spread = _labelled(inner, train, classes, in_tasks)
    known = scratch.materialise(known, "labelled")
    if spread:
        wide = sampled_neighbours(inner.adj.join(known.select(F.col("node_id").alias("node")), "node", "left_semi"), pool * samples[0], seed)
        # pool x samples neighbours of a node at most
        lists = wide.join(means.select(F.col("node_id").alias("nbr"), "x", "m1"), "nbr").groupBy(F.col("node").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("nbr", "x", "m1"))).alias("_near"))
        rows = known.join(means.select("node_id", "x", "m0"), "node_id").join(lists, "node_id").select(F.xxhash64("node_id").alias("mark"), "x", "m0", "class_idx", "w", F.transform("_near", lambda e: e["x"]).alias("near_x"), F.transform("_near", lambda e: e["m1"]).alias("near_m"))
        start = means_weights(np.random.default_rng(seed), width_of(x, "x"), hidden, classes.count())
        # not as a scratch table: Spark's reader would hold some thousands of such rows, of 40 KB each, at once
        net, _ = fit_in_tasks(rows, start, lambda now, part, turn: means_rows_gradient(now, part, seed, turn, samples[0], drop), epochs, rate, batches, row_values=(pool * samples[0] + 1) * 2 * start[0].shape[0])
    else:
        net = _fit_in_place(known, means, outer, classes.count(), hidden, epochs, rate, drop, seed)
    layer = lambda a, b: np.maximum(np.hstack([a @ net[0], b @ net[1]]), 0)
    first = scratch.materialise(_apply(means, ["x", "m1"], layer, "h", "array<double>"), "hidden")
    pooled = neighbour_means(outer, first, "h")
    last = means.select("node_id", "x", "m0").join(pooled, "node_id")
    half = hidden // 2

    def top(a, b, m):
        z = np.maximum(np.hstack([layer(a, b) @ net[2], m @ net[3]]), 0)
        assert z.shape[1] == 2 * half
        return (z @ net[4] + net[5]).argmax(axis=1).astype(np.int32)

    return _named(_apply(last, ["x", "m0", "m"], top, "class_idx", "int"), inner, classes, test)
