"""Nearest points and counts of near pairs, exact, by cells around pivots and the triangle inequality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import sort_key
from ..plans import scratch

#: Pivots of an index: what a task holds of it, whatever the number of points.
PIVOTS = 64
#: Distances that a task computes at a time.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class MetricIndex:
    """rows: (node_id, features, cell, r) with the distance to the cell's pivot; cells: {cell: (points, least r, largest r)}."""

    rows: DataFrame
    pivots: np.ndarray
    cells: dict[int, tuple[int, float, float]]

    def without(self, taken: DataFrame) -> MetricIndex:
        """The index less some node_ids; ``taken`` is as small as a labelling budget."""
        return _measured(self.rows.join(F.broadcast(taken.select("node_id")), "node_id", "left_anti"), self.pivots)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of ``a`` to every row of ``b``, each from the differences (no cancellation), a block at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, _BLOCK // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def matrix(column, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if len(column) else np.zeros((0, width))


def _measured(rows: DataFrame, pivots: np.ndarray) -> MetricIndex:
    # a row for each pivot
    cells = {r["cell"]: (r["n"], r["low"], r["high"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    return MetricIndex(rows, pivots, cells)


def build(points: DataFrame, pivots: int = PIVOTS, seed: int = 0) -> MetricIndex:
    """The index of (node_id, features); pivots are points drawn by hash.  Points of a cell lie in any partition, so a large cell is no hot group."""
    scratch.ship(points.sparkSession)
    drawn = points.orderBy(sort_key(seed, "pivot", "node_id"), "node_id").limit(pivots).select("features").collect()
    if not drawn:
        return MetricIndex(points, np.zeros((0, 0)), {})
    centres = np.array([r[0] for r in drawn], float)
    kind = points.schema["node_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column("features"), centres.shape[1]), centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("features"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["node_id", "features", "cell", "r"])

    rows = points.select("node_id", F.col("features").cast("array<double>").alias("features")).mapInArrow(work, f"node_id {kind}, features array<double>, cell int, r double")
    return _measured(scratch.materialise(rows, "metric-index"), centres)


def _reach(index: MetricIndex, d: np.ndarray, k: int) -> np.ndarray:
    """For each query a radius that holds ``k`` points, from the cells' sizes and radii; infinite if there are fewer."""
    ids = sorted(index.cells)
    n = np.array([index.cells[c][0] for c in ids])
    far = d[:, ids] + np.array([index.cells[c][2] for c in ids])[None, :]
    order = np.argsort(far, axis=1)
    enough = np.cumsum(n[order], axis=1) >= k
    at = enough.argmax(axis=1)
    found = np.take_along_axis(far, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), found, np.inf)


def _open_cells(index: MetricIndex, d: np.ndarray, radius: np.ndarray) -> dict[int, np.ndarray]:
    """{cell: the queries that may have a point within their radius there}."""
    slack = 1 + 1e-9
    out = {}
    for c, (_, low, high) in index.cells.items():
        near = (d[:, c] - high <= radius * slack) & (low - d[:, c] <= radius * slack)
        if near.any():
            out[c] = np.flatnonzero(near)
    return out


def nearest(index: MetricIndex, queries: np.ndarray, k: int) -> list[list[tuple[float, object]]]:
    """For each query the ``k`` nearest points as (distance, node_id), of equal ones the least ids; fewer if there are no more.

    ``queries`` is a stated set, as large as a labelling budget.  A first job searches the cells that are sure to hold k points,
    which bounds the distance; a second one those that the bound leaves open.  A task keeps k points for each query.
    """
    if not len(queries) or not index.cells:
        return [[] for _ in queries]
    d = distances(queries, index.pivots)
    reach = _reach(index, d, k)
    ids = sorted(index.cells)
    home = {}
    for q in range(len(queries)):
        held = 0
        for c in sorted(ids, key=lambda c, q=q: d[q, c]):
            home.setdefault(c, []).append(q)
            held += index.cells[c][0]
            if held >= k:
                break
    first = _search(index, queries, d, reach, {c: np.array(q) for c, q in home.items()}, k)
    radius = np.array([min(reach[q], near[k - 1][0]) if len(near) == k else reach[q] for q, near in enumerate(first)])
    left = {c: q[~np.isin(q, home.get(c, []))] for c, q in _open_cells(index, d, radius).items()}
    rest = _search(index, queries, d, radius, {c: q for c, q in left.items() if len(q)}, k)
    return [sorted(a + b)[:k] for a, b in zip(first, rest, strict=True)]


def _search(index: MetricIndex, queries: np.ndarray, d: np.ndarray, radius: np.ndarray, opened: dict, k: int) -> list[list]:
    out: list[list] = [[] for _ in queries]
    if not opened:
        return out
    kind = index.rows.schema["node_id"].dataType.simpleString()
    # queries, their distances to the pivots and the open cells: sizes of the query set and the pivots
    sent = index.rows.sparkSession.sparkContext.broadcast((queries, d, radius * (1 + 1e-9), opened))

    def work(batches):
        import pyarrow as pa

        queries, d, radius, opened = sent.value
        best: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, r, cell = matrix(batch.column("features"), queries.shape[1]), batch.column("r").to_numpy(), batch.column("cell").to_numpy()
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for q in opened[int(c)]:
                    bound = best[q][-1][0] if len(best.get(q, ())) == k else radius[q]
                    some = rows[np.abs(d[q, c] - r[rows]) <= bound * (1 + 1e-9)]
                    if not len(some):
                        continue
                    gap = distances(x[some], queries[q : q + 1])[:, 0]
                    if len(gap) > k:
                        cut = min(bound, np.partition(gap, k - 1)[k - 1])
                        some, gap = some[gap <= cut], gap[gap <= cut]
                    new = zip(gap.tolist(), batch.column("node_id").take(pa.array(some)).to_pylist(), strict=True)
                    best[q] = sorted([*best.get(q, []), *new])[:k]
        flat = [(q, g, n) for q, near in best.items() for g, n in near]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.float64()), pa.array([f[2] for f in flat], node_type)], names=["q", "d", "node_id"])

    from pyspark.sql.pandas.types import to_arrow_type

    node_type = to_arrow_type(index.rows.schema["node_id"].dataType)
    pruned = index.rows.where(F.col("cell").isin(list(opened)))
    near = pruned.mapInArrow(work, f"q int, d double, node_id {kind}")
    # k rows for each task and query are merged to k for each query, which come to the driver
    merged = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "node_id"))), 1, k).alias("near"))
    for r in merged.collect():
        out[r["q"]] = [(x["d"], x["node_id"]) for x in r["near"]]
    return out


#: Points that all points are measured against when a median of distances is sought.
ANCHORS = 4096
_BINS, _FEW = 4096, 50_000


def median_square(points: DataFrame, anchors: int = ANCHORS, least: float = 1e-9, seed: int = 0) -> float:
    """Median of the squared distances above ``least`` between (node_id, features) rows, 0.0 if there are none.

    Distances are to at most ``anchors`` points drawn by hash, so with no more points than that the median is exact over all
    pairs; with more its rank is off by about 1 / sqrt(anchors) of them.  Selection is distributed: tasks count
    distances in bins, the bin of the median is cut into bins again, and only the last few distances are sent.
    """
    spark = points.sparkSession
    scratch.ship(spark)
    drawn = points.orderBy(sort_key(seed, "anchor", "node_id"), "node_id").limit(anchors).select("features").collect()
    if not drawn:
        return 0.0
    centres = np.array([r[0] for r in drawn], float)
    sent = spark.sparkContext.broadcast(centres)

    def over(use, out: dict, schema: str) -> DataFrame:
        def work(batches):
            import pyarrow as pa

            for batch in batches:
                x = matrix(batch.column("features"), sent.value.shape[1])
                step = max(1, _BLOCK // len(sent.value))
                for i in range(0, len(x), step):
                    gaps = distances(x[i : i + step], sent.value).ravel() ** 2
                    row = use(gaps[gaps > least])
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, out[k]) for k, v in row.items()})

        return points.select("features").mapInArrow(work, schema)

    import pyarrow as pa

    floats, longs = pa.float64(), pa.int64()
    edge = over(lambda g: {"n": [len(g)], "low": [g.min() if len(g) else None], "high": [g.max() if len(g) else None]}, {"n": longs, "low": floats, "high": floats}, "n long, low double, high double").agg(F.sum("n"), F.min("low"), F.max("high")).first()
    n, low, high = edge
    if not n:
        return 0.0

    def select(rank: int) -> float:
        a, b, before, inside = low, high, 0, n
        while inside > _FEW and a < b:
            cuts = np.linspace(a, b, _BINS + 1)

            def count(g, cuts=cuts, a=a, b=b):
                own = g[(g >= a) & (g <= b)]
                bins = np.bincount(np.minimum(np.searchsorted(cuts, own, "right") - 1, _BINS - 1), minlength=_BINS)
                used = np.flatnonzero(bins)
                return {"bin": used, "n": bins[used]}

            # a row for each bin
            bins = dict(over(count, {"bin": longs, "n": longs}, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect())
            for i in sorted(bins):
                if before + bins[i] > rank:
                    break
                before += bins[i]
            if (a, b) == (cuts[i], cuts[i + 1]):
                break
            a, b, inside = float(cuts[i]), float(cuts[i + 1]) if i == _BINS - 1 else float(np.nextafter(cuts[i + 1], a)), bins[i]
        if a >= b or inside > _FEW:
            return a
        left = over(lambda g: {"d": g[(g >= a) & (g <= b)]}, {"d": floats}, "d double").orderBy("d").limit(rank - before + 1).agg(F.max("d")).first()[0]
        return float(left)

    return (select((n - 1) // 2) + select(n // 2)) / 2
