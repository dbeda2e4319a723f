"""Clusters of nodes: spectral bisection, k-means, relational-kernel spectral clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .krylov import leading_vectors

#: Bounds of what dense methods bring to the driver: nodes of a bisection, rows of a kernel.
MOST_NODES, MOST_ROWS = 3000, 3000


def _dense(edges: DataFrame) -> tuple[list, np.ndarray]:
    n = edges.select(F.explode(F.array("u", "v")).alias("x")).agg(F.count_distinct("x")).first()[0]
    if n > MOST_NODES:
        raise ValueError(f"{n} nodes; dense bisection takes {MOST_NODES} at most, use mode='power'")
    pairs = edges.select("u", "v").collect()
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for u, v in pairs:
        a[at[u], at[v]] = a[at[v], at[u]] = 1.0
    return ids, a


def _modularity(a: np.ndarray) -> np.ndarray:
    k = a.sum(axis=1) + np.diag(a)  # a self-loop counts two in a degree
    m2 = k.sum()
    return a - np.outer(k, k) / m2 if m2 else a


def modularity_clusters(edges: DataFrame, cap: float, mode: str = "eigenvalue_count") -> DataFrame:
    """(cluster, node_id) by recursive bisection; a part below ``cap`` is not split, nor is one whose halves would be.

    'eigenvalue_count' splits the ids in order at the number of eigenvalues that are not positive
    (with a tolerance, as zero is always an eigenvalue); 'leading_eigenvector' splits by the signs
    of the leading eigenvector; both are dense and raise above ``MOST_NODES`` nodes.  'krylov' (or 'power') finds
    that vector by Krylov iteration on blocks of nodes, all parts of a level at once, at any size.  Nothing comes of a graph smaller than ``cap``.
    """
    if mode in ("krylov", "power"):
        return _krylov_clusters(edges, cap)
    ids, a = _dense(edges)
    out: list[np.ndarray] = []

    def split(part: np.ndarray) -> None:
        if len(part) < cap:
            return
        values, vectors = np.linalg.eigh(_modularity(a[np.ix_(part, part)]))
        plus = values > 1e-9 if mode == "eigenvalue_count" else vectors[:, -1] > 0
        if plus.sum() < cap or (~plus).sum() < cap:
            out.append(part)
            return
        split(part[plus])
        split(part[~plus])

    if ids:
        split(np.arange(len(ids)))
    rows = [(c, ids[i]) for c, part in enumerate(out) for i in part.tolist()]
    kind = edges.schema["u"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(rows, f"cluster int, node_id {kind}")


def _krylov_clusters(edges: DataFrame, cap: float) -> DataFrame:
    """(cluster, node_id): every level splits all its parts by the same jobs; clusters are numbered by their least node."""
    from ..plans import scratch
    from .graph import adjacency, end_points

    parts = scratch.materialise(end_points(edges).select(F.lit(0).alias("part"), "node_id"), "parts")
    if parts.count() < cap:
        return parts.select(F.col("part").alias("cluster"), "node_id").limit(0)
    adj, done, made = scratch.materialise(adjacency(edges), "arcs"), None, 1
    while True:
        ends = (parts.select(F.col("node_id").alias(c), F.col("part").alias(f"_{c}")) for c in ("node", "nbr"))
        inside = adj
        for end, c in zip(ends, ("node", "nbr"), strict=True):
            inside = inside.join(end, c)
        arcs = scratch.materialise(inside.where("_node = _nbr").select("node", "nbr"), "inside")
        halves = scratch.materialise(leading_vectors(parts, arcs).select("part", (F.col("x") > 0).cast("int").alias("half"), "node_id"), "halves")
        # two rows for each part, and a part has ``cap`` nodes at least
        sizes: dict = {}
        for p, half, n in halves.groupBy("part", "half").agg(F.count("*")).collect():
            sizes.setdefault(p, {})[half] = n
        split = [p for p, s in sorted(sizes.items()) if len(s) == 2 and min(s.values()) >= cap]
        left = [p for p in sizes if p not in split]
        if left:
            whole = halves.where(F.col("part").isin(left)).select("part", "node_id")
            done = whole if done is None else done.unionByName(whole)
        if not split:
            break
        rows = [(p, half, made + 2 * i + half) for i, p in enumerate(split) for half in (0, 1)]
        made += 2 * len(split)
        names = F.broadcast(edges.sparkSession.createDataFrame(rows, "part int, half int, next int"))
        parts = scratch.materialise(halves.join(names, ["part", "half"]).select(F.col("next").alias("part"), "node_id"), "parts")
    done = scratch.materialise(done, "clusters")
    first = done.groupBy("part").agg(F.min("node_id").alias("least"))
    # a row for each cluster
    order = {p: i for i, (p, _) in enumerate(sorted(first.collect(), key=lambda r: r["least"]))}
    names = F.broadcast(edges.sparkSession.createDataFrame(list(order.items()), "part int, cluster int"))
    return done.join(names, "part").select("cluster", "node_id")


def power_bisection(edges: DataFrame) -> DataFrame:
    """(cluster, node_id): signs of the leading modularity eigenvector by Krylov iteration on blocks of nodes (``krylov``), at any size; the least node is in cluster 0."""
    from ..plans import scratch
    from .graph import adjacency, end_points

    members = scratch.materialise(end_points(edges).select(F.lit(0).alias("part"), "node_id"), "part")
    x = scratch.materialise(leading_vectors(members, scratch.materialise(adjacency(edges), "arcs")), "leading")
    least = x.agg(F.min_by(F.col("x") > 0, "node_id").alias("_first"))
    return x.crossJoin(F.broadcast(least)).select(((F.col("x") > 0) != F.col("_first")).cast("int").alias("cluster"), "node_id")


def kmeans_clusters(features: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, list]:
    """((node_id, cluster, features), centres) by k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(features.withColumn("_v", array_to_vector("features")))
    out = model.transform(features.withColumn("_v", array_to_vector("features"))).drop("_v")
    return out, [c.tolist() for c in model.clusterCenters()]


def relational_kernel(features: DataFrame, edges: DataFrame, s: float = 1.0) -> tuple[list, np.ndarray]:
    """(ids, K): D A RBF(V) A D over at most ``MOST_ROWS`` nodes; gamma is the median squared distance of scaled features times s."""
    n = features.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows; the kernel is dense and takes {MOST_ROWS} at most, use power_iteration_clusters")
    rows = sorted(features.select("node_id", "features").collect())
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((n, n))
    for x, y in edges.select("u", "v").collect():
        if x in at and y in at:
            a[at[x], at[y]] = a[at[y], at[x]] = 1.0
    spread = v.std(axis=0)
    z = (v - v.mean(axis=0)) / np.where(spread > 0, spread, 1)
    gamma = median_gamma(z)
    d2 = square_distances(v)
    inverse = 1 / np.maximum(a.sum(axis=1), 1)
    return ids, inverse[:, None] * (a @ np.exp(-gamma * s * d2) @ a) * inverse[None, :]


def square_distances(v: np.ndarray) -> np.ndarray:
    """Between all rows, by the identity of the inner product, so nothing is wider than the result."""
    size = (v * v).sum(axis=1)
    return np.maximum(size[:, None] + size[None, :] - 2 * (v @ v.T), 0)


def median_gamma(z: np.ndarray) -> float:
    """Median of the nonzero squared distances between rows."""
    d2 = square_distances(z)
    low = d2[np.tril_indices(len(z), -1)]
    low = low[low > 1e-9]
    return float(np.median(low)) if len(low) else 0.0


def spectral_clusters(features: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, list]:
    """((node_id, cluster), kernel, ids): k-means on the leading eigenvectors of the normalised kernel."""
    ids, kernel = relational_kernel(features, edges)
    d = np.sqrt(np.maximum(kernel.sum(axis=1), 1e-12))
    _, vectors = np.linalg.eigh(kernel / d[:, None] / d[None, :])
    lead = vectors[:, -k:]
    lead = lead / np.maximum(np.linalg.norm(lead, axis=1, keepdims=True), 1e-12)
    kind = features.schema["node_id"].dataType.simpleString()
    table = features.sparkSession.createDataFrame([(i, x.tolist()) for i, x in zip(ids, lead, strict=True)], f"node_id {kind}, features array<double>")
    return kmeans_clusters(table, k)[0].select("node_id", "cluster"), kernel, ids


def medoids(features: DataFrame, edges: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(node_id, ord): of each spectral cluster the pool node most similar, on average, to the cluster's pool nodes."""
    clusters, kernel, ids = spectral_clusters(features, edges, k)
    of = dict(clusters.join(pool.select("node_id"), "node_id", "left_semi").collect())
    at = {x: i for i, x in enumerate(ids)}
    rows = []
    for c in sorted(set(of.values())):
        own = sorted(x for x in of if of[x] == c)
        i = [at[x] for x in own]
        rows.append((own[int(np.argmax(kernel[np.ix_(i, i)].mean(axis=1)))], len(rows) + 1))
    return features.sparkSession.createDataFrame(rows, f"node_id {features.schema['node_id'].dataType.simpleString()}, ord int")


#: Random features of a thin kernel factor (half as many frequencies).
FEATURES = 256


def thin_kernel(features: DataFrame, edges: DataFrame, s: float = 1.0, gamma: float | None = None, count: int = FEATURES, seed: int = 0) -> DataFrame:
    """(node_id, f): K, the kernel of ``relational_kernel``, is about the products of these vectors, at any number of rows.

    The RBF kernel is the expected product of cosines and sines at random frequencies; each node's vector is the mean of those of its
    neighbours, one join and one sum of vectors.  An entry of the RBF kernel is off by about 1 / sqrt(count / 2).  gamma,
    if not given, is the median squared distance of scaled features (``metric.median_square``).  Nodes without neighbours that have features have zeros.
    """
    from ..functions.vectors import vector_sums, width_of
    from ..plans import scratch
    from . import metric
    from .graph import adjacency

    spark, width = features.sparkSession, width_of(features)
    scratch.ship(spark)
    rows = features.select("node_id", F.col("features").cast("array<double>").alias("features"))
    if gamma is None:
        gamma = metric.median_square(_standardised(rows, width)) if width else 0.0
    frequencies = np.random.default_rng(seed).normal(size=(width, count // 2)) * np.sqrt(2 * gamma * s)
    sent = spark.sparkContext.broadcast(frequencies)
    kind = features.schema["node_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                angle = metric.matrix(batch.column("features"), width) @ sent.value
                z = np.hstack([np.cos(angle), np.sin(angle)]) / np.sqrt(sent.value.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(list(z), pa.list_(pa.float64()))], names=["nbr", "f"])

    waves = rows.mapInArrow(work, f"nbr {kind}, f array<double>")
    near = adjacency(edges).join(waves, "nbr").withColumnRenamed("node", "node_id")
    mean = vector_sums(near, ["node_id"], "f", 2 * (count // 2), mean=True)
    zero = F.array_repeat(F.lit(0.0), 2 * (count // 2))
    return features.select("node_id").join(mean, "node_id", "left").select("node_id", F.coalesce("f", zero).alias("f"))


def _standardised(rows: DataFrame, width: int) -> DataFrame:
    """(node_id, features) less the mean over the population deviation of each position; constant positions stay as deviations from the mean."""
    from ..functions.vectors import vector_sums

    n = max(rows.count(), 1)
    mean = np.array((vector_sums(rows.withColumn("_k", F.lit(0)), ["_k"], "features", width).first() or [0, []])["features"]) / n
    centred = rows.withColumn("features", F.zip_with("features", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b))
    squares = centred.select(F.lit(0).alias("_k"), F.transform("features", lambda x: x * x).alias("features"))
    spread = np.sqrt(np.array(vector_sums(squares, ["_k"], "features", width).first()["features"]) / n)
    return centred.withColumn("features", F.zip_with("features", F.array(*[F.lit(float(v) if v > 0 else 1.0) for v in spread]), lambda a, b: a / b))


def _products(rows: DataFrame, width: int) -> np.ndarray:
    """Sum over (f) rows of f f^T: a small matrix, one for each task on the way."""
    from ..functions.vectors import vector_sums

    def work(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column("f").flatten().to_numpy().reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["k", "f"])

    got = vector_sums(rows.select("f").mapInArrow(work, "k int, f array<double>"), ["k"], "f", width * width).first()
    return np.array(got["f"]).reshape(width, width)


def thin_spectral_clusters(kernel: DataFrame, k: int) -> DataFrame:
    """(node_id, cluster): k-means on the leading eigenvectors of the normalised kernel, from the rows of ``thin_kernel``.

    With K = F F^T the eigenvectors are the left singular vectors of F scaled by the roots of K's row sums; the products of
    F's columns, a matrix as wide as F, come to the driver, the rows never do.
    """
    from ..functions.vectors import vector_sums, width_of
    from ..plans import scratch

    width = width_of(kernel, "f")
    if not width:
        return kernel.select("node_id", F.lit(0).alias("cluster"))
    total = np.array(vector_sums(kernel.withColumn("_k", F.lit(0)), ["_k"], "f", width).first()["f"])
    kind = kernel.schema["node_id"].dataType.simpleString()

    def normalised(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch.column("f").flatten().to_numpy().reshape(-1, width)
                y = x / np.sqrt(np.maximum(x @ total, 1e-12))[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(list(y), pa.list_(pa.float64()))], names=["node_id", "f"])

    rows = scratch.materialise(kernel.select("node_id", "f").mapInArrow(normalised, f"node_id {kind}, f array<double>"), "normalised")
    values, vectors = np.linalg.eigh(_products(rows, width))
    lead = vectors[:, -k:] / np.sqrt(np.maximum(values[-k:], 1e-12))

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                u = batch.column("f").flatten().to_numpy().reshape(-1, width) @ lead
                u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(list(u), pa.list_(pa.float64()))], names=["node_id", "features"])

    points = scratch.materialise(rows.mapInArrow(project, f"node_id {kind}, features array<double>"), "projected")
    return kmeans_clusters(points, k)[0].select("node_id", "cluster")


def thin_medoids(kernel: DataFrame, clusters: DataFrame, pool: DataFrame) -> DataFrame:
    """(node_id, ord): of each cluster the pool node most similar, on average, to the cluster's pool nodes; ties to the least id.

    The mean of products with a cluster's rows is the product with their mean, so a cluster is one vector.
    """
    from ..functions.vectors import vector_sums, width_of

    own = kernel.join(pool.select("node_id"), "node_id", "left_semi").join(clusters, "node_id")
    # a row for each cluster
    mean = vector_sums(own, ["cluster"], "f", width_of(kernel, "f"), mean=True).withColumnRenamed("f", "_m")
    score = F.aggregate(F.zip_with("f", "_m", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    best = own.join(F.broadcast(mean), "cluster").groupBy("cluster").agg(F.min_by("node_id", F.struct(-score, "node_id")).alias("node_id"))
    rows = [(r["node_id"], i + 1) for i, r in enumerate(best.orderBy("cluster").collect())]
    return kernel.sparkSession.createDataFrame(rows, f"node_id {kernel.schema['node_id'].dataType.simpleString()}, ord int")


def power_iteration_clusters(pairs: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(id, cluster) from weighted pairs (src, dst, weight) of long ids: k-means on the vector of ``power_iteration``, on blocks of nodes, at any size."""
    from ..plans import scratch
    from .power_blocks import power_iteration

    x = scratch.materialise(power_iteration(pairs, rounds).select(F.col("id").alias("node_id"), F.array("x").alias("features")), "points")
    if x.isEmpty():
        return x.select(F.col("node_id").alias("id"), F.lit(0).alias("cluster"))
    return kmeans_clusters(x, k)[0].select(F.col("node_id").alias("id"), "cluster")
