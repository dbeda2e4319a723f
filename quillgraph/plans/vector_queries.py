"""Registered queries of vectors, memberships, draws and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import sql_key, sql_uniform, uniform
from ..functions.vectors import argmax, columns_long, distance, gather, one_hot, primes, rbf, z_scores
from ..operators import models, propagate, relational, sampling
from ..operators.graph import relabelled, touching
from . import experiment, scratch
from .fixtures import F1, F2, TRIALS, co_order, table, trials, vector_graph, written
from .registry import query

SEED, SIZE = 7, 64
_SPLIT = f"s AS (SELECT node_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key(SEED, 'split', 'node_id')}, node_id) <= greatest(floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5), 1) AS is_train FROM g), pool AS (SELECT node_id FROM s WHERE is_train)"
_VECTORS = "x AS (SELECT vec_id AS node_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS f FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("features"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(co_order(spark, d).nodes, 0.8, SEED).where("is_train").select("node_id")


@query("feature_projection", f"WITH {_VECTORS} SELECT node_id, round(f[1], 6) + 0.0 AS a, round(f[6], 6) + 0.0 AS b, round(f[10], 6) + 0.0 AS c FROM x")
def feature_projection(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("node_id", gather("features", [0, 5, 9]).alias("p"))
    return v.select("node_id", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate("abc")])


@query("vector_slice_append", f"WITH {_VECTORS} SELECT node_id, round(list_sum(list_concat(f[2:4], [1.0])), 6) AS total, CAST(4 AS INT) AS width FROM x")
def vector_slice_append(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("node_id", F.concat(F.slice("features", 2, 3), F.array(F.lit(1.0))).alias("p"))
    return v.select("node_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("p").alias("width"))


@query("vector_argmax", f"WITH {_VECTORS} SELECT node_id, CAST(list_position(f, list_max(f)) - 1 AS BIGINT) AS at FROM x")
def vector_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("node_id", argmax("features").cast("long").alias("at"))


_CENTRE = "c AS (SELECT f AS centre FROM x WHERE node_id = (SELECT min(node_id) FROM x))"


@query("rbf_to_center", f"WITH {_VECTORS}, {_CENTRE} SELECT node_id, round(exp(-0.05 * list_sum(list_transform(list_zip(f, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 8) AS similarity FROM x, c")
def rbf_to_centre(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    centre = v.orderBy("node_id").limit(1).select(F.col("features").alias("centre"))
    return v.crossJoin(F.broadcast(centre)).select("node_id", F.round(rbf("features", "centre", 0.05), 8).alias("similarity"))


@query("one_hot_labels", "SELECT vec_id AS node_id, CAST(pos AS INT) AS pos, CASE WHEN label = pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM embeddings, (SELECT unnest(generate_series(0, 9)) AS pos)")
def one_hot_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), one_hot(F.col("label"), 10).alias("h"))
    return columns_long(e, "node_id", "h")


@query("z_scores", f"WITH {_VECTORS}, l AS (SELECT node_id, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS value FROM x), m AS (SELECT pos, avg(value) AS a, stddev_pop(value) AS s FROM l GROUP BY 1) SELECT node_id, CAST(l.pos AS INT) AS pos, round(CASE WHEN s > 0 THEN (value - a) / s ELSE 0 END, 6) + 0.0 AS value FROM l JOIN m ON m.pos = l.pos")
def z_scores_query(spark: SparkSession, d: str) -> DataFrame:
    return z_scores(columns_long(_vectors(spark, d), "node_id", "features")).select("node_id", "pos", F.round("value", 6).alias("value"))


@query("primes", "WITH n AS (SELECT unnest(generate_series(2, 541)) AS p) SELECT p AS prime, round(ln(p), 9) AS ln FROM n WHERE NOT EXISTS (SELECT 1 FROM n q WHERE q.p * q.p <= n.p AND n.p % q.p = 0)")
def primes_query(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in primes(100)], "prime long").select("prime", F.round(F.log("prime"), 9).alias("ln"))


@query("renamed_labels", f"WITH {F1} SELECT node_id, CASE label WHEN 'PROMO BRUSHED STEEL' THEN 'a' WHEN (SELECT min(label) FROM g) THEN 'first' ELSE label END AS label FROM g")
def renamed_labels(spark: SparkSession, d: str) -> DataFrame:
    nodes = co_order(spark, d).nodes
    return relabelled(nodes, {"PROMO BRUSHED STEEL": "a", nodes.agg(F.min("label")).first()[0]: "first"})


@query("null_counts", "SELECT count(*) AS n, CAST(sum(CASE WHEN TRY_CAST(props AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM events")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.sum(F.expr("CASE WHEN try_cast(props AS double) IS NULL THEN 1 ELSE 0 END")).alias("n_null"))


@query("high_feature_nodes", f"WITH {_VECTORS}, l AS (SELECT node_id, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS value FROM x), m AS (SELECT pos, quantile_cont(value, 0.9) AS t, avg(value) AS a, stddev_pop(value) AS s FROM l GROUP BY 1) SELECT node_id, count(*) AS n_high, CAST(sum(CASE WHEN value > a + 2 * s THEN 1 ELSE 0 END) AS BIGINT) AS n_far FROM l JOIN m ON m.pos = l.pos WHERE value > t GROUP BY 1")
def high_feature_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with values in the highest tenth of a position, and how many lie two deviations above its mean."""
    long = columns_long(_vectors(spark, d), "node_id", "features")
    at = long.groupBy("pos").agg(F.percentile("value", 0.9).alias("t"), F.avg("value").alias("a"), F.stddev_pop("value").alias("s"))
    return long.join(F.broadcast(at), "pos").where("value > t").groupBy("node_id").agg(F.count("*").alias("n_high"), F.sum(F.expr("CASE WHEN value > a + 2 * s THEN 1 ELSE 0 END")).alias("n_far"))


# memberships


_EIGHT = "mm AS (SELECT node_id, CAST(node_id % 8 AS INT) AS cluster FROM g)"


def _eight(spark: SparkSession, d: str) -> DataFrame:
    return co_order(spark, d).nodes.select("node_id", (F.col("node_id") % 8).cast("int").alias("cluster"))


@query("cluster_pool", f"WITH {F1}, {_SPLIT}, {_EIGHT} SELECT cluster, node_id FROM mm WHERE node_id IN (SELECT node_id FROM pool)")
def cluster_pool(spark: SparkSession, d: str) -> DataFrame:
    return _eight(spark, d).join(_pool(spark, d), "node_id", "left_semi").select("cluster", "node_id")


@query("neighbor_clusters", f"WITH {F1}, {_EIGHT} SELECT node AS node_id, cluster, count(*) AS n FROM a JOIN mm ON mm.node_id = nbr GROUP BY 1, 2")
def neighbour_clusters(spark: SparkSession, d: str) -> DataFrame:
    return relational.neighbour_clusters(co_order(spark, d).adj, _eight(spark, d))


@query("cluster_subgraphs", f"WITH {F1}, {_EIGHT} SELECT x.cluster, u, v FROM e JOIN mm x ON x.node_id = u JOIN mm y ON y.node_id = v WHERE x.cluster = y.cluster")
def cluster_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    return relational.cluster_edges(co_order(spark, d).edges, _eight(spark, d))


_SEEDS = f"sd AS (SELECT node_id FROM pool ORDER BY {sql_key(SEED, 'rs', 'node_id')}, node_id LIMIT 8)"


@query("unlabelled_pool", f"WITH {F1}, {_SPLIT}, {_SEEDS} SELECT node_id FROM pool EXCEPT SELECT node_id FROM sd")
def unlabelled_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return pool.join(sampling.random_nodes(co_order(spark, d), 8, pool, SEED), "node_id", "left_anti")


@query("labelled_union", f"WITH {F1}, {_SPLIT}, {_SEEDS}, dg AS (SELECT node AS node_id, count(*) AS n FROM a GROUP BY 1) SELECT node_id FROM sd UNION SELECT node_id FROM (SELECT node_id FROM dg JOIN pool USING (node_id) ORDER BY n DESC, node_id LIMIT 16)")
def labelled_union(spark: SparkSession, d: str) -> DataFrame:
    g, pool = co_order(spark, d), _pool(spark, d)
    picks = sampling.by_degree(g, 16, pool, SEED)
    return sampling.random_nodes(g, 8, pool, SEED).select("node_id").unionByName(picks.select("node_id")).distinct()


@query("touched_parts", f"WITH {F1} SELECT p_partkey, p_type FROM part WHERE p_partkey IN (SELECT u FROM e) OR p_partkey IN (SELECT v FROM e)")
def touched_parts(spark: SparkSession, d: str) -> DataFrame:
    return touching(co_order(spark, d).edges, table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")


@query("other_classes", f"WITH {F1}, c AS (SELECT label, count(*) AS n FROM g GROUP BY 1) SELECT label, (SELECT count(*) FROM g) - n AS others FROM c")
def other_classes(spark: SparkSession, d: str) -> DataFrame:
    per = relational.class_counts(co_order(spark, d).nodes)
    return per.select("label", (F.col("n") / F.col("prior") + 0.5).cast("long").alias("all"), "n").select("label", (F.col("all") - F.col("n")).alias("others"))


# draws

_NEAR = "c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) AS INT) AS i, embedding AS centre FROM embeddings ORDER BY vec_id LIMIT 12)"


@query("nearest_unused", f"""WITH RECURSIVE x AS (SELECT vec_id AS node_id, embedding AS f FROM embeddings), {_NEAR},
dd AS (SELECT i, node_id, row_number() OVER (PARTITION BY i ORDER BY sqrt(list_sum(list_transform(list_zip(f, centre), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), node_id) AS r FROM x, c),
k AS (SELECT i, list(node_id ORDER BY r) AS near FROM dd WHERE r <= 12 GROUP BY 1),
w AS (SELECT 0 AS i, []::BIGINT[] AS taken UNION ALL SELECT k.i, list_append(taken, list_filter(near, lambda y: NOT list_contains(taken, y))[1]) FROM w JOIN k ON k.i = w.i + 1)
SELECT unnest(taken) AS node_id, CAST(unnest(generate_series(1, len(taken))) AS INT) AS ord FROM w WHERE i = 12""")
def nearest_unused(spark: SparkSession, d: str) -> DataFrame:
    """Twelve centres, a stated query set, each take the nearest of all vectors that none before has taken."""
    v = _vectors(spark, d)
    centres = [r[0] for r in v.orderBy("node_id").limit(12).select("features").collect()]
    return sampling.nearest_unused(v, centres)


@query("wl_picks", f"""WITH {F1}, {_SPLIT}, ie AS (SELECT node, nbr FROM a WHERE node IN (SELECT node_id FROM pool) AND nbr IN (SELECT node_id FROM pool)),
q AS (SELECT node_id AS ego FROM pool ORDER BY {sql_key(SEED * 1000, 'rs', 'node_id')}, node_id LIMIT 8),
h1 AS (SELECT ego, nbr AS node FROM q JOIN ie ON node = ego), h AS (SELECT ego, node FROM h1 UNION SELECT ego, ie.nbr FROM h1 JOIN ie ON ie.node = h1.node)
SELECT ego, count(*) AS members FROM h GROUP BY 1""")
def wl_picks(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the neighbourhoods that the structural sampler colours in its first turn."""
    from ..operators.graph import induced
    from ..operators.structure import egos

    g, pool = co_order(spark, d), _pool(spark, d)
    draws = sampling.random_nodes(g, 8, pool, SEED * 1000)
    return egos(induced(g.edges, pool), draws, 2)[0].groupBy("ego").agg(F.count("*").alias("members"))


@query("final_ranking", f"""WITH {TRIALS}, sc AS (SELECT 'd' || trial AS dataset, 'c' || budget AS classifier, algo, round(avg(f1), 6) AS f1 FROM t GROUP BY 1, 2, 3),
rk AS (SELECT algo, rank() OVER (PARTITION BY dataset, classifier ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY dataset, classifier, f1) - 1) / 2.0 AS r FROM sc),
m AS (SELECT algo, round(avg(r), 2) AS rank_mean FROM rk GROUP BY 1)
SELECT algo, rank_mean, CAST(floor(rank() OVER (ORDER BY rank_mean) + (count(*) OVER (PARTITION BY rank_mean) - 1) / 2.0) AS INT) AS final_rank FROM m ORDER BY final_rank, algo""")
def final_ranking(spark: SparkSession, d: str) -> DataFrame:
    scores = trials(spark, d).groupBy(F.concat(F.lit("d"), "trial").alias("dataset"), F.concat(F.lit("c"), "budget").alias("classifier"), "algo").agg(F.round(F.avg("f1"), 6).alias("f1"))
    return experiment.rank_table(scores).select("algo", "rank_mean", "final_rank").orderBy("final_rank", "algo")


# scores of given coefficients

_PROBA = f"pr AS (SELECT node_id, label, {sql_uniform(SEED, 'a', 'node_id')} AS a, {sql_uniform(SEED, 'b', 'node_id')} AS b FROM g), k AS (SELECT label, count(*) AS n FROM g GROUP BY 1), i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, (SELECT count(*) FROM g) / CAST(n AS DOUBLE) AS w FROM k)"


@query("weighted_cross_entropy", f"WITH {F1}, {_PROBA} SELECT round(avg(-ln(least(greatest(CASE WHEN i % 2 = 0 THEN a ELSE b END / (a * ceil((SELECT count(*) FROM k) / 2.0) + b * floor((SELECT count(*) FROM k) / 2.0)), 1e-7), 1 - 1e-7)) * w), 8) AS loss FROM pr JOIN i USING (label)")
def weighted_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """The weighted loss of made-up probabilities, which alternate over the classes."""
    nodes = co_order(spark, d).nodes
    g = co_order(spark, d)
    n = g.classes().count()
    each = F.array(*[(uniform(SEED, "a", "node_id") if i % 2 == 0 else uniform(SEED, "b", "node_id")) for i in range(n)])
    loss = models.weighted_cross_entropy(nodes.select("label", each.alias("proba")), g.classes(), relational.class_counts(nodes))
    return loss.select(F.round("loss", 8).alias("loss"))


@query("relational_rows", f"WITH {F1}, {_SPLIT}, c AS (SELECT a.node AS node_id, count(*) AS n FROM a JOIN pool ON pool.node_id = a.nbr GROUP BY 1) SELECT g.node_id, CAST(2 + (SELECT count(DISTINCT label) FROM g) AS INT) AS width, round(s + p + coalesce(n, 0), 8) AS total FROM g JOIN f USING (node_id) LEFT JOIN c USING (node_id)")
def relational_rows(spark: SparkSession, d: str) -> DataFrame:
    """Width and sum of the relational model's inputs: two features and the counts of labelled neighbours."""
    g, pool = co_order(spark, d), _pool(spark, d)
    names = [r["label"] for r in g.classes().orderBy("class_idx").collect()]
    rows = models.relational_rows(g, g.nodes.join(pool, "node_id", "left_semi"), names)
    return rows.select("node_id", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 8).alias("total"))


@query("sampled_means", f"""WITH {F2}, nb AS (SELECT node, nbr FROM (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY {sql_key(SEED, 'neighbour', 'node', 'nbr')}, nbr) AS r FROM a) WHERE r <= 10),
x AS (SELECT vec_id AS node_id, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT node AS node_id, CAST(pos AS INT) AS pos, round(avg(value), 6) + 0.0 AS value FROM nb JOIN x ON x.node_id = nbr GROUP BY 1, 2""")
def sampled_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean over ten sampled neighbours, the first layer of the sampled-means model."""
    g = written(vector_graph(spark, d))
    width = 64
    layers = models.mean_layers(g, (10,), SEED).select("node_id", F.slice("x", width + 1, width).alias("m"))
    return columns_long(layers, "node_id", "m").select("node_id", "pos", F.round("value", 6).alias("value"))


@query("featprop_distances", f"""WITH {F2}, wt AS (SELECT i, j, sum(w) AS w FROM (SELECT node AS i, nbr AS j, 1.0 AS w FROM a UNION ALL SELECT node_id, node_id, 1.0 FROM g) GROUP BY 1, 2), dg AS (SELECT node, count(*) + 1.0 AS d FROM a GROUP BY 1),
x AS (SELECT vec_id AS node_id, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id IN (SELECT node_id FROM g)),
h AS (SELECT i AS node_id, pos, sum(w / sqrt(di.d * dj.d) * value) AS value FROM wt JOIN dg di ON di.node = i JOIN dg dj ON dj.node = j JOIN x ON x.node_id = j GROUP BY 1, 2),
c0 AS (SELECT * FROM h WHERE node_id = (SELECT min(node_id) FROM h))
SELECT h.node_id, round(sqrt(sum((h.value - c0.value) * (h.value - c0.value))), 5) AS d FROM h JOIN c0 ON c0.pos = h.pos GROUP BY 1""")
def featprop_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of propagated features to those of the first node, what the propagation sampler clusters by."""
    g = written(vector_graph(spark, d))
    moved = scratch.materialise(propagate.propagate(g.features, g.edges, "sym"), "moved")
    first = moved.orderBy("node_id").limit(1).select(F.col("features").alias("centre"))
    return moved.crossJoin(F.broadcast(first)).select("node_id", F.round(distance("features", "centre"), 5).alias("d"))


@query("synthetic_nodes", f"WITH n AS (SELECT unnest(generate_series(0, (SELECT count(*) FROM part) - 1)) AS id) SELECT id AS node_id, CAST(floor({sql_uniform(SEED, 'class', 'id')} * 3) AS INT) AS c FROM n")
def synthetic_nodes(spark: SparkSession, d: str) -> DataFrame:
    from .synth import planted_classes

    return planted_classes(spark, table(spark, d, "part").count(), 3, 0.0, SEED)
