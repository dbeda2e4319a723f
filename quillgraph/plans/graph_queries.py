"""Registered queries of the graph engine over the star-schema tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import accuracy, micro_f1
from ..functions.rng import sort_key, sql_key, sql_uniform, uniform
from ..functions.vectors import columns_long, distance, min_max, principal_components
from ..operators import community, models, propagate, relational, sampling, structure
from ..operators.graph import RelGraph, class_index, components, counts, degrees, endpoint_filter, homophily, induced, largest_component, undirected
from ..sources import tables
from . import experiment, scratch
from .fixtures import F1, F2, TRIALS, co_order, co_order_edges, table, trials, vector_graph, written
from .registry import query
from .synth import planted_graph

SEED = 7
#: Training nodes and labelled nodes of the queries, as SQL over the graph's nodes.
SPLIT = f"s AS (SELECT node_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key(SEED, 'split', 'node_id')}, node_id) <= greatest(floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5), 1) AS is_train FROM g)"


def _train(g: RelGraph) -> DataFrame:
    return sampling.stratified_split(g.nodes, 0.8, SEED).where("is_train")


@query("undirected_edges", f"WITH {F1} SELECT u, v FROM e")
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    return undirected(co_order_edges(spark, d))


@query("edge_integrity", "SELECT DISTINCT l_partkey AS src, l_orderkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_orderkey IN (SELECT p_partkey FROM part)")
def edge_integrity(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")).distinct()
    return endpoint_filter(edges, table(spark, d, "part").select(F.col("p_partkey").alias("node_id")))


@query("endpoint_filter", f"WITH {F1}, k AS (SELECT node_id FROM g WHERE label = (SELECT min(label) FROM g)) SELECT u, v FROM e WHERE u IN (SELECT node_id FROM k) AND v IN (SELECT node_id FROM k)")
def endpoint_filter_query(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    first = g.nodes.agg(F.min("label").alias("label"))
    return induced(g.edges, g.nodes.join(F.broadcast(first), "label", "left_semi"))


@query("graph_counts", f"WITH {F1} SELECT (SELECT count(*) FROM g) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM g) * ((SELECT count(*) FROM g) - 1)), 9) AS density")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(co_order(spark, d)).withColumn("density", F.round("density", 9))


@query("class_index", f"WITH {F1} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS class_idx FROM (SELECT DISTINCT label FROM g)")
def class_index_query(spark: SparkSession, d: str) -> DataFrame:
    return class_index(co_order(spark, d).nodes)


_DEGREE = "d AS (SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM e UNION ALL SELECT v FROM e) GROUP BY 1)"


@query("degree_centrality", f"WITH {F2}, {_DEGREE} SELECT node_id, degree, round(degree / CAST((SELECT count(*) FROM d) - 1 AS DOUBLE), 9) AS centrality FROM d")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    deg = degrees(vector_graph(spark, d).edges)
    n = deg.agg((F.count("*") - 1).alias("_n"))
    return deg.crossJoin(F.broadcast(n)).select("node_id", "degree", F.round(F.col("degree") / F.col("_n"), 9).alias("centrality"))


_TRIANGLES = """p AS (SELECT * FROM e WHERE u <> v), b AS (SELECT u AS node, v AS nbr FROM p UNION ALL SELECT v, u FROM p),
t AS (SELECT node_id, CAST(count(x.node) AS BIGINT) AS triangles FROM (SELECT DISTINCT node AS node_id FROM a) LEFT JOIN
      (SELECT b1.node FROM b b1 JOIN b b2 ON b1.node = b2.node AND b1.nbr < b2.nbr JOIN p ON p.u = b1.nbr AND p.v = b2.nbr) x ON x.node = node_id GROUP BY 1)"""
_CLUSTERING = f"{_TRIANGLES}, k AS (SELECT t.node_id, CASE WHEN triangles > 0 THEN 2.0 * triangles / (dd * (dd - 1)) ELSE 0.0 END AS clustering FROM t LEFT JOIN (SELECT node, count(*) AS dd FROM b GROUP BY 1) q ON q.node = t.node_id)"


@query("triangles", f"WITH {F2}, {_TRIANGLES} SELECT node_id, triangles FROM t")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return structure.triangles(vector_graph(spark, d).edges)


@query("clustering_coefficient", f"WITH {F1}, {_CLUSTERING} SELECT node_id, round(clustering, 9) AS clustering FROM k")
def clustering_coefficient(spark: SparkSession, d: str) -> DataFrame:
    return structure.clustering(co_order(spark, d).edges).withColumn("clustering", F.round("clustering", 9))


@query("avg_clustering", f"WITH {F1}, {_CLUSTERING} SELECT round(avg(clustering), 9) AS clustering FROM k")
def avg_clustering(spark: SparkSession, d: str) -> DataFrame:
    return structure.clustering(co_order(spark, d).edges).agg(F.round(F.avg("clustering"), 9).alias("clustering"))


@query("density", f"WITH {F2} SELECT round(2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM g) * ((SELECT count(*) FROM g) - 1)), 9) AS density")
def density(spark: SparkSession, d: str) -> DataFrame:
    return counts(vector_graph(spark, d)).select(F.round("density", 9).alias("density"))


@query("homophily", f"WITH {F1} SELECT round(avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 9) AS homophily FROM e JOIN g x ON x.node_id = u JOIN g y ON y.node_id = v")
def homophily_query(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return homophily(g.edges, g.nodes).select(F.round("homophily", 9).alias("homophily"))


_REACH = "w AS (SELECT node, node AS r FROM a UNION SELECT a.nbr, w.r FROM w JOIN a ON a.node = w.node), z AS (SELECT node AS node_id, min(r) AS component FROM w GROUP BY 1)"


@query("connected_components", f"WITH RECURSIVE {F1}, {_REACH} SELECT node_id, component FROM z")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return components(co_order(spark, d).edges)


@query("component_count", f"WITH RECURSIVE {F1}, {_REACH} SELECT count(DISTINCT component) AS components FROM z")
def component_count(spark: SparkSession, d: str) -> DataFrame:
    return components(co_order(spark, d).edges).agg(F.count_distinct("component").alias("components"))


@query("largest_component", f"WITH RECURSIVE {F1}, {_REACH} SELECT z.node_id, label FROM z JOIN g ON g.node_id = z.node_id WHERE component = (SELECT component FROM z GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def largest(spark: SparkSession, d: str) -> DataFrame:
    return largest_component(co_order(spark, d)).nodes.select("node_id", "label")


def _hop_sql(k: int) -> str:
    return f"""WITH RECURSIVE {F1}, q AS (SELECT node_id AS seed FROM g),
w AS (SELECT seed, seed AS node, 0 AS hop FROM q UNION SELECT w.seed, a.nbr, hop + 1 FROM w JOIN a ON a.node = w.node WHERE hop < {k}),
l AS (SELECT seed, node, min(hop) AS hop FROM w WHERE node <> seed GROUP BY 1, 2)
SELECT seed, node, CAST(hop AS INT) AS hop FROM l UNION ALL SELECT DISTINCT seed, seed, 2 FROM l WHERE {k} >= 2"""


def _hops(spark: SparkSession, d: str, k: int) -> DataFrame:
    g = co_order(spark, d)
    return structure.hops(g.adj, g.nodes, k)


@query("khop_neighbors_2", _hop_sql(2))
def khop_2(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d, 2)


@query("khop_neighbors_3", _hop_sql(3))
def khop_3(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d, 3)


@query("induced_subgraph", f"WITH {F1}, k AS (SELECT node_id FROM g WHERE {sql_uniform(SEED, 'half', 'node_id')} < 0.5) SELECT u, v FROM e WHERE u IN (SELECT node_id FROM k) AND v IN (SELECT node_id FROM k)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return induced(g.edges, g.nodes.where(uniform(SEED, "half", "node_id") < 0.5))


@query("adjacency_matrix", f"WITH {F2} SELECT node AS i, nbr AS j, 1.0::DOUBLE AS w FROM a")
def adjacency_matrix(spark: SparkSession, d: str) -> DataFrame:
    return propagate.coo(vector_graph(spark, d).edges)


_COUNTS = "k AS (SELECT label, count(*) AS n FROM g GROUP BY 1)"


@query("class_priors", f"WITH {F1}, {_COUNTS} SELECT label, n, round(n / CAST((SELECT sum(n) FROM k) AS DOUBLE), 9) AS prior FROM k")
def class_priors(spark: SparkSession, d: str) -> DataFrame:
    return relational.class_counts(co_order(spark, d).nodes).select("label", "n", F.round("prior", 9).alias("prior"))


@query("balanced_class_weights", f"WITH {F1}, {_COUNTS} SELECT label, round(CAST((SELECT sum(n) FROM k) AS DOUBLE) / ((SELECT count(*) FROM k) * n), 9) AS balanced_weight, round(CAST((SELECT sum(n) FROM k) AS DOUBLE) / n, 9) AS support_weight FROM k")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return relational.class_counts(co_order(spark, d).nodes).select("label", F.round("balanced_weight", 9).alias("balanced_weight"), F.round("support_weight", 9).alias("support_weight"))


_AGG = f"{F1}, {SPLIT}, c AS (SELECT a.node AS node_id, s.label, count(*) AS cnt FROM a JOIN s ON s.node_id = a.nbr WHERE is_train GROUP BY 1, 2)"


@query("neighbor_label_counts", f"WITH {_AGG} SELECT node_id, label, cnt FROM c")
def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return relational.neighbour_counts(g.adj, _train(g))


def _vectors(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(node_id, label, value) of the nonzero cells of the class vectors."""
    g = co_order(spark, d)
    names = [r[0] for r in g.classes().orderBy("class_idx").select("label").collect()]
    wide = relational.neighbour_vectors(g.nodes, g.adj, _train(g), names, kind)
    long = wide.select("node_id", F.posexplode("agg").alias("pos", "value")).where("value > 0")
    return long.select("node_id", F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("label"), F.round("value", 9).alias("value"))


@query("neighbor_label_vectors", f"WITH {_AGG} SELECT node_id, label, CAST(cnt AS DOUBLE) AS value FROM c")
def neighbour_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, "count")


@query("neighbor_label_proportions", f"WITH {_AGG} SELECT node_id, label, round(cnt / CAST(sum(cnt) OVER (PARTITION BY node_id) AS DOUBLE), 9) AS value FROM c")
def neighbour_shares(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, "prop")


@query("neighbor_label_exists", f"WITH {_AGG} SELECT node_id, label, 1.0::DOUBLE AS value FROM c")
def neighbour_presence(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, "exist")


@query("neighbor_label_directed", """WITH p AS (SELECT p_partkey AS node_id, p_type AS label FROM part),
r AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_linenumber = 1 AND y.l_linenumber = 2 AND x.l_partkey <> y.l_partkey),
k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM p)), n AS (SELECT count(*) AS n FROM k)
SELECT node_id, CAST(i AS INT) AS pos, CAST(count(*) AS DOUBLE) AS value FROM (
SELECT r.dst AS node_id, k.i FROM r JOIN p ON p.node_id = r.src JOIN k ON k.label = p.label UNION ALL
SELECT r.src, k.i + n FROM n, r JOIN p ON p.node_id = r.dst JOIN k ON k.label = p.label) GROUP BY 1, 2""")
def neighbour_directed(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label"))
    names = [r[0] for r in class_index(nodes).orderBy("class_idx").select("label").collect()]
    wide = relational.directed_vectors(nodes, co_order_edges(spark, d), nodes, names)
    return wide.select("node_id", F.posexplode("agg").alias("pos", "value")).where("value > 0")


@query("cond_label_overlay", f"WITH {F1}, {SPLIT}, x AS (SELECT min(label) AS label FROM g) SELECT s.node_id, CASE WHEN is_train THEN s.label ELSE x.label END AS label FROM s, x")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    guess = g.nodes.select("node_id").crossJoin(F.broadcast(g.nodes.agg(F.min("label").alias("label"))))
    return relational.overlay(guess, _train(g))


_WVRN = f"""{F1}, {SPLIT}, l AS (SELECT node_id, label FROM s WHERE is_train), pr AS (SELECT label, count(*) / CAST((SELECT count(*) FROM l) AS DOUBLE) AS prior FROM l GROUP BY 1),
nb AS (SELECT s.node_id, l.label AS vote FROM s JOIN a ON a.node = s.node_id LEFT JOIN l ON l.node_id = a.nbr WHERE NOT is_train),
sc AS (SELECT q.node_id, q.label, round(q.unknown * q.prior + coalesce(v.n, 0), 9) AS score FROM (SELECT node_id, pr.label, prior, sum(CASE WHEN vote IS NULL THEN 1 ELSE 0 END) AS unknown FROM nb, pr GROUP BY 1, 2, 3) q
       LEFT JOIN (SELECT node_id, vote, count(*) AS n FROM nb WHERE vote IS NOT NULL GROUP BY 1, 2) v ON v.node_id = q.node_id AND v.vote = q.label),
wv AS (SELECT node_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1),
y AS (SELECT g.node_id, g.label, wv.pred FROM wv JOIN g ON g.node_id = wv.node_id)"""
_F1_SCORE = "round(2.0 * sum(CASE WHEN label = pred THEN 1 ELSE 0 END) / (2.0 * sum(CASE WHEN label = pred THEN 1 ELSE 0 END) + sum(CASE WHEN label <> pred THEN 1 ELSE 0 END) + sum(CASE WHEN label <> pred AND label IN (SELECT pred FROM y) THEN 1 ELSE 0 END)), 9)"


def _wvrn(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    split = sampling.stratified_split(g.nodes, 0.8, SEED)
    return models.wvrn(g, split.where("is_train"), split.where("not is_train"))


@query("wvrn_predict", f"WITH {_WVRN} SELECT node_id, label, pred FROM y")
def wvrn_predict(spark: SparkSession, d: str) -> DataFrame:
    return _wvrn(spark, d)


@query("micro_f1", f"WITH {_WVRN} SELECT {_F1_SCORE} AS f1 FROM y")
def micro_f1_query(spark: SparkSession, d: str) -> DataFrame:
    return micro_f1(_wvrn(spark, d), []).select(F.round("f1", 9).alias("f1"))


@query("accuracy", f"WITH {_WVRN} SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM y")
def accuracy_query(spark: SparkSession, d: str) -> DataFrame:
    return accuracy(_wvrn(spark, d), []).select(F.round("accuracy", 9).alias("accuracy"))


_ENTROPY = """v AS (SELECT a.node AS node_id, g.label, count(*) AS n FROM a JOIN g ON g.node_id = a.nbr GROUP BY 1, 2),
x AS (SELECT node_id, n / CAST(sum(n) OVER (PARTITION BY node_id) AS DOUBLE) AS p, count(*) OVER (PARTITION BY node_id) AS k FROM v)"""


@query("label_entropy", f"WITH {F1}, {_ENTROPY} SELECT node_id, round(CASE WHEN max(k) <= 1 THEN 0.0 ELSE -sum(p * ln(p)) / ln(max(k)) END, 6) AS entropy FROM x GROUP BY 1")
def label_entropy_query(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    # counted by node and label first: a hub brings a row for each class, not one for each neighbour
    near = g.adj.join(g.nodes.select(F.col("node_id").alias("nbr"), "label"), "nbr").groupBy(F.col("node").alias("node_id"), "label").agg(F.count("*").alias("n"))
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    return near.groupBy("node_id").agg(F.round(F.when(F.count("*") <= 1, 0.0).otherwise(entropy / F.log(F.count("*"))), 6).alias("entropy"))


_MEMBERS = f"""{F1}, {SPLIT}, q AS (SELECT node_id, CAST(node_id % 8 AS INT) AS cluster, CASE WHEN is_train AND {sql_uniform(SEED, 'seen', 'node_id')} < 0.2 THEN label END AS label, label AS co,
    (SELECT min(label) FROM g) AS cc FROM s),
mj AS (SELECT cluster, label FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS r FROM q WHERE label IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    s = sampling.stratified_split(g.nodes, 0.8, SEED)
    seen = F.when(F.col("is_train") & (uniform(SEED, "seen", "node_id") < 0.2), F.col("label"))
    return s.crossJoin(F.broadcast(g.nodes.agg(F.min("label").alias("cc")))).select("node_id", (F.col("node_id") % 8).cast("int").alias("cluster"), seen.alias("label"), F.col("label").alias("co"), "cc")


@query("majority_label", f"WITH {_MEMBERS} SELECT cluster, label FROM mj")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    return relational.majority_labels(_members(spark, d))


_VOTES = """vt AS (SELECT q.cluster, q.node_id, q.label, unnest([mj.label, co, cc]) AS vote FROM q LEFT JOIN mj ON mj.cluster = q.cluster),
vn AS (SELECT cluster, node_id, label, vote, count(*) AS n FROM vt WHERE vote IS NOT NULL GROUP BY 1, 2, 3, 4),
vp AS (SELECT cluster, node_id, label, n / CAST(sum(n) OVER (PARTITION BY node_id) AS DOUBLE) AS p, count(*) OVER (PARTITION BY node_id) AS k FROM vn),
ve AS (SELECT cluster, node_id, CASE WHEN max(label) IS NOT NULL OR max(k) <= 1 THEN 0.0 ELSE -sum(p * ln(p)) / ln(max(k)) END AS e FROM vp GROUP BY 1, 2)"""


@query("cluster_disagreement", f"WITH {_MEMBERS}, {_VOTES} SELECT cluster, round(sum(e), 6) AS score FROM ve GROUP BY 1")
def cluster_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return relational.disagreement(_members(spark, d)).select("cluster", F.round("score", 6).alias("score"))


@query("top_clusters", f"WITH {_MEMBERS}, {_VOTES} SELECT cluster, round(sum(e), 6) AS score FROM ve GROUP BY 1 ORDER BY round(sum(e), 6) DESC, cluster LIMIT 3")
def top_clusters(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_clusters(relational.disagreement(_members(spark, d)).select("cluster", F.round("score", 6).alias("score")), 3)


@query("label_statistics", f"""WITH {F1}, {SPLIT}, l AS (SELECT node_id, label FROM s WHERE is_train), i AS (SELECT * FROM e WHERE u IN (SELECT node_id FROM l) AND v IN (SELECT node_id FROM l)),
k AS (SELECT label, count(*) AS n FROM l GROUP BY 1)
SELECT round(2.0 * (SELECT count(*) FROM i) / (SELECT count(*) FROM l), 6) AS avg_degree, round((SELECT stddev_pop(n / CAST((SELECT count(*) FROM l) AS DOUBLE)) FROM k), 6) AS share_std, round((SELECT stddev_pop(n) FROM k), 6) AS count_std""")
def label_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    out = relational.label_statistics(g.edges, _train(g))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# samplers

_POOL = f"{F1}, {SPLIT}, pool AS (SELECT node_id FROM s WHERE is_train)"
SIZE = 64


def _sample(spark: SparkSession, d: str, name: str, **params) -> DataFrame:
    g = co_order(spark, d)
    pool = scratch.materialise(_train(g).select("node_id"), "pool")
    return sampling.select(name, g, SIZE, pool, SEED, **params).select("node_id", F.col("ord").cast("int").alias("ord"))


def _top(rows: str, order: str) -> str:
    return f"SELECT node_id, CAST(row_number() OVER (ORDER BY {order}, node_id) AS INT) AS ord FROM {rows} ORDER BY {order}, node_id LIMIT {SIZE}"


@query("sample_random", f"WITH {_POOL} {_top('pool', sql_key(SEED, 'rs', 'node_id'))}")
def sample_random(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "rs")


@query("sample_degree", f"WITH {_POOL}, {_DEGREE}, x AS (SELECT d.* FROM d JOIN pool USING (node_id)) {_top('x', 'degree DESC')}")
def sample_degree(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "ns_dc_h")


@query("sample_clustering", f"WITH {_POOL}, {_CLUSTERING}, x AS (SELECT k.node_id, round(clustering, 9) AS c FROM k JOIN pool USING (node_id)) {_top('x', 'c DESC')}")
def sample_clustering(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "ns_ct_h")


@query("sample_edge", f"WITH {_POOL}, ek AS (SELECT u, v, {sql_key(SEED, 'es', 'u', 'v')} AS k FROM e), x AS (SELECT node_id, min(k || ':' || side) AS k FROM (SELECT u AS node_id, k, 0 AS side FROM ek UNION ALL SELECT v, k, 1 FROM ek) JOIN pool USING (node_id) GROUP BY 1) {_top('x', 'k')}")
def sample_edge(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "es_rs")


@query("sample_snowball", f"""WITH RECURSIVE {_POOL}, sd AS (SELECT node_id FROM pool ORDER BY {sql_key(SEED, 'rs', 'node_id')}, node_id LIMIT 1),
w AS (SELECT node_id, 0 AS level FROM sd UNION SELECT a.nbr, level + 1 FROM w JOIN a ON a.node = w.node_id WHERE level < 12), x AS (SELECT node_id, min(level) AS level FROM w JOIN pool USING (node_id) GROUP BY 1) {_top('x', 'level')}""")
def sample_snowball(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "ss")


@query("sample_snowball_seeds", f"""WITH RECURSIVE {_POOL}, sd AS (SELECT node_id FROM pool ORDER BY {sql_key(SEED, 'rs', 'node_id')}, node_id LIMIT 3),
w AS (SELECT node_id, 0 AS level FROM sd UNION SELECT a.nbr, level + 1 FROM w JOIN a ON a.node = w.node_id WHERE level < 12), x AS (SELECT node_id, min(level) AS level FROM w JOIN pool USING (node_id) GROUP BY 1) {_top('x', 'level')}""")
def sample_snowball_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "ss", n_seeds=3)


@query("sample_forest_fire", f"""WITH RECURSIVE {_POOL}, sd AS (SELECT node_id FROM pool ORDER BY {sql_key(SEED, 'rs', 'node_id')}, node_id LIMIT 1), b AS (SELECT node, nbr FROM a WHERE {sql_uniform(SEED, 'ffs0', 'node', 'nbr')} <= 0.7),
w AS (SELECT node_id, 0 AS level FROM sd UNION SELECT b.nbr, level + 1 FROM w JOIN b ON b.node = w.node_id WHERE level < 14), x AS (SELECT node_id, min(level) AS level FROM w JOIN pool USING (node_id) GROUP BY 1) {_top('x', 'level')}""")
def sample_forest_fire(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d, "ffs")


@query("forest_fire_arcs", f"WITH {F1} SELECT node, nbr FROM a WHERE {sql_uniform(SEED, 'ffs0', 'node', 'nbr')} <= 0.7")
def forest_fire_arcs(spark: SparkSession, d: str) -> DataFrame:
    return co_order(spark, d).adj.where(uniform(SEED, "ffs0", "node", "nbr") <= 0.7)


@query("round_robin_draw", f"WITH {F1}, x AS (SELECT node_id, CAST(node_id % 8 AS INT) AS cluster, row_number() OVER (PARTITION BY node_id % 8 ORDER BY {sql_key(SEED, 'rr', 'node_id')}, node_id) AS rd FROM g) {_top('x', 'rd, cluster')}")
def round_robin_draw(spark: SparkSession, d: str) -> DataFrame:
    members = co_order(spark, d).nodes.select("node_id", (F.col("node_id") % 8).cast("int").alias("cluster"))
    return sampling.round_robin(members, SIZE, SEED).select("node_id", F.col("ord").cast("int").alias("ord"))


@query("stratified_split", f"WITH {F1}, {SPLIT} SELECT node_id, label, is_train FROM s")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(co_order(spark, d).nodes, 0.8, SEED)


@query("permutation_split", f"WITH {F1} SELECT node_id, row_number() OVER (ORDER BY {sql_key(SEED, 'permutation', 'node_id')}, node_id) <= 100 AS is_train FROM g")
def permutation_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permutation_split(co_order(spark, d).nodes, 100, SEED)


@query("seed_nodes", f"WITH {_POOL} SELECT * FROM ({_top('pool', sql_key(SEED, 'rs', 'node_id'))}) WHERE ord <= 8")
def seed_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return sampling.seed_nodes(g, _train(g), 8, SEED).select("node_id", F.col("ord").cast("int").alias("ord"))


@query("sampled_neighbors", f"WITH {F1} SELECT node, nbr FROM (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY {sql_key(SEED, 'neighbour', 'node', 'nbr')}, nbr) AS r FROM a) WHERE r <= 5")
def sampled_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return structure.sampled_neighbours(co_order(spark, d).adj, 5, SEED)


@query("node_flags", f"WITH {_POOL} SELECT g.node_id, g.label, CASE WHEN {sql_uniform(SEED, 'half', 'g.node_id')} < 0.5 THEN 1 ELSE 0 END AS is_labeled, CASE WHEN g.node_id IN (SELECT node_id FROM pool) THEN 1 ELSE 0 END AS is_train FROM g")
def node_flags(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return tables.flagged_nodes(g.nodes, g.nodes.where(uniform(SEED, "half", "node_id") < 0.5), _train(g))


# propagation, preparation

_W = """wt AS (SELECT i, j, sum(w) AS w FROM (SELECT node AS i, nbr AS j, 1.0 AS w FROM a UNION ALL SELECT node_id, node_id, 1.0 FROM g) GROUP BY 1, 2),
dg AS (SELECT node, count(*) + 1.0 AS d FROM a GROUP BY 1)"""
_EMB = "x AS (SELECT vec_id AS node_id, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id IN (SELECT node_id FROM g))"


def _long(features: DataFrame, digits: int = 4) -> DataFrame:
    return columns_long(features, "node_id", "features").select("node_id", "pos", F.round("value", digits).alias("value"))


@query("feature_propagation", f"WITH {F2}, {_W}, {_EMB} SELECT i AS node_id, CAST(pos AS INT) AS pos, round(sum(di.d * dj.d * w * w * value), 4) + 0.0 AS value FROM wt JOIN dg di ON di.node = i JOIN dg dj ON dj.node = j JOIN x ON x.node_id = j GROUP BY 1, 2")
def feature_propagation(spark: SparkSession, d: str) -> DataFrame:
    g = written(vector_graph(spark, d))
    return _long(propagate.propagate(g.features, g.edges))


_SYM = "sw AS (SELECT i, j, w / sqrt(di.d * dj.d) AS w FROM wt JOIN dg di ON di.node = i JOIN dg dj ON dj.node = j)"


@query("sgc_propagation", f"WITH {F2}, {_W}, {_EMB}, {_SYM}, h AS (SELECT i AS node_id, pos, sum(w * value) AS value FROM sw JOIN x ON x.node_id = j GROUP BY 1, 2) SELECT i AS node_id, CAST(pos AS INT) AS pos, round(sum(w * value), 4) + 0.0 AS value FROM sw JOIN h ON h.node_id = j GROUP BY 1, 2")
def sgc_propagation(spark: SparkSession, d: str) -> DataFrame:
    g = written(vector_graph(spark, d))
    return _long(propagate.propagate(g.features, g.edges, "sym", 2))


@query("minmax_normalize", "WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, round(CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 0 END, 9) AS c_acctbal FROM customer, m")
def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    return min_max(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 9))


_ALL = "x AS (SELECT vec_id AS node_id, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("features"))
    return columns_long(e, "node_id", "features")


@query("column_sum_normalize", f"WITH {_ALL}, p AS (SELECT pos, sum(abs(value)) AS t FROM x GROUP BY 1) SELECT node_id, CAST(x.pos AS INT) AS pos, round(CASE WHEN t = 0 THEN 0 ELSE abs(value) / t END, 8) AS value FROM x JOIN p ON p.pos = x.pos")
def column_sum_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = _embeddings(spark, d).withColumn("value", F.abs("value"))
    total = x.groupBy("pos").agg(F.sum("value").alias("_t"))
    return x.join(F.broadcast(total), "pos").select("node_id", "pos", F.round(F.when(F.col("_t") == 0, 0.0).otherwise(F.col("value") / F.col("_t")), 8).alias("value"))


@query("feature_statistics", f"WITH {_ALL} SELECT CAST(pos AS INT) AS pos, round(avg(value), 6) AS mean, round(greatest(0, least(stddev_pop(value), avg(value))), 6) AS std FROM x GROUP BY 1")
def feature_statistics(spark: SparkSession, d: str) -> DataFrame:
    mean, std = F.avg("value"), F.stddev_pop("value")
    return _embeddings(spark, d).groupBy("pos").agg(F.round(mean, 6).alias("mean"), F.round(F.greatest(F.lit(0.0), F.least(std, mean)), 6).alias("std"))


@query("percentile_threshold", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.8) FROM part)")
def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return p.crossJoin(F.broadcast(p.agg(F.percentile("p_retailprice", 0.8).alias("_t")))).where("p_retailprice > _t").drop("_t")


@query("null_fill", "SELECT event_id, coalesce(TRY_CAST(props AS DOUBLE), 0.0) AS value, CAST(TRY_CAST(props AS DOUBLE) IS NULL AS INT) AS was_null FROM events")
def null_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.expr("try_cast(props AS double)").alias("value"))
    return e.withColumn("was_null", F.col("value").isNull().cast("int")).fillna(0.0, ["value"])


_CENTRES = "ct AS (SELECT vec_id AS c, embedding AS centre FROM embeddings ORDER BY vec_id LIMIT 10)"


@query("nearest_to_centers", f"WITH {_CENTRES}, dd AS (SELECT c, vec_id AS node_id, round(sqrt(list_sum(list_transform(list_zip(embedding, centre), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS d FROM embeddings, ct) SELECT c, node_id, d FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, node_id) AS r FROM dd) WHERE r <= 3")
def nearest_to_centres(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("features"))
    # ten centres, a stated query set
    centres = e.orderBy("node_id").limit(10).select(F.col("node_id").alias("c"), F.col("features").alias("centre"))
    pairs = e.crossJoin(F.broadcast(centres)).select("c", "node_id", F.round(distance("features", "centre"), 6).alias("d"))

    few = pairs.withColumn("_s", F.pmod(F.xxhash64("node_id"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("c", "_s").orderBy("d", "node_id"))).where("_r <= 3")
    return few.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy("d", "node_id"))).where("_r <= 3").select("c", "node_id", "d")


@query("content_tokenize", r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), x -> x <> '') AS w FROM documents)
SELECT doc_id, w[1] AS first, w[len(w)] AS last, CAST(len(w) AS INT) AS n FROM t WHERE len(w) > 1""".replace("x -> x", "lambda x: x"))
def content_tokenize(spark: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", w.alias("w")).where("size(w) > 1").select("doc_id", F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"), F.size("w").alias("n"))


# experiments and reports


@query("trial_mean_std", f"WITH {TRIALS} SELECT algo, budget, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM t GROUP BY 1, 2")
def trial_mean_std(spark: SparkSession, d: str) -> DataFrame:
    out = experiment.summarise(trials(spark, d).withColumn("seconds", F.lit(0.0)), ["algo", "budget"])
    return out.select("algo", "budget", F.round("f1_mean", 6).alias("f1_mean"), F.round("f1_std", 6).alias("f1_std"))


def _algos(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in trials(spark, d).select("algo").distinct().orderBy("algo").collect()]


@query("budget_pivot", f"WITH {TRIALS}, m AS (SELECT algo, budget, round(avg(f1), 6) AS f FROM t GROUP BY 1, 2) SELECT budget, " + ", ".join(f"max(CASE WHEN algo = '{k}' THEN f END) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM m GROUP BY 1")
def budget_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = experiment.summarise(trials(spark, d).withColumn("seconds", F.lit(0.0)), ["algo", "budget"]).withColumn("f", F.round("f1_mean", 6))
    return experiment.by_budget(out, "f", _algos(spark, d))


@query("last_plot_points", f"WITH {TRIALS} SELECT algo, budget, round(avg(f1), 6) AS f1_mean, 0.0::DOUBLE AS zero_gain FROM t WHERE budget IN (SELECT DISTINCT budget FROM t ORDER BY budget DESC LIMIT 3) GROUP BY 1, 2")
def last_plot_points(spark: SparkSession, d: str) -> DataFrame:
    out = experiment.summarise(trials(spark, d).withColumn("seconds", F.lit(0.0)), ["algo", "budget"])
    return experiment.last_points(out, 3).select("algo", "budget", F.round("f1_mean", 6).alias("f1_mean"), F.lit(0.0).alias("zero_gain"))


_RANKS = f"""{TRIALS}, sc AS (SELECT 'd' || trial AS dataset, 'c' || budget AS classifier, algo, round(avg(f1), 6) AS f1 FROM t GROUP BY 1, 2, 3),
rk AS (SELECT algo, rank() OVER (PARTITION BY dataset, classifier ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY dataset, classifier, f1) - 1) / 2.0 AS r FROM sc)"""


@query("average_rank_table", f"WITH {_RANKS} SELECT algo, round(avg(r), 2) AS rank_mean, round(stddev_samp(r), 2) AS rank_std FROM rk GROUP BY 1")
def average_rank_table(spark: SparkSession, d: str) -> DataFrame:
    scores = trials(spark, d).groupBy(F.concat(F.lit("d"), "trial").alias("dataset"), F.concat(F.lit("c"), "budget").alias("classifier"), "algo").agg(F.round(F.avg("f1"), 6).alias("f1"))
    return experiment.rank_table(scores).select("algo", "rank_mean", "rank_std")


def _sweep(g: RelGraph, budgets: list[int]) -> DataFrame:
    """(budget, f1) of the degree sampler and the neighbour vote; graph and split are written once, a row for each budget."""
    inner = RelGraph(scratch.materialise(g.nodes, "nodes"), scratch.materialise(g.edges, "graph"))
    split = scratch.materialise(sampling.stratified_split(inner.nodes, 0.8, SEED), "split")
    train, test = split.where("is_train"), split.where("not is_train")
    rows = []
    for budget in budgets:
        picks = scratch.materialise(sampling.by_degree(inner, budget, train, SEED), "picks")
        got = micro_f1(scratch.materialise(models.wvrn(inner, picks, test), "votes"), []).select(F.round("f1", 9).alias("f1")).first()
        rows.append((budget, got["f1"] if got else None))
    return inner.nodes.sparkSession.createDataFrame(rows, "budget int, f1 double")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Micro-F1 of the neighbour vote by labelling budget, labels chosen by degree."""
    return _sweep(largest_component(co_order(spark, d)), [32, 64, 96, 128])


_ONE = """l{b} AS (SELECT s.node_id, s.label FROM s JOIN d USING (node_id) WHERE is_train ORDER BY degree DESC, s.node_id LIMIT {b}), pr{b} AS (SELECT label, count(*) / CAST((SELECT count(*) FROM l{b}) AS DOUBLE) AS prior FROM l{b} GROUP BY 1),
nb{b} AS (SELECT s.node_id, l.label AS vote FROM s JOIN a ON a.node = s.node_id LEFT JOIN l{b} l ON l.node_id = a.nbr WHERE NOT is_train),
sc{b} AS (SELECT q.node_id, q.label, round(q.unknown * q.prior + coalesce(v.n, 0), 9) AS score FROM (SELECT node_id, p.label, prior, sum(CASE WHEN vote IS NULL THEN 1 ELSE 0 END) AS unknown FROM nb{b}, pr{b} p GROUP BY 1, 2, 3) q
LEFT JOIN (SELECT node_id, vote, count(*) AS n FROM nb{b} WHERE vote IS NOT NULL GROUP BY 1, 2) v ON v.node_id = q.node_id AND v.vote = q.label),
y{b} AS (SELECT g.label, z.label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, label) AS r FROM sc{b}) z JOIN g ON g.node_id = z.node_id WHERE r = 1)"""


@query("budget_sweep", f"WITH {F1}, {SPLIT}, {_DEGREE}, " + ", ".join(_ONE.format(b=b) for b in (32, 64, 96, 128)) + " " + " UNION ALL ".join(f"SELECT CAST({b} AS INT) AS budget, {_F1_SCORE.replace('FROM y)', f'FROM y{b})')} AS f1 FROM y{b}" for b in (32, 64, 96, 128)))
def budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(co_order(spark, d), [32, 64, 96, 128])


# one round of colours needs no iteration, so SQL can say it

_LN2 = 0.6931471805599453


@query("wl_one_round", f"WITH {F1}, q AS (SELECT node, count(*) AS k FROM a GROUP BY 1), z AS (SELECT ceil(round(count(*) * {_LN2}, 9)) AS z FROM q), sg AS (SELECT node, round(1 + k * {_LN2} / z, 6) AS sig FROM q, z) SELECT node, CAST(dense_rank() OVER (ORDER BY sig) AS INT) AS colour FROM sg")
def wl_one_round(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    members = g.nodes.select(F.lit(0).alias("ego"), F.col("node_id").alias("node"))
    inner = g.adj.select(F.lit(0).alias("ego"), "node", "nbr")
    primes = spark.createDataFrame([(1, _LN2)], "colour int, lp double")
    return structure.one_round(members.withColumn("colour", F.lit(1)), inner, primes).select("node", "colour")


# learned or iterative: no SQL


def _small(spark: SparkSession, d: str) -> tuple[RelGraph, DataFrame, DataFrame]:
    g = written(vector_graph(spark, d))
    split = scratch.materialise(sampling.stratified_split(g.nodes, 0.8, SEED), "split")
    return g, split.where("is_train"), split.where("not is_train")


@query("wl_colours")
def wl_colours(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    edges = scratch.materialise(g.edges, "graph")
    members = scratch.materialise(structure.ego_members(edges, g.nodes, 2), "m")
    return structure.refine_colours(members, scratch.materialise(structure.ego_arcs(edges, members), "i"))


@query("sample_kmeans")
def sample_kmeans(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    return sampling.select("kms", g, SIZE, train, SEED)


@query("sample_featprop")
def sample_featprop(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    return sampling.select("fp", g, 16, train, SEED)


@query("sample_wls_2")
def sample_wls_2(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    return sampling.select("wls_2", g, 16, train, SEED)


@query("sample_wls_3")
def sample_wls_3(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    return sampling.select("wls_3", g, 16, train, SEED)


@query("sample_modularity")
def sample_modularity(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    return sampling.select("ms", g, SIZE, train, SEED, mode="krylov")


@query("modularity_clusters")
def modularity_clusters(spark: SparkSession, d: str) -> DataFrame:
    g, _, _ = _small(spark, d)
    return community.modularity_clusters(g.edges, 0.8 * g.nodes.count() / 8, "krylov")


@query("power_bisection")
def power_bisection(spark: SparkSession, d: str) -> DataFrame:
    return community.power_bisection(co_order(spark, d).edges)


@query("spectral")
def spectral(spark: SparkSession, d: str) -> DataFrame:
    g, _, _ = _small(spark, d)
    return community.thin_spectral_clusters(scratch.materialise(community.thin_kernel(g.features, g.edges), "kernel"), 4)


@query("content_predict")
def content_predict(spark: SparkSession, d: str) -> DataFrame:
    return models.content_only(*_small(spark, d))


@query("ica_predict")
def ica_predict(spark: SparkSession, d: str) -> DataFrame:
    return models.collective(*_small(spark, d))


@query("ica_predict_in_order")
def ica_in_order(spark: SparkSession, d: str) -> DataFrame:
    return models.collective(*_small(spark, d), mode="exact")


@query("sgc_predict")
def sgc_predict(spark: SparkSession, d: str) -> DataFrame:
    return models.simple_convolution(*_small(spark, d))


@query("gsage_predict")
def gsage_predict(spark: SparkSession, d: str) -> DataFrame:
    return models.sampled_means(*_small(spark, d))


@query("alfnet")
def alfnet(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    clusters, _ = community.kmeans_clusters(g.features, 8)
    return models.alfnet(g, train, scratch.materialise(clusters.select("cluster", "node_id"), "clusters"), 16)


@query("betweenness")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return structure.path_centralities(vector_graph(spark, d).edges, pairs=False)[0]


@query("edge_betweenness")
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return structure.path_centralities(vector_graph(spark, d).edges, load=False)[1]


@query("structural_features")
def structural_features(spark: SparkSession, d: str) -> DataFrame:
    return structure.structural_features(vector_graph(spark, d).edges)


@query("inside_betweenness")
def inside_betweenness(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    return structure.inside_betweenness(g.edges, train)


@query("medoids")
def medoids(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    kernel = scratch.materialise(community.thin_kernel(g.features, g.edges), "kernel")
    return community.thin_medoids(kernel, community.thin_spectral_clusters(kernel, 4), train)


@query("principal_components")
def principal(spark: SparkSession, d: str) -> DataFrame:
    return principal_components(vector_graph(spark, d).features, 2)


@query("power_iteration_clusters")
def power_iteration(spark: SparkSession, d: str) -> DataFrame:
    pairs = co_order(spark, d).edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight"))
    return community.power_iteration_clusters(pairs, 4)


@query("power_modularity_clusters")
def power_modularity(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return community.modularity_clusters(g.edges, 0.8 * g.nodes.count() / 4, "krylov")


@query("walks_with_retries")
def walks_with_retries(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return structure.walks_with_retries(g.adj, g.nodes, 4, SEED)


@query("capped_neighborhoods")
def capped_neighborhoods(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return structure.capped_egos(g.edges, g.nodes, 2, 3, SEED)


@query("content_probabilities")
def content_probabilities(spark: SparkSession, d: str) -> DataFrame:
    g, train, _ = _small(spark, d)
    x = g.features.select("node_id", F.col("features").alias("x"))
    model = models.logistic(g.nodes.join(train.select("node_id"), "node_id", "left_semi").join(x, "node_id"), g.classes())
    return models.probabilities(model, x)


@query("random_walks")
def random_walks(spark: SparkSession, d: str) -> DataFrame:
    g = co_order(spark, d)
    return structure.random_walks(g.adj, g.nodes, 4, SEED, self_avoiding=True)


@query("synthetic_graph")
def synthetic_graph(spark: SparkSession, d: str) -> DataFrame:
    g = planted_graph(spark, table(spark, d, "part").count(), seed=SEED)
    return g.nodes
