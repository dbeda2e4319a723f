"""Registered queries that write a format, read it back with the engine's reader, and answer from what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import sql_key
from ..operators.graph import RelGraph, indexed
from ..operators.propagate import propagate
from ..sources import tables
from . import experiment, scratch
from .fixtures import F1, TRIALS, co_order, co_order_edges, table, trials
from .registry import query

KINDS = ("click", "error", "purchase", "signup", "view")


def _written(spark: SparkSession, d: str) -> str:
    """The co-order graph in the prepared format; the path of a dataset called ``parts.ordered``."""
    base = scratch.new_path(spark, "dataset")
    g = co_order(spark, d)
    tables.write_graph(g.nodes, g.edges, g.features, tables.dataset_path(base, "parts.ordered"))
    return base


@query("csv_nodes", f"WITH {F1} SELECT CAST(node_id AS VARCHAR) AS node_id, label FROM g")
def csv_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tables.node_csv(spark, f"{_written(spark, d)}/parts/ordered/nodes")


@query("csv_edges", f"WITH {F1} SELECT CAST(u AS VARCHAR) AS src, CAST(v AS VARCHAR) AS dst FROM e")
def csv_edges(spark: SparkSession, d: str) -> DataFrame:
    return tables.edge_csv(spark, f"{_written(spark, d)}/parts/ordered/edges")


@query("csv_features", f"WITH {F1} SELECT CAST(node_id AS VARCHAR) AS node_id, round(s, 9) AS s, round(p, 9) AS p FROM f")
def csv_features(spark: SparkSession, d: str) -> DataFrame:
    f = tables.feature_csv(spark, f"{_written(spark, d)}/parts/ordered/features")
    return f.select("node_id", F.round(F.col("features")[0], 9).alias("s"), F.round(F.col("features")[1], 9).alias("p"))


@query("load_dataset", f"WITH {F1} SELECT label, count(*) AS nodes, CAST(sum(deg) AS BIGINT) AS ends FROM g JOIN (SELECT node, count(*) AS deg FROM a GROUP BY 1) ON node = node_id GROUP BY 1")
def load_dataset(spark: SparkSession, d: str) -> DataFrame:
    g = tables.load_graph(spark, _written(spark, d), "parts.ordered")
    ends = g.adj.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("deg"))
    return g.nodes.join(ends, "node_id").groupBy("label").agg(F.count("*").alias("nodes"), F.sum("deg").alias("ends"))


@query("indexed_nodes", f"WITH {F1}, c AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS class_idx FROM (SELECT DISTINCT label FROM g)) SELECT CAST(row_number() OVER (ORDER BY node_id) - 1 AS BIGINT) AS idx, node_id, class_idx FROM g JOIN c USING (label)")
def indexed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return indexed(co_order(spark, d))[0]


@query("indexed_edges", f"WITH {F1}, n AS (SELECT CAST(row_number() OVER (ORDER BY node_id) - 1 AS BIGINT) AS idx, node_id FROM g) SELECT x.idx AS u, y.idx AS v FROM e JOIN n x ON x.node_id = u JOIN n y ON y.node_id = v")
def indexed_edges(spark: SparkSession, d: str) -> DataFrame:
    return indexed(co_order(spark, d))[1]


def _raw_content(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    numbers = F.concat_ws("  ", F.col("embedding").cast("array<double>").cast("array<string>"))
    lines = e.select(F.concat(F.lit(" v"), F.col("vec_id").cast("string"), F.lit("\t"), numbers, F.lit(" \t"), F.col("label").cast("string")).alias("value"))
    path = scratch.new_path(spark, "content")
    lines.write.text(path)
    return spark.read.text(path)


@query("raw_content_nodes", "SELECT 'v' || vec_id AS node_id, CAST(label AS VARCHAR) AS label FROM embeddings")
def raw_content_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tables.content_lines(_raw_content(spark, d))[0]


@query("raw_content_features", "SELECT 'v' || vec_id AS node_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def raw_content_features(spark: SparkSession, d: str) -> DataFrame:
    f = tables.content_lines(_raw_content(spark, d))[1]
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return f.select("node_id", F.size("features").cast("long").alias("width"), F.round(total, 6).alias("total"))


@query("raw_cites", "SELECT CAST(x.l_partkey AS VARCHAR) AS src, CAST(y.l_partkey AS VARCHAR) AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_linenumber = 1 AND y.l_linenumber = 2 AND x.l_partkey <> y.l_partkey")
def raw_cites(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "cites")
    co_order_edges(spark, d).select(F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" \t "), F.col("dst").cast("string")).alias("value")).write.text(path)
    return tables.edge_text(spark, path)


@query("sparse_tab_nodes", "SELECT CAST(p_partkey AS VARCHAR) AS node_id, replace(p_type, ' ', '_') AS label, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS size, p_retailprice AS price FROM part")
def sparse_tab_nodes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("w-size="), F.col("p_size").cast("string")))
    rows = part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat(F.lit("label="), F.replace("p_type", F.lit(" "), F.lit("_"))), F.concat(F.lit("w-price="), F.col("p_retailprice").cast("string")), size, F.lit("summary=w-size,w-price")).alias("value"))
    head = spark.createDataFrame([("NODE\tpaper",), ("cat=1,2,3:label\tnumeric:w-size:0.0\tnumeric:w-price:0.0\tsummary",)], "value string").coalesce(1)
    path = scratch.new_path(spark, "tab")
    head.write.text(path)
    rows.write.mode("append").text(path)
    f = tables.sparse_nodes(spark, path)
    return f.select("node_id", "label", F.col("features")[0].alias("size"), F.col("features")[1].alias("price"))


@query("sparse_propagation", f"""WITH {F1}, x AS (SELECT p_partkey AS node_id, unnest(list_distinct(string_split(p_name || ' ' || p_brand, ' '))) AS word FROM part),
d AS (SELECT node, count(*) AS d FROM a GROUP BY 1), arcs AS (SELECT node AS i, nbr AS j FROM a UNION ALL SELECT node_id, node_id FROM g)
SELECT CAST(i AS VARCHAR) AS node_id, word, CAST(sum((1 + di.d) * (1 + dj.d)) AS DOUBLE) AS value FROM arcs JOIN d di ON di.node = i JOIN d dj ON dj.node = j JOIN x ON x.node_id = j GROUP BY 1, 2""")
def sparse_propagation(spark: SparkSession, d: str) -> DataFrame:
    """The words of each part's name and brand as a sparse vector, written as tab files, read back and propagated once."""
    part = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("words"))
    words = part.select(F.explode("words").alias("word")).distinct()
    line = F.concat(F.lit("cat=1:label\t"), F.concat_ws("\t", F.array_sort(F.collect_list(F.concat(F.lit("numeric:"), "word", F.lit(":0.0"))))), F.lit("\tsummary"))
    path = scratch.new_path(spark, "tab")
    # the words of names and brands: a vocabulary, one line
    words.agg(line.alias("value")).write.text(path)
    part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("label=1"), F.concat_ws("\t", F.transform("words", lambda w: F.concat(w, F.lit("=1")))), F.lit("summary=w")).alias("value")).write.mode("append").text(path)
    rows, vocabulary = tables.sparse_content(spark, path)
    g = co_order(spark, d)
    texts = F.col("node_id").cast("string").alias("node_id")
    edges = g.edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))
    x = scratch.materialise(rows.join(g.nodes.select(texts), "node_id", "left_semi").select("node_id", "features"), "sparse")
    out = propagate(x, edges).select("node_id", F.explode("features").alias("e"))
    return out.select("node_id", F.col("e.pos").alias("pos"), F.col("e.value").alias("value")).join(vocabulary, "pos").select("node_id", "word", "value")


@query("sparse_tab_edges", f"WITH {F1} SELECT CAST(u AS VARCHAR) AS src, CAST(v AS VARCHAR) AS dst FROM e")
def sparse_tab_edges(spark: SparkSession, d: str) -> DataFrame:
    head = spark.createDataFrame([("DIRECTED\tcites",), ("NO_FEATURES",)], "value string").coalesce(1)
    lines = co_order(spark, d).edges.select(F.concat(F.lit("1\tpaper:"), F.col("u").cast("string"), F.lit("\t|\tpaper:"), F.col("v").cast("string")).alias("value"))
    path = scratch.new_path(spark, "tab")
    head.union(lines).write.text(path)
    return tables.sparse_edges(spark, path)


@query("latin_csv", "SELECT c_custkey, c_name || 'é' AS c_name, c_acctbal FROM customer")
def latin_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "latin")
    table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("é")).alias("c_name"), "c_acctbal").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.user_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


def _trials(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).groupBy("algo", "trial", "budget").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.max("f1"), 6).alias("seconds"))
    return t.withColumns({"dataset": F.lit("events"), "classifier": F.when(F.col("budget") > 100, F.lit("cc")).otherwise(F.lit("wvrn"))})


_KEPT = f"{TRIALS}, k AS (SELECT algo, trial, budget, CASE WHEN budget > 100 THEN 'cc' ELSE 'wvrn' END AS classifier, round(avg(f1), 6) AS f1, round(max(f1), 6) AS seconds FROM t GROUP BY 1, 2, 3)"


@query("trial_cache", f"WITH {_KEPT} SELECT 'events' AS dataset, classifier, algo, trial, budget, f1, seconds FROM k WHERE classifier = 'cc' AND algo = 'view'")
def trial_cache(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "trials")
    tables.write_trials(_trials(spark, d), path)
    return tables.read_trials(spark, path, classifier="cc", algo="view").select("dataset", "classifier", "algo", "trial", "budget", "f1", "seconds")


@query("stacked_trials", f"WITH {_KEPT} SELECT classifier, algo, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(seconds), 6) AS seconds_mean, round(stddev_pop(seconds), 6) AS seconds_std FROM k GROUP BY 1, 2")
def stacked_trials(spark: SparkSession, d: str) -> DataFrame:
    path, t = scratch.new_path(spark, "trials"), _trials(spark, d)
    for classifier in ("cc", "wvrn"):
        tables.write_trials(t.where(F.col("classifier") == classifier), path)
    out = experiment.summarise(tables.read_trials(spark, path, dataset="events"), ["classifier", "algo"])
    return out.select("classifier", "algo", *[F.round(c, 6).alias(c) for c in ("f1_mean", "f1_std", "seconds_mean", "seconds_std")])


def _wide(value: str) -> str:
    return ", ".join(f"max(CASE WHEN algo = '{k}' THEN {value} END) AS {k}" for k in KINDS)


@query("wide_report", f"WITH {_KEPT}, m AS (SELECT algo, budget, round(avg(f1), 6) AS f FROM k GROUP BY 1, 2) SELECT budget, {_wide('f')} FROM m GROUP BY 1")
def wide_report(spark: SparkSession, d: str) -> DataFrame:
    out = experiment.summarise(_trials(spark, d), ["algo", "budget"]).withColumn("f", F.round("f1_mean", 6))
    path = scratch.new_path(spark, "wide")
    tables.write_wide(experiment.by_budget(out, "f", list(KINDS)), path)
    return spark.read.option("header", True).schema("budget int, " + ", ".join(f"{k} double" for k in KINDS)).csv(path)


@query("timing_report", f"WITH {_KEPT}, m AS (SELECT algo, budget, round(avg(seconds), 6) AS f FROM k GROUP BY 1, 2) SELECT budget, {_wide('f')} FROM m GROUP BY 1")
def timing_report(spark: SparkSession, d: str) -> DataFrame:
    out = experiment.summarise(_trials(spark, d), ["algo", "budget"]).withColumn("f", F.round("seconds_mean", 6))
    return experiment.by_budget(out, "f", list(KINDS))


@query("report_with_errors", f"WITH {_KEPT}, m AS (SELECT budget, round(avg(f1), 6) AS view, round(stddev_pop(f1), 6) AS view_std FROM k WHERE algo = 'view' GROUP BY 1) SELECT budget, view, view_std, 0.0::DOUBLE AS zero_gain FROM m")
def report_with_errors(spark: SparkSession, d: str) -> DataFrame:
    out = experiment.summarise(_trials(spark, d), ["algo", "budget"])
    means = experiment.by_budget(out, "f1_mean", ["view"]).select("budget", F.round("view", 6).alias("view"))
    errors = experiment.by_budget(out, "f1_std", ["view"]).select("budget", F.round("view", 6).alias("view_std"))
    return experiment.with_errors(means, errors)


@query("latex_table", r"""SELECT '\begin{table}' || chr(10) || '\begin{tabular}{ll}' || chr(10) || '\toprule' || chr(10) || 'r\_name & n \\' || chr(10) || '\midrule' || chr(10)
|| (SELECT string_agg(r_name || ' & ' || n || ' \\', chr(10) ORDER BY r_name) FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1))
|| chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' || chr(10) || '\caption{Nations}' || chr(10) || '\label{t}' || chr(10) || '\end{table}' AS latex""")
def latex_table(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(experiment.latex(n.orderBy("r_name"), "Nations", "t"),)], "latex string")


def _config(spark: SparkSession, d: str) -> tables.ExperimentConfig:
    base, own = (scratch.new_path(spark, "config") for _ in range(2))
    spark.createDataFrame([('{"dataset": "cora", "num_trials": 5, "al_budget": 224, "al_batch": 8, "budget_step": 32, "algos": ["rs"]}',)], "value string").coalesce(1).write.text(base)
    spark.createDataFrame([('{"dataset": "parts.ordered", "algos": ["rs", "fp"], "k": 8}',)], "value string").coalesce(1).write.text(own)
    return tables.load_config(spark, base, own, num_trials=3, al_budget=None)


@query("configuration", "SELECT 'parts.ordered' AS dataset, 'parts.ordered_3_224_32_8' AS experiment, 'data/parts/ordered' AS path, 'rs,fp' AS algos, '8' AS k")
def configuration(spark: SparkSession, d: str) -> DataFrame:
    c = _config(spark, d)
    return spark.createDataFrame([(c.dataset, c.experiment_id, tables.dataset_path("data/", c.dataset), ",".join(c.algos), str(c.options["k"]))], "dataset string, experiment string, path string, algos string, k string")


@query("budget_steps", "SELECT CAST(unnest(generate_series(32, 224, 32)) AS INT) AS budget")
def budget_steps(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(b,) for b in _config(spark, d).budgets], "budget int")


@query("experiment_matrix", "SELECT * FROM (VALUES ('cora'), ('citeseer')) d(dataset), (VALUES ('cc'), ('sgc'), ('wvrn')) c(classifier), (VALUES ('rs'), ('fp')) a(algo)")
def experiment_matrix(spark: SparkSession, d: str) -> DataFrame:
    return experiment.matrix(spark, ["cora", "citeseer"], ["cc", "sgc", "wvrn"], ["rs", "fp"])


@query("cached_replay", f"WITH {_KEPT} SELECT classifier, algo, budget, count(*) AS trials FROM k WHERE classifier = 'wvrn' GROUP BY 1, 2, 3")
def cached_replay(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "trials")
    tables.write_trials(_trials(spark, d), path)
    config = tables.ExperimentConfig(dataset="events", classifier="wvrn")
    # with the cache no graph is read
    return experiment.run_experiment(RelGraph(table(spark, d, "region"), table(spark, d, "region")), config, path, cached=True).groupBy("classifier", "algo", "budget").agg(F.count("*").alias("trials"))


@query("display_names", "SELECT DISTINCT upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS dataset, upper(event_type) AS classifier, printf('%s: %05.2f', event_type, 1.5) AS line FROM events")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type").distinct()
    e = e.select(F.col("event_type").alias("dataset"), F.col("event_type").alias("classifier"), F.format_string("%s: %05.2f", "event_type", F.lit(1.5)).alias("line"))
    return e.select(experiment.display_name("dataset").alias("dataset"), experiment.display_name("classifier").alias("classifier"), "line")


@query("head_preview", f"WITH {F1} SELECT node_id, label FROM g ORDER BY {sql_key(7, 'head', 'node_id')} LIMIT 5")
def head_preview(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.rng import sort_key

    return co_order(spark, d).nodes.orderBy(sort_key(7, "head", "node_id")).limit(5)
