"""Readers, writers, configuration and reports."""

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import experiment
from quillgraph.plans.synth import planted_graph
from quillgraph.sources import tables

#: Published micro-F1 by setting (rows) and method (columns), and the ranks they give.
METHODS = ["RS", "NS-DC-H", "NS-CT-H", "ES-RS", "FeatProp", "WLS-2", "WLS-3", "SS", "FFS", "KMS", "MS"]
SCORES = """
0.378199 0.424171 0.332701 0.419431 0.388132 0.405213 0.400474 0.298803 0.278156 0.354976 0.361611
0.712322 0.581991 0.716588 0.702844 0.648728 0.733745 0.737602 0.361347 0.425220 0.718483 0.727962
0.758588 0.700552 0.742451 0.715568 0.670169 0.737108 0.748460 0.457079 0.441471 0.758101 0.749000
0.682464 0.656398 0.688152 0.661611 0.663981 0.676303 0.697630 0.356634 0.403149 0.677725 0.669668
0.418511 0.627767 0.361617 0.499396 0.558551 0.495372 0.449497 0.308099 0.276676 0.449253 0.443461
0.765392 0.721932 0.753320 0.741247 0.786318 0.742455 0.760161 0.536877 0.493188 0.754930 0.771429
0.762181 0.812475 0.752918 0.756856 0.800000 0.775742 0.785630 0.412851 0.397802 0.756111 0.765896
0.783501 0.803219 0.764185 0.776660 0.793159 0.773843 0.785111 0.562559 0.467780 0.774245 0.788330
0.813704 0.333333 0.817037 0.848519 0.837407 0.812593 0.810741 0.695926 0.456296 0.813704 0.814444
0.888519 0.896296 0.888519 0.905556 0.900741 0.890000 0.889259 0.872593 0.888889 0.884444 0.879259
0.899083 0.545549 0.899083 0.545549 0.899083 0.899083 0.899083 0.781238 0.427704 0.899083 0.899083
0.867598 0.340110 0.884077 0.856113 0.888896 0.899083 0.857594 0.720681 0.514434 0.899083 0.899083
0.409381 0.479817 0.401217 0.435446 0.409381 0.427840 0.430680 0.424074 0.420188 0.409432 0.408773
0.715112 0.503296 0.734888 0.695538 0.550963 0.690974 0.709533 0.537221 0.472110 0.730781 0.727890
0.523560 0.669704 0.525552 0.592995 0.496082 0.626141 0.610570 0.608615 0.549057 0.518602 0.594904
0.775913 0.767546 0.776318 0.773986 0.744371 0.775355 0.779513 0.672577 0.605269 0.756542 0.769320
"""
RANKS = {"WLS-3": (3.88, 1.96, 1.90), "WLS-2": (4.56, 1.93, 1.87), "MS": (5.00, 2.53, 2.45), "FeatProp": (5.28, 3.31, 3.20), "RS": (5.34, 2.25, 2.18), "ES-RS": (5.41, 2.75, 2.66), "KMS": (5.72, 2.57, 2.49), "NS-DC-H": (5.78, 4.23, 4.10), "NS-CT-H": (5.97, 3.06, 2.96), "SS": (9.19, 2.01, 1.94), "FFS": (9.88, 1.82, 1.76)}


def test_rank_table(spark):
    rows = [(f"d{i // 4}", f"c{i % 4}", m, float(x)) for i, line in enumerate(SCORES.split("\n")[1:-1]) for m, x in zip(METHODS, line.split(), strict=True)]
    got = {r["algo"]: (r["rank_mean"], r["rank_std"], r["rank_std_published"]) for r in experiment.rank_table(spark.createDataFrame(rows, "dataset string, classifier string, algo string, f1 double")).collect()}
    assert {k: pytest.approx(v, abs=0.0051) for k, v in RANKS.items()} == got


def write(path, text):
    path.write_text(text, encoding="latin-1")
    return f"file://{path}"


def test_csv_readers(spark, tmp_path):
    n = write(tmp_path / "n.csv", "a1,x\n7,y\n")
    e = write(tmp_path / "e.csv", "a1,7\n")
    f = write(tmp_path / "f.csv", "a1,1,0.5\n7,0,2\n")
    assert sorted(map(tuple, tables.node_csv(spark, n).collect())) == [("7", "y"), ("a1", "x")]
    assert [tuple(r) for r in tables.edge_csv(spark, e).collect()] == [("a1", "7")]
    assert {r[0]: r[1] for r in tables.feature_csv(spark, f).collect()} == {"a1": [1.0, 0.5], "7": [0.0, 2.0]}


def test_raw_lines(spark, tmp_path):
    content = spark.read.text(write(tmp_path / "c.content", "p1\t0 1 0\tTheory\np2 1 1 1 Systems\n\n"))
    nodes, features = tables.content_lines(content)
    assert sorted(map(tuple, nodes.collect())) == [("p1", "Theory"), ("p2", "Systems")]
    assert {r[0]: r[1] for r in features.collect()} == {"p1": [0, 1, 0], "p2": [1, 1, 1]}
    assert [tuple(r) for r in tables.edge_text(spark, write(tmp_path / "c.cites", "p1 p2\n")).collect()] == [("p1", "p2")]


def test_sparse_tab_files(spark, tmp_path):
    n = write(tmp_path / "n.tab", "NODE\npaper\ncat=1,2:label\tnumeric:w-a:0.0\tnumeric:w-b:0.0\tsummary\n".replace("NODE\npaper\n", "NODE\n") + "12\tlabel=2\tw-b=0.5\tsummary=w-b\n13\tlabel=1\tw-a=1.5\tw-b=2\tsummary=x\n")
    got = {r[0]: (r[1], r[2]) for r in tables.sparse_nodes(spark, n).collect()}
    assert got == {"12": ("2", [0.0, 0.5]), "13": ("1", [1.5, 2.0])}
    e = write(tmp_path / "e.tab", "DIRECTED\nNO_FEATURES\n1\tpaper:12\t|\tpaper:13\n")
    assert [tuple(r) for r in tables.sparse_edges(spark, e).collect()] == [("12", "13")]


def test_user_csv(spark, tmp_path):
    u = write(tmp_path / "u.csv", "user_id,name\n1,caf\xe9\n")
    assert tables.user_csv(spark, u, "user_id long, name string").first()["name"] == "café"


def test_graph_and_trial_files(spark, tmp_path):
    g = planted_graph(spark, 60, seed=1)
    tables.write_graph(g.nodes, g.edges, g.features, f"file://{tmp_path}/g")
    assert tables.node_csv(spark, f"file://{tmp_path}/g/nodes").count() == g.nodes.count()
    assert tables.feature_csv(spark, f"file://{tmp_path}/g/features").select(F.size("features")).first()[0] == 8
    tables.write_dump(g.nodes, g.edges, g.nodes.limit(3), g.nodes, f"file://{tmp_path}/dump")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/dump/nodes").where("is_labeled = 1").count() == 3
    rows = spark.createDataFrame([("d", "c", "a", 0, 32, 0.5, 1.0), ("d", "c", "a", 1, 32, 0.7, 1.0)], experiment.TRIAL)
    path = f"file://{tmp_path}/trials"
    tables.write_trials(rows, path)
    tables.write_trials(rows.where("trial = 1").withColumn("f1", F.lit(0.9)), path)
    back = {r["trial"]: r["f1"] for r in tables.read_trials(spark, path, dataset="d").collect()}
    assert back == {0: 0.5, 1: 0.9}
    wide = experiment.by_budget(experiment.summarise(tables.read_trials(spark, path), ["algo", "budget"]), "f1_mean", ["a"])
    tables.write_wide(wide, f"file://{tmp_path}/wide")
    assert wide.first()["a"] == pytest.approx(0.7)
    assert r"32 & 0.700000 \\" in experiment.latex(wide, "c", "l")


def test_config(spark, tmp_path):
    base, own = write(tmp_path / "b.json", '{"root_dir": "/x", "seed": 3}'), write(tmp_path / "e.json", '{"dataset": "d", "al_budget": 64, "algos": ["rs"]}')
    config = tables.load_config(spark, base, own, seed=9)
    assert (config.seed, config.budgets, config.options) == (9, [32, 64], {"root_dir": "/x"}) and config.experiment_id == "d_5_64_32_8"
    with pytest.raises(ValueError):
        tables.ExperimentConfig(al_budget=100)
    assert tables.dataset_path("/data/", "a.b") == "/data/a/b"


def test_experiment(spark, tmp_path):
    g = planted_graph(spark, 100, classes=2, homophily=0.9, seed=4)
    config = tables.ExperimentConfig(dataset="p", classifier="wvrn", num_trials=1, al_budget=16, budget_step=8, al_batch=4, algos=("ns_dc_h",))
    path = f"file://{tmp_path}/cache"
    got = experiment.run_experiment(g, config, path).orderBy("budget").collect()
    assert [r["budget"] for r in got] == [8, 16] and all(0 <= r["f1"] <= 1 for r in got)
    assert experiment.run_experiment(g, config, path, cached=True).count() == 2
