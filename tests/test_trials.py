"""Trials beside each other: the same table as one after the other, also when one is killed or some are there already."""

import threading
import time

import pytest

from quillgraph.operators.graph import RelGraph
from quillgraph.plans import experiment, scratch
from quillgraph.plans.synth import planted_graph
from quillgraph.sources.tables import ExperimentConfig


@pytest.fixture(scope="module")
def graph(spark):
    g = planted_graph(spark, 100, classes=2, homophily=0.9, seed=4)
    return RelGraph(g.nodes.cache(), g.edges.cache(), g.features.cache())


CONFIG = ExperimentConfig("p", "wvrn", 1, 2, 16, 8, 16, ("rs", "ns_dc_h"))


def tables(df):
    return sorted((r["algo"], r["trial"], r["budget"], r["f1"]) for r in df.collect())


@pytest.fixture(scope="module")
def serial(graph, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('serial')}/trials"
    return tables(experiment.run_experiment(graph, CONFIG, path)), path


def test_beside_each_other(spark, graph, serial, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = experiment.run_experiment(graph, CONFIG, f"file://{tmp_path}/trials", at_once=3)
    assert tables(got) == serial[0] and len(serial[0]) == 4
    assert spark.conf.get(key) == before and not scratch._INSIDE
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_a_killed_trial_is_tried_again(spark, graph, serial, tmp_path, monkeypatch):
    name, kills, original = experiment.trial_name(CONFIG, "rs", 1), [], experiment.stratified_split

    def slow(nodes, share, seed):
        if seed == CONFIG.seed + 1 and not kills:
            kills.append(1)
            threading.Thread(target=lambda: (time.sleep(2), spark.sparkContext.cancelJobGroup(name))).start()
            nodes.sparkSession.sql("SELECT count(*) FROM range(100000000000)").collect()
        return original(nodes, share, seed)

    monkeypatch.setattr(experiment, "stratified_split", slow)
    only = ExperimentConfig("p", "wvrn", 1, 2, 16, 8, 16, ("rs",))
    got = experiment.run_experiment(graph, only, f"file://{tmp_path}/trials", at_once=2)
    assert kills and tables(got) == [r for r in serial[0] if r[0] == "rs"]


def test_what_fails_is_named_and_the_rest_is_kept(spark, graph, serial, tmp_path, monkeypatch):
    original, path = experiment.run_trial, f"file://{tmp_path}/trials"

    def broken(g, config, classifier, algo, trial, **params):
        if (algo, trial) == ("rs", 1):
            raise OSError("lost")
        return original(g, config, classifier, algo, trial, **params)

    monkeypatch.setattr(experiment, "run_trial", broken)
    with pytest.raises(RuntimeError, match="1 of 4 trials failed: quillgraph-p-wvrn-rs-1"):
        experiment.run_experiment(graph, CONFIG, path, at_once=2)
    ran = []
    monkeypatch.setattr(experiment, "run_trial", lambda *a, **k: ran.append((a[3], a[4])) or original(*a, **k))
    got = experiment.run_experiment(graph, CONFIG, path, at_once=2, resume=True)
    assert ran == [("rs", 1)] and tables(got) == serial[0]


def test_resume_of_what_is_whole_runs_nothing(spark, graph, serial):
    tasks = [(graph, CONFIG, algo, trial, {}) for algo in CONFIG.algos for trial in (0, 1)]
    assert experiment.run_trials(tasks, serial[1], 2, resume=True) == []
    # one more budget: the folders lack it
    more = ExperimentConfig("p", "wvrn", 1, 2, 32, 8, 16, ("rs",))
    assert len(experiment.finished_trials(spark, serial[1])) == 4 and experiment.finished_trials(spark, f"{serial[1]}-none") == set()
    assert not any(set(more.budgets) <= k[4] for k in experiment.finished_trials(spark, serial[1]))


def test_nothing_to_run(tmp_path):
    assert experiment.run_trials([], f"file://{tmp_path}") == []
