"""Budget sweeps over samplers and classifiers, as plain tables."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import micro_f1
from ..functions.vectors import averaged_rank
from ..operators.graph import RelGraph
from ..operators.models import MODELS
from ..operators.sampling import REGISTRY, seed_nodes, select, stratified_split
from ..sources.tables import TRIAL_KEYS, ExperimentConfig, read_trials, write_trials
from . import scratch

TRIAL = "dataset string, classifier string, algo string, trial int, budget int, f1 double, seconds double"


log = logging.getLogger("quillgraph")


def log_to(path: str | None = None) -> logging.Logger:
    """The engine's log goes to a local file of the driver, or to the console."""
    for old in list(log.handlers):
        log.removeHandler(old)
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log


def method(classifier: str, algo: str) -> tuple[Callable, Callable]:
    """(model(graph, train, test), sampler(graph, size, pool, seed)) of two registered names; raises on an unknown one."""
    if classifier not in MODELS or algo not in REGISTRY:
        raise ValueError(f"unknown method {classifier}, {algo}; classifiers: {sorted(MODELS)}, samplers: {sorted(REGISTRY)}")
    return MODELS[classifier], lambda g, size, pool, seed, **params: select(algo, g, size, pool, seed, **params)


def matrix(spark: SparkSession, datasets: list[str], classifiers: list[str], algos: list[str]) -> DataFrame:
    """(dataset, classifier, algo) of every experiment of a batch; the three lists are short."""
    rows = [(d, c, a) for d in datasets for c in classifiers for a in algos]
    return spark.createDataFrame(rows, "dataset string, classifier string, algo string")


def run_matrix(graphs: dict[str, RelGraph], configs: list[ExperimentConfig], cache: str, cached: bool = False, at_once: int = 1, resume: bool = False) -> DataFrame:
    """The trials of several experiments, ``at_once`` of them beside each other; graphs by dataset."""
    if not cached:
        tasks = [(graphs[c.dataset], c, algo, trial, {}) for c in configs for trial in range(c.num_trials) for algo in c.algos]
        run_trials(tasks, cache, at_once, resume)
    out = None
    for config in configs:
        one = run_experiment(graphs[config.dataset], config, cache, True)
        out = one if out is None else out.unionByName(one)
    return out


def run_trial(g: RelGraph, config: ExperimentConfig, classifier: str, algo: str, trial: int, share: float = 0.8, **params) -> DataFrame:
    """(dataset, classifier, algo, trial, budget, f1, seconds) for each budget; seeds are drawn anew for each."""
    model, sample = method(classifier, algo)
    seed = config.seed + trial
    split = scratch.materialise(stratified_split(g.nodes, share, seed), "split")
    train, test = split.where("is_train"), split.where("not is_train")
    rows = []
    for budget in config.budgets:
        seeds = scratch.materialise(seed_nodes(g, train, config.al_batch, seed + budget), "seeds")
        pool = train.join(seeds, "node_id", "left_anti")
        began = time.perf_counter()
        picks = scratch.materialise(sample(g, budget - seeds.count(), pool, seed + budget, **params), "selection")
        seconds = time.perf_counter() - began
        labelled = seeds.select("node_id").unionByName(picks.select("node_id")).distinct()
        f1 = micro_f1(model(g, labelled, test), []).first()
        log.info("%s %s %s trial %d budget %d: f1 %s in %.2f s", config.dataset, classifier, algo, trial, budget, f1["f1"] if f1 else None, seconds)
        rows.append((config.dataset, classifier, algo, trial, budget, f1["f1"] if f1 else None, seconds))
    return g.nodes.sparkSession.createDataFrame(rows, TRIAL)


def trial_name(config: ExperimentConfig, algo: str, trial: int) -> str:
    """Job group and scheduler pool of a trial; ``SparkContext.cancelJobGroup`` of it stops that trial alone."""
    return f"quillgraph-{config.dataset}-{config.classifier}-{algo}-{trial}"


def finished_trials(spark: SparkSession, cache: str) -> set[tuple[str, str, str, int, frozenset[int]]]:
    """(dataset, classifier, algo, trial, budgets) of the folders of a cache; a row for each trial comes to the driver."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return set()
    kept = spark.read.schema(TRIAL).parquet(cache).groupBy(*TRIAL_KEYS).agg(F.collect_set("budget").alias("budgets"))
    return {(r["dataset"], r["classifier"], r["algo"], r["trial"], frozenset(r["budgets"])) for r in kept.collect()}


def run_trials(tasks: list[tuple[RelGraph, ExperimentConfig, str, int, dict]], cache: str, at_once: int = 1, resume: bool = False, attempts: int = 2) -> list[str]:
    """Trials (graph, config, algo, trial, parameters of the sampler), ``at_once`` of them at a time; the names of those that ran.

    Each trial's jobs are a job group and a pool of their own, so with ``spark.scheduler.mode`` FAIR the
    trials share the executors evenly and one can be cancelled without the others.  A trial that fails is
    tried ``attempts`` times, and the others go on; what still failed is raised at the end by name.  A
    trial's folder is written when the trial is through, so with ``resume`` whatever ran before a driver was lost
    is kept, and only the trials are run whose folder is missing or lacks a budget.
    """
    if not tasks:
        return []
    spark = tasks[0][0].nodes.sparkSession
    sc = spark.sparkContext
    if resume:
        done = finished_trials(spark, cache)
        has = lambda c, algo, trial: any((c.dataset, c.classifier, algo, trial) == k[:4] and set(c.budgets) <= k[4] for k in done)
        tasks = [t for t in tasks if not has(t[1], t[2], t[3])]
    writing = threading.Lock()

    def one(task) -> str:
        g, config, algo, trial, params = task
        name = trial_name(config, algo, trial)
        for attempt in range(attempts):
            sc.setJobGroup(name, f"{name}, attempt {attempt + 1}", interruptOnCancel=False)
            sc.setLocalProperty("spark.scheduler.pool", name)
            try:
                rows = run_trial(g, config, config.classifier, algo, trial, **params)
                with writing:
                    write_trials(rows, cache)
                return name
            except Exception as error:
                log.warning("%s, attempt %d: %s", name, attempt + 1, str(error).split("\n")[0])
                if attempt + 1 == attempts:
                    raise
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)
                sc.setLocalProperty("spark.jobGroup.id", None)
        raise ValueError("a trial needs an attempt")

    if at_once == 1:
        outcomes = [_outcome(lambda t=t: one(t)) for t in tasks]
    else:
        with ThreadPoolExecutor(at_once) as threads:
            # each thread has a JVM thread of its own, and so properties of its own
            futures = [threads.submit(inheritable_thread_target(spark)(one), t) for t in tasks]
            outcomes = [_outcome(f.result) for f in futures]
    lost = [(trial_name(t[1], t[2], t[3]), got) for t, got in zip(tasks, outcomes, strict=True) if isinstance(got, Exception)]
    if lost:
        raise RuntimeError(f"{len(lost)} of {len(tasks)} trials failed: {', '.join(name for name, _ in lost)}") from lost[0][1]
    return outcomes


def _outcome(work: Callable):
    try:
        return work()
    except Exception as error:
        return error


def run_experiment(g: RelGraph, config: ExperimentConfig, cache: str, cached: bool = False, at_once: int = 1, resume: bool = False, **params) -> DataFrame:
    """All trials of an experiment, kept at ``cache`` in a folder each; with ``cached`` only those are read."""
    if not cached:
        run_trials([(g, config, algo, trial, params) for trial in range(config.num_trials) for algo in config.algos], cache, at_once, resume)
    return read_trials(g.nodes.sparkSession, cache, dataset=config.dataset, classifier=config.classifier)


def summarise(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of f1 and seconds by keys."""
    return trials.groupBy(*keys).agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.avg("seconds").alias("seconds_mean"), F.stddev_pop("seconds").alias("seconds_std"))


def by_budget(summary: DataFrame, value: str, names: list[str], column: str = "algo") -> DataFrame:
    """A row for each budget and a column for each name."""
    return summary.groupBy("budget").pivot(column, names).agg(F.first(value))


def last_points(summary: DataFrame, n: int) -> DataFrame:
    """Rows of the last n budgets."""
    top = summary.select("budget").distinct().orderBy(F.desc("budget")).limit(n)
    return summary.join(F.broadcast(top), "budget", "left_semi")


def with_errors(means: DataFrame, errors: DataFrame) -> DataFrame:
    """Mean and error tables side by side by budget, with the zero-gain column of plots."""
    return means.join(errors, "budget").withColumn("zero_gain", F.lit(0.0))


def rank_table(scores: DataFrame) -> DataFrame:
    """(algo, rank_mean, rank_std, rank_std_published, final_rank) from (dataset, classifier, algo, f1).

    Methods are ranked in each setting, highest f1 first, ties averaged.  rank_std is the sample
    deviation over the settings; the published one also takes in the rounded mean as a value.
    """
    ranks = scores.withColumn("r", averaged_rank(["dataset", "classifier"], F.desc("f1"), F.col("f1")))
    per = ranks.groupBy("algo").agg(F.round(F.avg("r"), 2).alias("rank_mean"), F.round(F.stddev_samp("r"), 2).alias("rank_std"), F.sum("r").alias("_s"), F.sum(F.col("r") * F.col("r")).alias("_q"), F.count("*").alias("_n"))
    total, n = F.col("_s") + F.col("rank_mean"), F.col("_n") + 1
    spread = F.sqrt((F.col("_q") + F.col("rank_mean") * F.col("rank_mean") - total * total / n) / (n - 1))
    ties = Window.partitionBy("rank_mean")
    final = F.rank().over(Window.partitionBy(F.lit(1)).orderBy("rank_mean")) + (F.count("*").over(ties) - 1) / 2.0
    return per.select("algo", "rank_mean", "rank_std", F.round(spread, 2).alias("rank_std_published"), F.floor(final).cast("int").alias("final_rank"))


def latex(table: DataFrame, caption: str, label: str) -> str:
    """A small report table as LaTeX."""
    rows = [" & ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + r" \\" for r in table.collect()]
    head = " & ".join(c.replace("_", r"\_") for c in table.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"])


def display_name(column: str):
    """Dataset names capitalised, classifier names in capitals."""
    return F.initcap(column) if column == "dataset" else F.upper(column)
