"""Readers and writers of the graph formats."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sparse import TYPE, gathered, to_dense
from ..operators.graph import RelGraph, build, dense_index

NUMBERS = "array<double>"


def node_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Headerless ``name,label``; ids are text, as citation ids mix numbers and words."""
    return spark.read.schema("node_id STRING, label STRING").option("sep", sep).csv(path)


def edge_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.schema("src STRING, dst STRING").option("sep", sep).csv(path)


def feature_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Headerless, first field the id, the others numbers; the width is whatever a line has."""
    fields = F.split("value", sep)
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim(fields[0]).alias("node_id"), F.slice(fields, 2, F.size(fields) - 1).cast(NUMBERS).alias("features"))


def tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines split at white space, without empty ones."""
    return lines.select(F.split(F.trim(column), r"\s+").alias("tokens")).where(F.size("tokens") > 1)


def content_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, features) of raw lines ``id f_0 .. f_n label``."""
    t = tokens(lines, column)
    nodes = t.select(F.element_at("tokens", 1).alias("node_id"), F.element_at("tokens", -1).alias("label"))
    return nodes, t.select(F.element_at("tokens", 1).alias("node_id"), F.slice("tokens", 2, F.size("tokens") - 2).cast(NUMBERS).alias("features"))


def cites_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Edges of white-space separated lines."""
    return tokens(lines, column).select(F.element_at("tokens", 1).alias("src"), F.element_at("tokens", 2).alias("dst"))


def vocabulary(lines: DataFrame) -> DataFrame:
    """(word, pos) of the vocabulary lines of tab files, from (file, value): words in order of file and place, each once.

    Such a line starts with the classes, ``cat=..``; its fields ``kind:word:default`` are words, those with ``=`` and the summary are not.
    """
    fields = lines.where("value LIKE 'cat=%'").select("file", F.posexplode(F.split("value", "\t")).alias("i", "field"))
    words = fields.where(~F.col("field").contains("=") & ~F.col("field").startswith("cat") & ~F.col("field").startswith("summary"))
    named = words.select(F.when(F.col("field").contains(":"), F.split("field", ":")[1]).otherwise(F.col("field")).alias("word"), F.struct("file", "i").alias("at"))
    return dense_index(named.where("word <> ''").groupBy("word").agg(F.min("at").alias("at")), "at", "pos").select("word", F.col("pos").cast("int").alias("pos"))


def sparse_content(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((node_id, label, features), vocabulary) of tab files with lines ``id label=.. word=value.. summary``.

    Features are sparse vectors over the positions of ``vocabulary``.  Lines are told by their form, not by
    their place, so a path may hold many files, each with the header lines or without them.  Words that no
    vocabulary has, and values that are no number, are left out; a line without words has an empty vector.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    words = vocabulary(lines)
    rows = lines.where(F.col("value").rlike("^[^\t]+\tlabel=")).select(F.split("value", "\t").alias("p")).select(F.col("p")[0].alias("node_id"), F.split(F.col("p")[1], "=", 2)[1].alias("label"), F.slice("p", 3, F.size("p")).alias("p"))
    pairs = rows.select("node_id", F.explode("p").alias("x")).where(F.col("x").contains("=") & ~F.col("x").startswith("summary"))
    long = pairs.select("node_id", F.split("x", "=", 2)[0].alias("word"), F.expr("try_cast(split(x, '=', 2)[1] AS double)").alias("value"))
    vectors = gathered(long.join(words, "word"), "node_id")
    return rows.select("node_id", "label").join(vectors, "node_id", "left").select("node_id", "label", F.coalesce("features", F.array().cast(TYPE)).alias("features")), words


def sparse_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, label, features) of tab files as ``sparse_content`` reads them, with whole arrays: for narrow vocabularies."""
    rows, words = sparse_content(spark, path)
    return rows.withColumn("features", to_dense("features", words.count()))


def sparse_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of tab files with two lines to skip and ``kind:id`` in the second and fourth fields."""
    parts = F.split("value", "\t")
    of = lambda i: F.regexp_extract(parts[i], r":(.+)$", 1)
    return spark.read.text(path).where(F.size(parts) >= 4).select(F.trim(of(1)).alias("src"), F.trim(of(3)).alias("dst")).where("src <> '' AND dst <> ''")


def user_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Headered CSV in ISO-8859-1; give a schema in production, else every column is text."""
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1")
    return (reader.schema(schema) if schema else reader).csv(path)


def edge_text(spark: SparkSession, path: str) -> DataFrame:
    return cites_lines(spark.read.text(path))


def write_graph(nodes: DataFrame, edges: DataFrame, features: DataFrame, path: str) -> None:
    """nodes, edges and features as headerless CSV; vectors are joined by commas."""
    nodes.select("node_id", "label").write.mode("overwrite").csv(f"{path}/nodes")
    edges.write.mode("overwrite").csv(f"{path}/edges")
    features.select(F.concat_ws(",", F.col("node_id").cast("string"), F.concat_ws(",", F.col("features").cast("array<string>"))).alias("value")).write.mode("overwrite").text(f"{path}/features")


def load_graph(spark: SparkSession, base: str, source: str) -> RelGraph:
    """The graph of a dataset that ``write_graph`` (or the like) has left under ``dataset_path``; ids are text."""
    path = dataset_path(base, source)
    return build(node_csv(spark, f"{path}/nodes"), edge_csv(spark, f"{path}/edges"), feature_csv(spark, f"{path}/features"))


def write_dump(nodes: DataFrame, edges: DataFrame, labelled: DataFrame, train: DataFrame, path: str) -> None:
    """Edge list, and node, class, is_labeled, is_train."""
    flags = flagged_nodes(nodes, labelled, train)
    edges.write.mode("overwrite").csv(f"{path}/edges")
    flags.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")


def flagged_nodes(nodes: DataFrame, labelled: DataFrame, train: DataFrame) -> DataFrame:
    """(node_id, label, is_labeled, is_train)."""
    a = labelled.select("node_id").distinct().withColumn("_l", F.lit(1))
    b = train.select("node_id").distinct().withColumn("_t", F.lit(1))
    return nodes.join(a, "node_id", "left").join(b, "node_id", "left").select("node_id", "label", F.coalesce("_l", F.lit(0)).alias("is_labeled"), F.coalesce("_t", F.lit(0)).alias("is_train"))


TRIAL_KEYS = ["dataset", "classifier", "algo", "trial"]


def write_trials(trials: DataFrame, path: str) -> None:
    """Trial results, a folder for each dataset, classifier, method and trial; only those in ``trials`` are replaced."""
    trials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TRIAL_KEYS).parquet(path)


def read_trials(spark: SparkSession, path: str, **only) -> DataFrame:
    """Trial results; conditions on the keys prune folders."""
    out = spark.read.parquet(path)
    for k, v in only.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def write_wide(table: DataFrame, path: str) -> None:
    """A pivoted report as one headered CSV file (a row for each budget)."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def dataset_path(base: str, source: str) -> str:
    """Folder of a dataset; dots in its name part folders."""
    return f"{base.rstrip('/')}/{source.replace('.', '/')}"


@dataclass(frozen=True)
class ExperimentConfig:
    """One experiment; budgets are multiples of steps and steps of batches."""

    dataset: str = "cora"
    classifier: str = "cc"
    seed: int = 2162019
    num_trials: int = 5
    al_budget: int = 224
    al_batch: int = 8
    budget_step: int = 32
    algos: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.al_budget % self.budget_step or self.budget_step % self.al_batch:
            raise ValueError("the budget must be a multiple of the step, and the step of the batch")

    @property
    def budgets(self) -> list[int]:
        return list(range(self.budget_step, self.al_budget + 1, self.budget_step))

    @property
    def experiment_id(self) -> str:
        return f"{self.dataset}_{self.num_trials}_{self.al_budget}_{self.budget_step}_{self.al_batch}"


def load_config(spark: SparkSession, base: str, experiment: str, **overrides) -> ExperimentConfig:
    """Base and experiment JSON (read by Spark, so from any store), then overrides; unknown keys go to ``options``."""
    merged: dict = {}
    for path in (base, experiment):
        merged |= json.loads(spark.read.text(path, wholetext=True).first()[0])
    merged |= {k: v for k, v in overrides.items() if v is not None}
    known = {k: merged[k] for k in ExperimentConfig.__dataclass_fields__ if k in merged and k != "options"}
    known["algos"] = tuple(known.get("algos", ()))
    return ExperimentConfig(**known, options={k: v for k, v in merged.items() if k not in known})
