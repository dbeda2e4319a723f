"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, dedup, packing, simhash, toxicity
from quillgraph.llm.common import tokenizer_path
from quillgraph.plans import scratch

#: SQL can't express the learned weights, the tokenizer or the packing; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; the others go.

    The model learns from labels of training folds; without such labels every document stays.
    Null texts score like empty ones; rows of equal id are judged one by one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, toxicity.learnable(labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that pairs of similarity 0.8 or more connect, by sets of five-word shingles.

    The Gray-order index of fingerprints finds the pairs, the whole sets verify them.  Rows with a null id stay, as nothing tells which document they are; rows that repeat the
    smallest id all stay.
    """
    groups = simhash.similar_groups(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the strings of 100 bytes or more that start earlier, and n_chars of what is left."""
    return dedup.cut_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is at least 0.8 similar to a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


_tables: list[str] = []


def _tidy(stage):
    """The stage, after deleting the scratch tables of the one before, whose result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, _tables)
        before = set(scratch.live())
        out = stage(spark, docs, sf_dir)
        _tables[:] = [p for p in scratch.live() if p not in before]
        return out

    return run_stage


STAGES = [
    ("toxicity", _tidy(drop_toxic)),
    ("near_duplicates", _tidy(near_duplicates)),
    ("repeated_passages", _tidy(repeated_passages)),
    ("benchmark_leaks", _tidy(benchmark_leaks)),
    ("packing", _tidy(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch.shared_folder(spark)}/quillgraph/pipeline-{spark.sparkContext.applicationId}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{base}-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            scratch.delete(spark, before)
        before = path
    return docs
