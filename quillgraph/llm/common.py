"""Shared shape of the text operators: two or three columns in, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .text import doc_slices, utf8

#: Bytes of text that a worker holds as arrays at a time.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        for i, j in doc_slices(offsets, limit):
            yield batch.slice(i, j - i)


def map_texts(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers; Spark bounds a batch by bytes, ``slices`` cuts it further."""
    scratch.ship(df.sparkSession)
    return df.mapInArrow(tidied(work), schema)


def tidied(work: Callable) -> Callable:
    """The work; at its end the worker, which waits for other tasks, gives memory that it doesn't use back to the system."""

    def run(batches):
        import ctypes

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns of ``df`` (case ignored)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as long and the text alone, under fixed names; other columns can't clash then."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of one or two numbers a row, to be broadcast if it has at most ``most`` rows; larger ones are joined by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
