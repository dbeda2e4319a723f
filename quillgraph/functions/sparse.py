"""Sparse vectors: arrays of (pos, value), in order of pos, without zeros; a row is as long as what it has, not as the vocabulary."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..plans import scratch

TYPE = "array<struct<pos:int,value:double>>"


def is_sparse(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and kind.elementType.names == ["pos", "value"]


def from_dense(vector) -> Column:
    """The elements that are neither null nor zero."""
    return F.filter(F.transform(vector, lambda x, i: F.struct(i.alias("pos"), x.cast("double").alias("value"))), lambda e: e["value"] != 0)


def to_dense(vector, width: int) -> Column:
    """An array of ``width`` numbers, for narrow vectors; positions beyond it are left out."""
    at = F.map_from_entries(F.transform(vector, lambda e: F.struct(e["pos"], e["value"])))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(at, i), F.lit(0.0))) if width else F.array().cast("array<double>")


def gathered(long: DataFrame, key: str, name: str = "features") -> DataFrame:
    """(key, vector) from (key, pos, value): values of one position are added up, zeros and nulls left out; keys need a value to have a row."""
    added = long.groupBy(key, "pos").agg(F.sum("value").alias("value")).where("value <> 0")
    return added.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "value"))).alias(name))


def width_of(df: DataFrame, column: str = "features") -> int:
    """One more than the last position of any row; 0 for none."""
    last = df.agg(F.max(F.array_max(F.transform(column, lambda e: e["pos"])))).first()[0]
    return 0 if last is None else last + 1


def ml_vectors(rows: DataFrame, column: str, width: int, name: str = "v") -> DataFrame:
    """``rows`` with sparse vectors of Spark ML; positions beyond ``width`` are left out.

    They are written as the struct that such a vector is stored as and read back as vectors, so no
    Python worker takes part.
    """
    kept = F.filter(F.coalesce(column, F.array().cast(TYPE)), lambda e: e["pos"] < width)
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), F.transform(kept, lambda e: e["pos"]).alias("indices"), F.transform(kept, lambda e: e["value"]).alias("values"))
    written = scratch.materialise(rows.withColumn(name, parts), "vectors")
    schema = StructType([StructField(f.name, VectorUDT() if f.name == name else f.dataType) for f in written.schema])
    return written.sparkSession.read.schema(schema).parquet(scratch.path_of(written))
