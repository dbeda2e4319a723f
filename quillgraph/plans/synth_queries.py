"""Registered queries of grown graphs; they have as many nodes as there are parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import growth
from .fixtures import table
from .registry import query

SEED, CLASSES, HOMOPHILY, BALANCE = 20, 4, 0.75, 0.5
KINDS = ("binomial", "normal", "beta")
WIDTH = 6
_GROWN = f"WITH RECURSIVE {growth.sql_nodes('(SELECT count(*) FROM part)', CLASSES, HOMOPHILY, BALANCE, SEED)}"
_VALUES = ", ".join(f"round({growth.sql_feature(growth.attribute_rules(CLASSES, WIDTH, KINDS, SEED), i, SEED)}, 6) AS f{i}" for i in range(WIDTH))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return growth.grown_nodes(spark, table(spark, d, "part").count(), CLASSES, HOMOPHILY, BALANCE, SEED)


@query("grown_nodes", f"{_GROWN} SELECT node_id, coalesce(parent, -1) AS parent, c FROM grown LEFT JOIN hung USING (node_id)")
def grown_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


@query("grown_features", f"{_GROWN} SELECT node_id, {_VALUES} FROM grown")
def grown_features(spark: SparkSession, d: str) -> DataFrame:
    f = growth.grown_features(_nodes(spark, d), CLASSES, WIDTH, KINDS, SEED)
    return f.select("node_id", *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(WIDTH)])


@query("grown_links")
def grown_links(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    n = nodes.count()
    return growth.grown_links(nodes, n, 3 * n, HOMOPHILY, SEED)
