"""Synthetic attributed graphs: planted classes, hashed decisions, any size in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators.graph import RelGraph, build


def planted_classes(spark: SparkSession, n: int, classes: int, balance: float, seed: int) -> DataFrame:
    """(node_id, c): n nodes in classes by hash; ``balance`` above 0 favours the first."""
    u = uniform(seed, "class", "id")
    share = F.pow(u, F.lit(1.0 + balance)) if balance else u
    return spark.range(n).select(F.col("id").alias("node_id"), F.floor(share * classes).cast("int").alias("c"))


def planted_graph(spark: SparkSession, n: int, classes: int = 3, mean_degree: float = 4.0, homophily: float = 0.8, features: int = 8, signal: float = 0.8, balance: float = 0.0, seed: int = 0) -> RelGraph:
    """Nodes with classes, edges of which about a share ``homophily`` join equal classes, and 0/1 features.

    Edge i starts at a random node and ends, with probability ``homophily``, at a random node of
    its class, else of another.  Feature j is on with probability ``signal`` where j mod classes
    is the class, else 1 - signal.  ``balance`` above 0 favours the first classes.  Growth by
    preferential attachment is sequential and not reproduced; isolates drop out.
    """
    u = lambda purpose, *c: uniform(seed, purpose, *c)
    base = planted_classes(spark, n, classes, balance, seed)
    # the position of a node in its class, through one count for each class
    keyed = base.withColumn("k", u("place", "node_id"))
    m = int(n * mean_degree / 2)
    arcs = spark.range(m).select("id", F.floor(u("from", "id") * n).cast("long").alias("a"), (u("same", "id") < homophily).alias("same"), u("to", "id").alias("t"))
    bins = max(1, n // (64 * classes))
    slots = keyed.select("node_id", "c", F.floor(F.col("k") * bins).cast("int").alias("bin"), "k")
    started = arcs.join(base.select(F.col("node_id").alias("a"), "c"), "a")
    shift = F.lit(1) + F.floor(u("other", "id") * max(classes - 1, 1)).cast("int")
    wanted = started.select("id", "a", F.when(F.col("same") | F.lit(classes == 1), F.col("c")).otherwise((F.col("c") + shift) % classes).alias("c"), F.floor(F.col("t") * bins).cast("int").alias("bin"), (F.col("t") * bins % 1).alias("rest"))
    # candidates of a class and bin (about 64), the one whose hash with the edge is least
    met = wanted.join(slots, ["c", "bin"]).groupBy("id", "a").agg(F.min_by("node_id", u("pick", "id", "node_id")).alias("b"))
    edges = met.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda j: (u("feature", F.col("node_id"), j) < F.when(j % classes == F.col("c"), F.lit(signal)).otherwise(F.lit(1 - signal))).cast("double"))
    table = base.select("node_id", vector.alias("features"))
    nodes = base.select("node_id", F.concat(F.lit("c"), F.col("c").cast("string")).alias("label"))
    return build(nodes, edges, table)


def parameter_grid(spark: SparkSession, base: dict[str, float], graphs: int, noise: float, seed: int = 0) -> DataFrame:
    """(graph, name, value): each parameter moved by a normal deviate of ``noise`` times itself; shares stay in [0, 1]."""
    rows = spark.createDataFrame([(g, k, float(v)) for g in range(graphs) for k, v in sorted(base.items())], "graph int, name string, value double")
    normal = F.sqrt(-2 * F.log(1 - uniform(seed, "a", "graph", "name"))) * F.cos(2 * F.lit(3.141592653589793) * uniform(seed, "b", "graph", "name"))
    moved = F.col("value") * (1 + noise * normal)
    return rows.select("graph", "name", F.when(F.col("value") <= 1, F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).otherwise(F.greatest(moved, F.lit(0.0))).alias("value"))
