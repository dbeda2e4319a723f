"""Graphs as DataFrames: nodes (node_id, label), edges (u <= v, each once), features (node_id, array)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import scratch
from .components import connected_components


@dataclass(frozen=True)
class RelGraph:
    """An attributed undirected simple graph; self-loops stay, nodes without edges don't."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame | None = None

    @property
    def adj(self) -> DataFrame:
        return adjacency(self.edges)

    def classes(self) -> DataFrame:
        return class_index(self.nodes)


def build(nodes: DataFrame, edges: DataFrame, features: DataFrame | None = None) -> RelGraph:
    """Edges with both ends in ``nodes``, made simple; nodes and features without an edge are dropped."""
    simple = undirected(endpoint_filter(edges, nodes))
    kept = drop_isolates(nodes, simple)
    return RelGraph(kept, simple, None if features is None else features.join(kept.select("node_id"), "node_id", "left_semi"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) with u <= v, repeated and reversed rows once, rows with a null end dropped."""
    a, b = edges.columns[:2]
    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr) in both directions, a self-loop once."""
    back = edges.where("u <> v").select(F.col("v").alias("node"), F.col("u").alias("nbr"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("nbr")).unionByName(back)


def endpoint_filter(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both nodes."""
    a, b = edges.columns[:2]
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", a), a, "left_semi").join(ids.withColumnRenamed("node_id", b), b, "left_semi").select(*edges.columns)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return endpoint_filter(edges, nodes)


def end_points(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(end_points(edges), "node_id", "left_semi")


def touching(edges: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is an end of some edge."""
    return rows.join(end_points(edges).withColumnRenamed("node_id", key), key, "left_semi")


def class_index(nodes: DataFrame) -> DataFrame:
    """(label, class_idx): labels in order, from 0; the window is over the distinct labels only."""
    return nodes.select("label").where("label is not null").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("label")) - 1)


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``df`` with a number from 0 in order of ``key``: ranks within ranges of the key plus the sizes of the ranges before."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.materialise(df.repartitionByRange(tasks, key).withColumn("_range", F.spark_partition_id()), "ranges")
    # a row for each range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return ranked.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_r") - 1).alias(name))


def indexed(g: RelGraph) -> tuple[DataFrame, DataFrame]:
    """(idx, node_id, class_idx) in order of the id, and edges (u, v) of such numbers."""
    nodes = dense_index(g.nodes, "node_id").join(F.broadcast(g.classes()), "label", "left").select("idx", "node_id", "class_idx")
    u, v = (nodes.select(F.col("node_id").alias(c), F.col("idx").alias(f"_{c}")) for c in "uv")
    return nodes, g.edges.join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))


def relabelled(nodes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Nodes with labels replaced by a small dictionary; labels that it lacks stay."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return nodes.withColumn("label", F.coalesce(F.get(F.map_values(F.map_filter(pairs, lambda k, _: k == F.col("label"))), F.lit(0)), F.col("label")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree); a self-loop counts two."""
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node reachable."""
    return connected_components(edges.select("u", "v")).select(F.col("node").alias("node_id"), "component")


def largest_component(g: RelGraph) -> RelGraph:
    """The graph restricted to its largest component; of equal ones that with the least node."""
    of = components(g.edges)
    top = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    # one row
    inside = of.join(F.broadcast(top.select("component")), "component", "left_semi").select("node_id")
    return build(g.nodes.join(inside, "node_id", "left_semi"), g.edges, g.features)


def counts(g: RelGraph) -> DataFrame:
    """(nodes, edges, density): one row."""
    n, m = g.nodes.agg(F.count("*").alias("nodes")), g.edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(m).withColumn("density", 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, lu, lv)."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("label").alias("lu"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("label").alias("lv"))
    return edges.join(a, "u").join(b, "v").select("u", "v", "lu", "lv")


def homophily(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_labels(edges, nodes).agg(F.avg((F.col("lu") == F.col("lv")).cast("double")).alias("homophily"))
