"""Attributed graphs that grow node by node, made in parallel: every decision is a hash, so a node can be worked out on its own.

The rule, one node after the other: the first ``roots`` nodes draw a class.  Every later node
hangs on a random earlier one and, with probability ``homophily``, takes its class, else it draws
one of the others.  Then links between random nodes of equal (or, else, unequal) classes are added
until there are ``links`` edges.  Features follow a distribution of each class and attribute.

In parallel, a node's class is a function of its parent's class (the same, or what its draw gives
for each class of the parent), and functions of a chain are composed by pointer doubling, so the
rounds are the logarithm of the depth, which itself is logarithmic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import fine, plain_fine, sql_fine
from ..operators.graph import RelGraph, build
from ..sources.tables import write_graph
from . import scratch
from .synth import parameter_grid

#: Nodes whose classes are worked out first and broadcast to the rest: a node behind them is an
#: ancestor of one in ``HEAD`` rows at most, on average, so no join has a hot key.
HEAD = 65_536
#: Draws of a beta variable; each is taken with a chance of a half at least.
TRIES = 64
#: Rows of a rank: ids of one block.
BLOCK = 65_536
#: Range of each kind of parameter after noise; other parameters stay as given.
LIMITS = {"class_balance": (0.05, 0.95), "density": (0.0001, 0.2), "homophily": (0.05, 0.95)}


def class_shares(classes: int, balance: float = 1.0, seed: int = 0) -> list[float]:
    """Probabilities of the classes: normal around 1 / classes with a deviation of (1 - balance) times it, drawn anew while one has over 0.9."""
    spread = max(1 - balance, 1e-3)
    for attempt in range(1000):
        a, b = ([plain_fine(seed, f"share {x}", attempt, c) for c in range(classes)] for x in "ab")
        drawn = [(1 + spread * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)) / classes for u, v in zip(a, b, strict=True)]
        if min(drawn) < 0:
            drawn = [x - min(drawn) + 0.01 for x in drawn]
        drawn = [x / sum(drawn) for x in drawn]
        if max(drawn) <= 0.9 or classes == 1:
            return drawn
    raise ValueError(f"no draw leaves every class below 0.9 (classes {classes}, balance {balance})")


def cuts(shares: list[float], without: int | None = None) -> list[tuple[float, int]]:
    """(upper end, class) of a draw in (0, 1); the last end is 1.  A class alone can't be left out."""
    some = [(c, p) for c, p in enumerate(shares) if c != without or len(shares) == 1]
    total, ends, at = sum(p for _, p in some), [], 0.0
    for c, p in some:
        at += p / total
        ends.append((at, c))
    return [*ends[:-1], (1.0, ends[-1][1])]


def _drawn(u: Column, ends: list[tuple[float, int]]) -> Column:
    out = F.lit(ends[-1][1])
    for upper, c in reversed(ends[:-1]):
        out = F.when(u < upper, F.lit(c)).otherwise(out)
    return out


def _sql_drawn(u: str, ends: list[tuple[float, int]]) -> str:
    return "CASE " + " ".join(f"WHEN {u} < CAST({upper!r} AS DOUBLE) THEN {c}" for upper, c in ends[:-1]) + f" ELSE {ends[-1][1]} END" if len(ends) > 1 else str(ends[0][1])


def _below(u, n) -> Column:
    """A whole number in [0, n) from one in (0, 1)."""
    return F.least(F.floor(u * n), F.lit(n) - 1 if isinstance(n, int) else n - 1).cast("long")


def _resolve(rows: DataFrame, known: DataFrame, start: int) -> DataFrame:
    """(node_id, parent, c) of rows (node_id, parent, ptr, to_class), given the classes of all nodes before ``start`` (``HEAD`` at most)."""
    current = scratch.materialise(rows, "pointers")
    while not current.where(F.col("ptr") >= start).isEmpty():
        above = current.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("_up"), F.col("to_class").alias("_above"))
        # the function of a chain: the upper part's first, then the lower part's
        both = F.transform("_above", lambda c: F.get("to_class", c))
        moved = current.where(F.col("ptr") >= start).join(above, "ptr").select("node_id", "parent", F.col("_up").alias("ptr"), both.alias("to_class"))
        before, current = current, scratch.materialise(current.where(F.col("ptr") < start).unionByName(moved), "pointers")
        scratch.drop(before)
    # HEAD rows at most
    found = current.join(F.broadcast(known.select(F.col("node_id").alias("ptr"), F.col("c").alias("_c"))), "ptr")
    return found.select("node_id", "parent", F.get("to_class", F.col("_c")).alias("c"))


def grown_nodes(spark: SparkSession, n: int, classes: int = 3, homophily: float = 0.8, balance: float = 1.0, seed: int = 0, roots: int = 10, head: int = HEAD) -> DataFrame:
    """(node_id, parent, c) of n nodes; the first ``roots`` have no parent.  No nodes for n of 0; one class is everybody's."""
    shares = class_shares(classes, balance, seed)
    roots, head = min(roots, n), min(max(head, roots), n)
    first = spark.range(roots).select(F.col("id").alias("node_id"), F.lit(None).cast("long").alias("parent"), _drawn(fine(seed, "class", "id"), cuts(shares)).alias("c"))
    ids = spark.range(roots, n).withColumnRenamed("id", "node_id")
    parent = _below(fine(seed, "parent", "node_id"), F.col("node_id"))
    u = fine(seed, "class", "node_id")
    to_class = F.when(fine(seed, "same", "node_id") < homophily, F.array(*[F.lit(c) for c in range(classes)])).otherwise(F.array(*[_drawn(u, cuts(shares, c)) for c in range(classes)]))
    hung = ids.withColumn("parent", parent).select("node_id", "parent", F.col("parent").alias("ptr"), to_class.alias("to_class"))
    known = scratch.materialise(first.unionByName(_resolve(hung.where(F.col("node_id") < head), first, roots)), "head")
    if head == n:
        return known
    return scratch.materialise(known.unionByName(_resolve(hung.where(F.col("node_id") >= head), known, head)), "grown")


def sql_nodes(n: str, classes: int, homophily: float, balance: float, seed: int, roots: int = 10) -> str:
    """The tables ``hung`` and ``grown`` (node_id, c) of a DuckDB WITH RECURSIVE, from a scalar expression for the number of nodes."""
    shares = class_shares(classes, balance, seed)
    others = " ".join(f"WHEN {c} THEN {_sql_drawn('w', cuts(shares, c))}" for c in range(classes))
    u = lambda purpose: sql_fine(seed, purpose, "node_id")
    return f"""ids AS (SELECT unnest(generate_series(0, {n} - 1)) AS node_id),
hung AS (SELECT node_id, least(CAST(floor({u('parent')} * node_id) AS BIGINT), node_id - 1) AS parent, {u('same')} < CAST({homophily!r} AS DOUBLE) AS same, {u('class')} AS w FROM ids WHERE node_id >= {roots}),
firsts AS (SELECT node_id, {u('class')} AS w FROM ids WHERE node_id < {roots}),
grown(node_id, c) AS (SELECT node_id, {_sql_drawn('w', cuts(shares))} FROM firsts
  UNION ALL SELECT hung.node_id, CASE WHEN same THEN c ELSE CASE c {others} END END FROM grown JOIN hung ON hung.parent = grown.node_id)"""


def placed_by_class(nodes: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(node_id, c, pos), pos numbering the nodes by class and id, and (class, first pos, nodes) of each class.

    Ranks are taken in blocks of ids, with the sizes of the blocks before added, so no task ranks a whole class.
    """
    keyed = nodes.select("node_id", "c", F.floor(F.col("node_id") / BLOCK).alias("_s"))
    sizes = keyed.groupBy("c", "_s").agg(F.count("*").alias("_n"))
    # a row for each class
    counts = sorted((r["c"], r["n"]) for r in sizes.groupBy("c").agg(F.sum("_n").alias("n")).collect())
    starts, at = [], 0
    for c, k in counts:
        starts.append((c, at, k))
        at += k
    start = F.element_at(F.create_map(*[F.lit(x) for c, s, _ in starts for x in (c, s)]), F.col("c")) if starts else F.lit(0)
    before = sizes.select("c", "_s", (F.sum("_n").over(Window.partitionBy("c").orderBy("_s")) - F.col("_n")).alias("_before"))
    ranks = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("c", "_s").orderBy("node_id")) - 1)
    return ranks.join(before, ["c", "_s"]).select("node_id", "c", (start + F.col("_before") + F.col("_r")).cast("long").alias("pos")), starts


def grown_links(nodes: DataFrame, n: int, links: int, homophily: float = 0.8, seed: int = 0, most_rounds: int = 30) -> DataFrame:
    """(u, v) with u < v: a link from each node to its parent and links between random nodes, ``links`` in all.

    A round draws as many links as are missing and keeps the new ones; there are fewer than asked for
    only if ``most_rounds`` rounds don't fill them (a class whose pairs are all taken), and more if the
    parents alone are more.  No link joins a node to itself.
    """
    tree = nodes.where("parent is not null").select(F.col("parent").alias("u"), F.col("node_id").alias("v"))
    got = [scratch.materialise(tree, "links")]
    missing = links - got[0].count()
    if missing <= 0 or n < 2:
        return got[0]
    places, starts = placed_by_class(nodes)
    places = scratch.materialise(places, "places")
    spark = nodes.sparkSession
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for row in starts for x in (row[0], row[k])]), F.col("c")).cast("long")
    for turn in range(most_rounds):
        draws = spark.range(missing).select("id", _below(fine(seed, "from", F.lit(turn), "id"), n).alias("node_id"), (fine(seed, "alike", F.lit(turn), "id") < homophily).alias("same"), fine(seed, "to", F.lit(turn), "id").alias("w"))
        drawn = draws.join(places, "node_id").withColumns({"start": of(1), "k": of(2)})
        size = F.when(F.col("same"), F.col("k") - 1).otherwise(F.lit(n) - F.col("k"))
        drawn = drawn.withColumn("size", size).where("size > 0").withColumn("r", _below(F.col("w"), F.col("size")))
        # its class without itself, or all nodes without its class
        alike = F.col("start") + F.col("r") + (F.col("start") + F.col("r") >= F.col("pos")).cast("long")
        unlike = F.col("r") + F.when(F.col("r") >= F.col("start"), F.col("k")).otherwise(F.lit(0))
        ends = drawn.select("node_id", F.when(F.col("same"), alike).otherwise(unlike).alias("pos")).join(places.select(F.col("node_id").alias("other"), "pos"), "pos")
        pairs = ends.select(F.least("node_id", "other").alias("u"), F.greatest("node_id", "other").alias("v")).distinct()
        new = scratch.materialise(pairs.join(scratch.stacked(got), ["u", "v"], "left_anti"), "links")
        got.append(new)
        missing -= new.count()
        if not missing:
            break
    scratch.drop(places)
    return scratch.stacked(got)


def attribute_rules(classes: int, attributes: int, kinds: tuple[str, ...], seed: int) -> list[list[tuple[str, float, float]]]:
    """(kind, first, second parameter) of each class and attribute: binomial (chance, -), normal (mean, deviation), beta (a, b)."""
    unknown = set(kinds) - {"binomial", "normal", "beta"}
    if unknown or not kinds:
        raise ValueError(f"kinds of attributes: binomial, normal and beta, not {sorted(unknown)}")
    out = []
    for c in range(classes):
        row = []
        for i in range(attributes):
            a, b = plain_fine(seed, "first", c, i), plain_fine(seed, "second", c, i)
            kind = kinds[min(int(plain_fine(seed, "kind", c, i) * len(kinds)), len(kinds) - 1)]
            row.append((kind, *{"binomial": (a, 0.0), "normal": (100.0 * i, 20.0), "beta": (a, b)}[kind]))
        out.append(row)
    return out


def grown_features(nodes: DataFrame, classes: int = 3, attributes: int = 10, kinds: tuple[str, ...] = ("binomial",), seed: int = 0) -> DataFrame:
    """(node_id, features): each attribute by its class's distribution, from hashes of node and attribute.

    Normal values are by the cosine of two hashes, beta ones by drawing powers of two hashes until
    their sum is at most 1 (in logarithms, so small parameters don't underflow).
    """
    rules = [(c, [{"kind": k, "a": a, "b": b} for k, a, b in row]) for c, row in enumerate(attribute_rules(classes, attributes, kinds, seed))]
    # a row for each class
    table = nodes.sparkSession.createDataFrame(rules, "c int, rules array<struct<kind string, a double, b double>>")
    h = lambda purpose, *more: fine(seed, purpose, "node_id", *more)

    def beta(p, i, k):
        x, y = F.log(h("x", i, k)) / p["a"], F.log(h("y", i, k)) / p["b"]
        return F.when(F.exp(x) + F.exp(y) <= 1, 1 / (1 + F.exp(F.least(y - x, F.lit(700.0)))))

    def value(p, i):
        normal = p["a"] + p["b"] * F.sqrt(-2 * F.log(h("x", i))) * F.cos(F.lit(2 * math.pi) * h("y", i))
        drawn = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda s, k: F.coalesce(s, beta(p, i, k)))
        return F.when(p["kind"] == "binomial", (h("x", i) < p["a"]).cast("double")).when(p["kind"] == "normal", normal).otherwise(F.coalesce(drawn, F.lit(0.5)))

    return nodes.join(F.broadcast(table), "c").select("node_id", F.transform("rules", value).alias("features"))


def sql_feature(rules: list[list[tuple[str, float, float]]], i: int, seed: int) -> str:
    """DuckDB expression of attribute i from columns node_id and c."""
    h = lambda purpose, *more: sql_fine(seed, purpose, "node_id", str(i), *more)
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    cases = []
    for c, row in enumerate(rules):
        kind, a, b = row[i]
        x, y = f"ln({h('x', 'k')}) / {d(a)}", f"ln({h('y', 'k')}) / {d(b)}" if kind == "beta" else ""
        cases.append(f"WHEN {c} THEN " + {
            "binomial": f"CASE WHEN {h('x')} < {d(a)} THEN 1.0 ELSE 0.0 END",
            "normal": f"{d(a)} + {d(b)} * sqrt(-2 * ln({h('x')})) * cos({d(2 * math.pi)} * {h('y')})",
            "beta": f"(SELECT arg_min(1 / (1 + exp(least({y} - {x}, 700.0))), k) FROM generate_series(0, {TRIES - 1}) s(k) WHERE exp({x}) + exp({y}) <= 1)",
        }[kind])
    return f"CAST(CASE c {' '.join(cases)} END AS DOUBLE)"


def grown_graph(spark: SparkSession, n: int, classes: int = 3, links: int | None = None, homophily: float = 0.8, balance: float = 1.0, attributes: int = 10, kinds: tuple[str, ...] = ("binomial",), seed: int = 0) -> RelGraph:
    """The graph of the rule above; ``links`` is two a node by default; roots that nothing hangs on drop out."""
    nodes = grown_nodes(spark, n, classes, homophily, balance, seed)
    edges = grown_links(nodes, n, 2 * n if links is None else links, homophily, seed)
    labels = nodes.select("node_id", F.concat(F.lit("c"), F.col("c").cast("string")).alias("label"))
    return build(labels, edges, grown_features(nodes, classes, attributes, kinds, seed))


def write_categories(spark: SparkSession, path: str, params: dict[str, float], categories: list[dict[str, float]], graphs: int, noise: float, seed: int = 0, kinds: tuple[str, ...] = ("binomial",)) -> DataFrame:
    """Writes ``graphs`` graphs of each category as datasets ``catNN.graphNN`` under ``path``; returns (category, graph, name, value).

    ``params`` names num_nodes, num_classes, num_attributes, density, homophily and class_balance (missing ones: 1000, 3,
    10, 0.005, 0.8 and 1).  A category overrides some; all of these but num_attributes are moved by noise and put within ``LIMITS``.
    """
    base = {"num_nodes": 1000, "num_classes": 3, "num_attributes": 10, "density": 0.005, "homophily": 0.8, "class_balance": 1.0} | params
    rows = []
    for c, own in enumerate(categories):
        moving = {k: v for k, v in own.items() if k != "num_attributes"}
        # a row for each graph and parameter
        moved = parameter_grid(spark, moving, graphs, noise, seed + c).collect() if moving else []
        for i in range(graphs):
            values = base | own | {r["name"]: r["value"] for r in moved if r["graph"] == i}
            values = {k: min(max(v, LIMITS[k][0]), LIMITS[k][1]) if k in moving and k in LIMITS else v for k, v in values.items()}
            n = int(values["num_nodes"])
            one = grown_graph(spark, n, int(values["num_classes"]), math.ceil(values["density"] * n * (n - 1) / 2), values["homophily"], values["class_balance"], int(values["num_attributes"]), kinds, int(plain_fine(seed, "graph", c, i) * 2**31))
            write_graph(one.nodes, one.edges, one.features, f"{path}/cat{c:02d}/graph{i:02d}")
            rows += [(c, i, k, float(v)) for k, v in sorted(values.items())]
    return spark.createDataFrame(rows, "category int, graph int, name string, value double")
