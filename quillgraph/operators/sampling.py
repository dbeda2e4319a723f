"""Samplers: sampler(graph, size, pool, seed=.., **params) -> (node_id, ord), at most ``size`` rows, ord from 1.

Ties and random orders are settled by hashes and node ids, so a selection depends on the data and
the seed alone.  A pool or graph that runs out gives fewer rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import sort_key, uniform
from ..plans import scratch
from . import metric
from .community import kmeans_clusters, modularity_clusters
from .graph import RelGraph, adjacency, degrees, induced
from .propagate import propagate
from .structure import clustering, ego_arcs, ego_members, refine_colours, refined, same_members

REGISTRY: dict[str, tuple[Callable, dict]] = {}


def sampler(name: str, **params):
    def wrap(f):
        REGISTRY[name] = (f, params)
        return f

    return wrap


def ranked(df: DataFrame, size: int, *order) -> DataFrame:
    """The first ``size`` rows in an order (a top-k, not a sort of everything), numbered."""
    top = df.orderBy(*order, "node_id").limit(size)
    return top.withColumn("ord", F.row_number().over(Window.orderBy(*order, "node_id"))).select("node_id", "ord")


@sampler("rs")
def random_nodes(g: RelGraph, size: int, pool: DataFrame, seed: int = 0) -> DataFrame:
    """Uniform without replacement."""
    return ranked(pool.select("node_id"), size, sort_key(seed, "rs", "node_id"))


@sampler("ns_dc_h")
def by_degree(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, descending: bool = True) -> DataFrame:
    """Highest degree first (in the whole graph)."""
    rows = degrees(g.edges).join(pool.select("node_id"), "node_id", "left_semi")
    return ranked(rows, size, F.desc("degree") if descending else F.asc("degree"))


@sampler("ns_ct_h")
def by_clustering(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, descending: bool = True) -> DataFrame:
    """Highest local clustering first (in the whole graph)."""
    rows = clustering(g.edges).join(pool.select("node_id"), "node_id", "left_semi").withColumn("clustering", F.round("clustering", 9))
    return ranked(rows, size, F.desc("clustering") if descending else F.asc("clustering"))


@sampler("es_rs")
def by_edges(g: RelGraph, size: int, pool: DataFrame, seed: int = 0) -> DataFrame:
    """Edges in random order, each giving its ends that are in the pool and new."""
    keyed = g.edges.select("u", "v", sort_key(seed, "es", "u", "v").alias("k"))
    ends = keyed.select(F.posexplode(F.array("u", "v")).alias("side", "node_id"), "k")
    first = ends.join(pool.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.min(F.struct("k", "side")).alias("at"))
    return ranked(first, size, F.col("at"))


def _spread(g: RelGraph, size: int, pool: DataFrame, seeds: DataFrame, reach: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Breadth-first from seeds over the kept arcs, level by level until there are enough pool nodes or nothing new; pool nodes by (level, id)."""
    adj = reach(adjacency(g.edges))
    seen = scratch.materialise(seeds.select("node_id").withColumn("level", F.lit(0)), "levels")
    inside = pool.select("node_id")
    for level in count(1):
        taken = seen.join(inside, "node_id", "left_semi").count()
        frontier = seen.where(F.col("level") == level - 1)
        step = frontier.join(adj, F.col("node_id") == F.col("node")).select(F.col("nbr").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        if taken >= size:
            break
        grown = scratch.materialise(seen.unionByName(step.withColumn("level", F.lit(level))), "levels")
        more = grown.count() > seen.count()
        scratch.drop(seen)
        seen = grown
        if not more:
            break
    return ranked(seen.join(inside, "node_id", "left_semi"), size, F.col("level"))


def _too_large(g: RelGraph, size: int) -> bool:
    return g.nodes.limit(size).count() < size


@sampler("ss")
def snowball(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, n_seeds: int = 1) -> DataFrame:
    """Breadth-first from random pool seeds; nodes outside the pool are passed through, not taken.  Nothing if the graph is smaller than ``size``."""
    if _too_large(g, size):
        return pool.select("node_id", F.lit(1).alias("ord")).limit(0)
    return _spread(g, size, pool, random_nodes(g, n_seeds, pool, seed), lambda adj: adj)


@sampler("ffs")
def forest_fire(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, p: float = 0.7, attempts: int = 8) -> DataFrame:
    """Breadth-first where each arc burns with probability p; a fire that dies early is lit anew elsewhere, the best attempt counts."""
    if _too_large(g, size):
        return pool.select("node_id", F.lit(1).alias("ord")).limit(0)
    best, most = None, -1
    for attempt in range(attempts):
        burn = lambda adj, a=attempt: adj.where(uniform(seed, f"ffs{a}", "node", "nbr") <= p)
        got = scratch.materialise(_spread(g, size, pool, random_nodes(g, 1, pool, seed + attempt), burn), "fire")
        n = got.count()
        if n > most:
            best, most = got, n
        if n >= size:
            break
    return best


def round_robin(members: DataFrame, size: int, seed: int) -> DataFrame:
    """(node_id, ord): from (cluster, node_id), a random member of each cluster in turn."""
    keyed = members.withColumn("_k", sort_key(seed, "rr", "node_id")).withColumn("_s", F.substring("_k", 1, 2))
    # only the first ``size`` of each share of a cluster can be drawn, so no task ranks a whole cluster
    few = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("cluster", "_s").orderBy("_k", "node_id"))).where(F.col("_r") <= size)
    rounds = few.withColumn("round", F.row_number().over(Window.partitionBy("cluster").orderBy("_k", "node_id")))
    return ranked(rounds, size, F.col("round"), F.col("cluster"))


@sampler("ms", k=8)
def by_modularity(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, k: int = 8, mode: str = "eigenvalue_count") -> DataFrame:
    """Modularity clusters of the graph, drawn from in turn; mode 'power' takes a graph of any size."""
    clusters = modularity_clusters(g.edges, 0.8 * g.nodes.count() / k, mode)
    return round_robin(clusters.join(pool.select("node_id"), "node_id", "left_semi"), size, seed)


@sampler("kms", k=8)
def by_kmeans(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, k: int = 8) -> DataFrame:
    """k-means clusters of the pool's features, drawn from in turn."""
    members, _ = kmeans_clusters(g.features.join(pool.select("node_id"), "node_id", "left_semi"), k)
    return round_robin(members.select("cluster", "node_id"), size, seed)


def nearest_unused(points: DataFrame, centres: list[list[float]], k: int = 8) -> DataFrame:
    """(node_id, ord): for each centre in order the nearest point not yet taken, of equal ones the least id.

    The centres (a labelling budget of them) get their ``k`` nearest points from a metric index.  Proposals
    are settled in the order of the centres; where all of a centre's points are taken, it and those after it
    search again among what is left.  Centres beyond the number of points get none.
    """
    spark = points.sparkSession
    kind = points.schema["node_id"].dataType.simpleString()
    index, queries = metric.build(points), np.array(centres, float).reshape(len(centres), -1)
    taken: dict = {}
    picks, at = [], 0
    while at < len(centres):
        rest = index if not taken else index.without(spark.createDataFrame([(x,) for x in taken], f"node_id {kind}"))
        if not rest.cells:
            break
        for near in metric.nearest(rest, queries[at:], k):
            pick = next((x for _, x in near if x not in taken), None)
            if pick is None and len(near) == k:
                break
            if pick is not None:
                taken[pick] = None
                picks.append((pick, len(picks) + 1))
            at += 1
    return spark.createDataFrame(picks, f"node_id {kind}, ord int")


@sampler("fp")
def by_propagation(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, norm: str = "squared", match_space: str = "raw") -> DataFrame:
    """As many k-means centres of the propagated features as nodes wanted; to each the nearest pool node by raw (or propagated) features."""
    inside = pool.select("node_id")
    moved = scratch.materialise(propagate(g.features, g.edges, norm).join(inside, "node_id", "left_semi"), "propagated")
    _, centres = kmeans_clusters(moved, size)
    points = moved if match_space == "propagated" else g.features.join(inside, "node_id", "left_semi")
    return nearest_unused(points.select("node_id", "features"), centres)


def _colour_picks(edges: DataFrame, pool: DataFrame, draws: DataFrame, nhops: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """((turn, ego, pick), (turn, node)): the node of least colour in each draw's neighbourhood inside the pool, the draw itself if it has none; and who is there.

    ``draws``: (turn, node_id); where a neighbourhood has no edges its pick is the first by a hash of seed plus turn.
    """
    inside = scratch.materialise(induced(edges, pool), "pool-edges")
    drawn = scratch.materialise(draws.select("turn", F.col("node_id").alias("ego")), "draws")
    members = scratch.materialise(ego_members(inside, drawn.select(F.col("ego").alias("node_id")).distinct(), nhops), "ego-nodes")
    # neighbourhoods of the same nodes have the same colours: one of each is refined
    alike = scratch.materialise(same_members(members), "alike")
    firsts = scratch.materialise(members.join(alike.select(F.col("first").alias("ego")).distinct(), "ego", "left_semi"), "ego-firsts")
    inner = scratch.materialise(ego_arcs(inside, firsts), "ego-edges")
    top = refine_colours(firsts, inner).groupBy(F.col("ego").alias("first")).agg(F.min(F.struct("colour", "node"))["node"].alias("first_node"))
    has = alike.join(inner.select(F.col("ego").alias("first")).distinct(), "first", "left_semi").select("ego", F.lit(True).alias("_e"))
    any_key = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("turn")).cast("string"), F.lit("wls"), F.col("ego").cast("string"), F.col("node").cast("string")))
    bare = members.join(has, "ego", "left_anti").join(drawn, "ego").groupBy("turn", "ego").agg(F.min(F.struct(any_key, "node"))["node"].alias("any"))
    least = drawn.join(alike, "ego").join(top, "first").select("turn", "ego", F.col("first_node").alias("first")).join(bare, ["turn", "ego"], "left")
    picked = least.join(has, "ego", "left").select("turn", "ego", F.when(F.col("_e"), F.col("first")).otherwise(F.col("any")).alias("pick"))
    around = members.join(drawn, "ego").select("turn", "node").unionByName(drawn.select("turn", F.col("ego").alias("node"))).distinct()
    return drawn.join(picked, ["turn", "ego"], "left").select("turn", "ego", F.coalesce("pick", "ego").alias("pick")), around


def _draws(left: DataFrame, turns: list[int], seed: int) -> DataFrame:
    """(turn, node_id): the first of ``left`` in the random order of each turn; ``turns`` are a stated set, a minimum for each."""
    each = F.explode(F.array(*[F.lit(t) for t in turns]))
    key = F.md5(F.concat_ws(":", (F.lit(seed * 1000) + F.col("turn")).cast("string"), F.lit("rs"), F.col("node_id").cast("string")))
    return left.select("node_id", each.alias("turn")).groupBy("turn").agg(F.min(F.struct(key.alias("k"), "node_id"))["node_id"].alias("node_id"))


def _colours_in_order(g: RelGraph, size: int, pool: DataFrame, seed: int, nhops: int, most: int = 256) -> DataFrame:
    """(node_id, ord): one draw after the other, each from what the picks before left, by optimistic rounds.

    The draws of many turns are coloured at once on one frozen pool; turns are committed in order up to the
    first whose neighbourhood holds an earlier pick of the round, as nothing else that a turn sees depends
    on what was picked before.  The first always stands, the rest are drawn again; rounds that stand are followed by larger ones.
    """
    left = scratch.materialise(pool.select("node_id"), "pool")
    done, turn, batch = [], 0, 32
    while turn < size:
        turns = list(range(turn, min(size, turn + batch)))
        picks, around = _colour_picks(g.edges, left, _draws(left, turns, seed), nhops, seed)
        picks, around = scratch.materialise(picks, "picks"), scratch.materialise(around, "around")
        earlier = picks.select(F.col("pick").alias("node"), F.col("turn").alias("_before"))
        bad = around.join(earlier, "node").where("_before < turn").agg(F.min("turn")).first()[0]
        kept = picks if bad is None else picks.where(F.col("turn") < bad)
        kept = scratch.materialise(kept.select(F.col("pick").alias("node_id"), (F.col("turn") + 1).alias("ord")), "kept")
        n = kept.count()
        if not n:
            break
        done.append(kept)
        following = scratch.materialise(left.join(kept, "node_id", "left_anti"), "pool")
        scratch.drop(left, picks, around)
        left, turn = following, turn + n
        batch = min(most, 2 * batch) if bad is None else max(8, n)
        if left.isEmpty():
            break
    return scratch.stacked(done) if done else pool.select("node_id", F.lit(1).alias("ord")).limit(0)


#: Edges inside a pool from which its turns are taken in one task, one after the other, and the most that such a task holds
#: (some 80 bytes each); in a pool of fewer edges neighbourhoods are small, in one of more they are spread over tasks.
FEW_EDGES, HELD_EDGES = 1000, 10_000_000


def _colours_in_one_task(inside: DataFrame, size: int, pool: DataFrame, seed: int, k: int, nhops: int) -> DataFrame:
    """As ``by_colour`` in mode 'parallel': a turn sees what the turns before left, so one task that holds the pool's edges takes them all."""
    kind = pool.schema["node_id"].dataType.simpleString()
    rows = inside.select("u", "v").unionByName(pool.select(F.col("node_id").alias("u"), F.lit(None).cast(kind).alias("v")))
    scratch.ship(pool.sparkSession)

    def work(batches):
        import pyarrow as pa

        ends, nodes = [], []
        for batch in batches:
            node = batch.column("v").is_null().to_numpy(zero_copy_only=False)
            nodes.append(batch.column("u").to_numpy(zero_copy_only=False)[node])
            ends.append([batch.column(c).filter(pa.array(~node)).to_numpy(zero_copy_only=False) for c in "uv"])
        if not nodes:
            return
        ids = np.unique(np.concatenate(nodes))
        u, v = (np.concatenate([np.searchsorted(ids, e[i]).astype(np.int32) for e in ends]) for i in (0, 1))
        del ends
        picks = colours_by_turns(ids.tolist(), u, v, size, seed, k, nhops)
        yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(picks, int)], batch.schema.field("u").type), pa.array(np.arange(len(picks), dtype=np.int32) + 1)], names=["node_id", "ord"])

    return scratch.materialise(rows.coalesce(1).mapInArrow(work, f"node_id {kind}, ord int"), "picks")


def colours_by_turns(ids: list, u: np.ndarray, v: np.ndarray, size: int, seed: int, k: int, nhops: int) -> list[int]:
    """Places of the picks in order; u and v are places in ``ids``, which ascend."""
    n, loop = len(ids), u == v
    start, end = np.r_[u, v[~loop]], np.r_[v, u[~loop]]
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    del order, u, v
    left, out, turn = np.ones(n, bool), [], 0
    while len(out) < size:
        key = lambda i: (hashlib.md5(f"{seed * 1000 + turn}:rs:{ids[i]}".encode()).digest(), i)  # noqa: B023
        draws = heapq.nsmallest(k, np.flatnonzero(left).tolist(), key=key)
        if not draws:
            break
        begin = np.searchsorted(start, np.arange(n + 1))
        found, picks = {}, {}
        for draw in draws:
            members = _within(draw, start, end, begin, nhops)
            if members is None:
                picks.setdefault(draw)
                continue
            # neighbourhoods of the same nodes have the same colours
            same = np.packbits(members).tobytes()
            if same not in found:
                found[same] = _least_colour(members, start, end)
            picks.setdefault(found[same])
        out += picks
        left[list(picks)] = False
        kept = left[start] & left[end]
        start, end, turn = start[kept], end[kept], turn + 1
    return out[:size]


def _within(node: int, start: np.ndarray, end: np.ndarray, begin: np.ndarray, nhops: int) -> np.ndarray | None:
    """Which nodes are within so many hops; None for a node without neighbours."""
    members = np.zeros(len(begin) - 1, bool)
    members[node] = True
    front = np.array([node])
    for _ in range(nhops):
        near = members.copy()
        if (begin[front + 1] - begin[front]).sum() * 4 > len(end):
            near[end[members[start]]] = True
        else:
            for i in front.tolist():
                near[end[begin[i] : begin[i + 1]]] = True
        front = np.flatnonzero(near & ~members)
        members = near
        if not len(front):
            break
    return members if members.sum() > 1 else None


def _least_colour(members: np.ndarray, start: np.ndarray, end: np.ndarray) -> int:
    """The first of the members that have the least refined colour."""
    if not members.all():
        kept = members[start] & members[end]
        start, end = start[kept], end[kept]
    place = (np.cumsum(members) - 1).astype(np.int32)
    colour = refined(np.zeros(int(members.sum()), np.int64), place[start], place[end], 20)
    return int(np.flatnonzero(members)[np.argmin(colour)])


def by_colour(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, k: int = 8, nhops: int = 2, mode: str = "parallel") -> DataFrame:
    """Structural roles: random pool nodes are drawn, each gives the node of least refined colour around it.

    'exact' gives what taking one draw at a time and re-inducing the pool's graph after each pick gives, in a few rounds;
    'parallel' takes ``k`` draws on one frozen pool, keeps different picks, and goes on until there are enough; where a task
    can hold the pool's edges it takes all turns, otherwise a turn is a few jobs.
    """
    if mode == "exact":
        return _colours_in_order(g, size, pool, seed, nhops)
    inside = scratch.materialise(induced(g.edges, pool), "pool-edges")
    if nhops > 1 and FEW_EDGES <= inside.count() <= HELD_EDGES and pool.schema["node_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "string"):
        return _colours_in_one_task(inside, size, pool, seed, k, nhops)
    left, got, n, turn = pool.select("node_id"), None, 0, 0
    while n < size:
        draws = random_nodes(g, k, left, seed * 1000 + turn)
        found, _ = _colour_picks(g.edges, left, draws.select("node_id", F.lit(turn).alias("turn"), "ord"), nhops, seed)
        picks = scratch.materialise(found.join(draws.select(F.col("node_id").alias("ego"), "ord"), "ego").groupBy(F.col("pick").alias("node_id")).agg(F.min("ord").alias("ord")), "picks")
        new = picks.count()
        if not new:
            break
        numbered = picks.select("node_id", (F.col("ord") + F.lit(turn * k)).alias("ord"))
        got = numbered if got is None else got.unionByName(numbered)
        before, left = left, scratch.materialise(left.join(picks, "node_id", "left_anti"), "pool")
        if turn:
            scratch.drop(before)
        n, turn = n + new, turn + 1
    return ranked(got, size, F.col("ord")) if got is not None else pool.select("node_id", F.lit(1).alias("ord")).limit(0)


@sampler("wls_2", k=8)
def by_colour_2(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, k: int = 8, mode: str = "parallel") -> DataFrame:
    return by_colour(g, size, pool, seed, k, 2, mode)


@sampler("wls_3", k=8)
def by_colour_3(g: RelGraph, size: int, pool: DataFrame, seed: int = 0, k: int = 8, mode: str = "parallel") -> DataFrame:
    return by_colour(g, size, pool, seed, k, 3, mode)


def seed_nodes(g: RelGraph, train: DataFrame, k: int, seed: int, attempts: int = 50) -> DataFrame:
    """(node_id, ord): k random training nodes, drawn anew until they have two classes at least; raises if no draw has."""
    for attempt in range(attempts):
        picks = random_nodes(g, k, train, seed + attempt)
        if picks.join(g.nodes, "node_id").agg(F.count_distinct("label")).first()[0] >= 2:
            return picks
    raise ValueError(f"{attempts} draws of {k} training nodes have one class each")


def select(name: str, g: RelGraph, size: int, pool: DataFrame, seed: int, **params) -> DataFrame:
    """Run a registered sampler with its own parameters, overridden by ``params``; neither is changed."""
    f, own = REGISTRY[name]
    return f(g, size, pool, seed=seed, **{**own, **params})


def stratified_split(nodes: DataFrame, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(node_id, label, is_train): within each label the first ``share`` in random order; nearest whole number, at least one."""
    keyed = nodes.select("node_id", "label", sort_key(seed, "split", "node_id").alias("_k")).withColumn("_s", F.substring("_k", 1, 4))
    # ranks within shares of the random order plus the sizes of the shares before: no task ranks a whole class
    shares = keyed.groupBy("label", "_s").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy("label").orderBy("_s")
    n = F.sum("_n").over(Window.partitionBy("label"))
    placed = shares.select("label", "_s", (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"), F.greatest(F.floor(n * share + F.lit(0.5)), F.lit(1)).alias("_cut"))
    ranks = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("label", "_s").orderBy("_k", "node_id")))
    joined = ranks.join(placed, [ranks["label"].eqNullSafe(placed["label"]), ranks["_s"] == placed["_s"]])
    return joined.select("node_id", ranks["label"], (F.col("_before") + F.col("_r") <= F.col("_cut")).alias("is_train"))


def permutation_split(nodes: DataFrame, n_train: int, seed: int = 0) -> DataFrame:
    """(node_id, is_train): the first ``n_train`` in random order."""
    chosen = ranked(nodes.select("node_id"), n_train, sort_key(seed, "permutation", "node_id")).select("node_id", F.lit(True).alias("_t"))
    return nodes.select("node_id").join(chosen, "node_id", "left").select("node_id", F.coalesce("_t", F.lit(False)).alias("is_train"))
