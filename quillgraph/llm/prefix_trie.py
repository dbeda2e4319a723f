"""Operator 11, the prefix trie of conversations by leaf-peeling message passing.

A node is a distinct sequence of first turns.  Turns are hashed with their position, and running
sums of two 64-bit hashes name each prefix (128 bits; no texts travel).  Nodes hold counters of
children yet to finish; finished ones send the totals of their subtree to their parent, until the
root finishes.  Chains of nodes with one child each are contracted first by pointer doubling, so
rounds follow the branchings, not the turns of the longest conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import fresh, table, tidied
from .queries_sql import CRC32_TABLE, crc32_of
from .scans import running

#: Original turns that a rebuilt conversation can take from another one, and the size of the groups that share one.
MOST_SHARED, GROUP = 5, 100
_ROUNDS = 200


def turns(df: DataFrame, with_text: bool = False) -> DataFrame:
    """(conv_id, rank, digest, chars[, role, text]): turns in order, from 1 in each conversation.

    Null turn numbers come first and ties are in order of the digest of role and text; null roles and
    texts are empty; rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    kept = [role.alias("role"), text.alias("text")] * with_text
    columns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), *kept)
    written = scratch.materialise(columns.where("conv_id is not null"), "turns")
    return running(written, ["conv_id"], ["turn", "digest"]).drop("turn")


def own_lengths(ordered: DataFrame) -> DataFrame:
    """(conv_id, length) of conversations as they are; each has a turn at least."""
    return ordered.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, digest, chars, ..), (conv_id, length)) of rebuilt conversations.

    Conversation c takes the first h = crc32(c) % 6 turns of conversation c - c % 100 (all if it has fewer,
    none if there is no such one), then its own turns after its first h.  Its length can be zero.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    sizes = own_lengths(ordered)
    sources = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("source"), F.col("length").alias("_there"))
    shared = sizes.withColumn("source", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h).join(sources, "source", "left")
    taken = F.least("h", F.coalesce("_there", F.lit(0)))
    convs = scratch.materialise(shared.select("conv_id", "source", "h", taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    rest = [c for c in ordered.columns if c not in ("conv_id", "rank")]
    own = ordered.join(convs.select("conv_id", "h", "taken"), "conv_id").where("rank > h").select("conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("pos"), *rest)
    # a source has MOST_SHARED such turns at most, and GROUP conversations on either side of zero share it
    heads = ordered.where((F.col("conv_id") % GROUP == 0) & (F.col("rank") <= MOST_SHARED)).withColumnRenamed("conv_id", "source")
    copied = heads.join(convs.where("taken > 0").select("conv_id", "source", "taken"), "source").where("rank <= taken").select("conv_id", F.col("rank").alias("pos"), *rest)
    return scratch.materialise(own.unionByName(copied), "rebuilt"), convs.select("conv_id", "length")


def _members(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, chars, p1, p2): each conversation's prefix at each of its turns, with the prefix before it."""
    hashed = rows.select("conv_id", "pos", "chars", F.xxhash64("pos", "digest").alias("t1"), F.xxhash64(F.lit("second"), "digest", "pos").alias("t2"))
    summed = running(hashed, ["conv_id"], ["pos"], ["t1", "t2"])
    return summed.select(F.col("pos").alias("depth"), F.col("t1_through").alias("k1"), F.col("t2_through").alias("k2"), "conv_id", "chars", F.col("t1_before").alias("p1"), F.col("t2_before").alias("p2"))


def _ends(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end.

    SHA-256 is sequential: ids are sorted and joined to texts of a batch in ranges of (node, id), however many end at a node,
    and only these texts stream through one task a node, which holds the state of the hash.
    """
    import hashlib

    import numpy as np

    last = members.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi").select("depth", "k1", "k2", "conv_id")
    empty = lengths.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    scratch.ship(members.sparkSession)
    key = ["depth", "k1", "k2"]
    written = scratch.materialise(last.unionByName(empty), "ends")
    ranged = written.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def join(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c).to_numpy() for c in key]
            start = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[start, n], pa.int32()), pc.cast(batch.column("conv_id"), pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[start]) for c in columns), batch.column("conv_id").take(pa.array(start)), pc.binary_join(ids, ",")], names=[*key, "least", "ids"])

    joined = ranged.mapInArrow(tidied(join), "depth long, k1 long, k2 long, least long, ids string")
    streams = joined.repartition(*key).sortWithinPartitions(*key, "least")

    def digest(batches):
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in [*key, "ids"]), strict=True):
                if node != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i, c in enumerate([*key, "ends_sha256"])})
        if state:
            yield pa.RecordBatch.from_pydict({c: pa.array([v]) for c, v in zip([*key, "ends_sha256"], (*now, state.hexdigest()), strict=True)})

    return streams.mapInArrow(tidied(digest), "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``rows``: (conv_id, pos, digest, chars), positions from 1 without gaps; ``lengths``: (conv_id, length) of all conversations,
    turnless ones too, as written tables.  conv_id is the smallest member; with the depth it names the node.  The root,
    at depth 0, is above all; no conversations give no nodes.  Hot nodes are counted before the
    shuffle; no task holds a node's members or children.
    """
    members = _members(rows)
    key = ["depth", "k1", "k2"]
    one = F.first("p1").alias("p1"), F.first("p2").alias("p2")
    found = members.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), *one)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), none.alias("p1"), none.alias("p2"))
    nodes = scratch.materialise(found.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    # counters of children, on the children's side and on the parent's
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child"))
    counted = nodes.join(children, key, "left").select(*key, "conv_id", "n_convs", "own", "p1", "p2", F.coalesce("n_children", F.lit(0)).alias("n_children"), "child")
    parents = counted.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    tree = scratch.materialise(counted.join(parents, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "tree")
    chains = _chains(tree)
    totals = _peel(tree, chains)
    ends = _ends(members, lengths)
    out = tree.join(totals, ["conv_id", "depth"]).join(ends, key, "left")
    nothing = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _chains(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, to_conv, to_depth, chain) of each node with one child: the first node below that has another number, and the sum of ``own`` above that.

    Pointers double each round, so there are as many rounds as the longest chain has binary digits.
    """
    one = tree.where("n_children = 1").select("conv_id", "depth", F.col("child").alias("to_conv"), (F.col("depth") + 1).alias("to_depth"), F.col("own").alias("chain"))
    current = scratch.materialise(one.withColumn("open", F.lit(True)), "chains")
    for _ in range(_ROUNDS):
        following = current.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("_conv"), F.col("to_depth").alias("_depth"), F.col("chain").alias("_chain"), F.col("open").alias("_open"))
        # pointers that still move lead to different nodes, so no key is hot; those that have arrived are left alone
        moved = current.where("open").join(following, ["to_conv", "to_depth"], "left")
        moved = moved.select("conv_id", "depth", F.coalesce("_conv", "to_conv").alias("to_conv"), F.coalesce("_depth", "to_depth").alias("to_depth"), (F.col("chain") + F.coalesce("_chain", F.lit(0))).alias("chain"), F.coalesce("_open", F.lit(False)).alias("open"))
        before, current = current, scratch.materialise(moved.unionByName(current.where("not open")), "chains")
        scratch.drop(before)
        if current.where("open").isEmpty():
            return current.drop("open")
    raise RuntimeError("a chain of one-child nodes did not end")


def _peel(tree: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of each node: totals of its subtree."""
    node = ["conv_id", "depth"]
    # a contracted node reports to the parent of the head of its chain, which has other children too
    heads = tree.where("depth = 0 or siblings > 1").join(chains, node, "left")
    reports = heads.select(F.coalesce("to_conv", "conv_id").alias("conv_id"), F.coalesce("to_depth", "depth").alias("depth"), F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("up_depth"), F.coalesce("chain", F.lit(0)).alias("chain"))
    work = tree.where("n_children <> 1").join(reports, node).select(*node, "up_conv", "up_depth", "chain", F.col("n_children").alias("waiting"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    state = scratch.materialise(work, "peel")
    done = state.where("waiting = 0")
    finished, waiting = done, state.where("waiting > 0")
    for _ in range(100_000):
        if waiting.isEmpty():
            break
        messages = done.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_leaves"), F.sum(F.col("saved_tokens") + F.col("chain")).alias("_saved"))
        told = waiting.join(messages, node, "left").select(*node, "up_conv", "up_depth", "chain", *[(F.col(c) + F.coalesce(m, F.lit(0)) * sign).alias(c) for c, m, sign in (("waiting", "_n", -1), ("n_leaves", "_leaves", 1), ("saved_tokens", "_saved", 1))])
        state = scratch.materialise(told, "peel")
        done, waiting = state.where("waiting = 0"), state.where("waiting > 0")
        finished = finished.unionByName(done)
    whole = finished.select(*node, "n_leaves", "saved_tokens")
    inner = chains.join(whole.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), "n_leaves", "saved_tokens"), ["to_conv", "to_depth"])
    return whole.unionByName(inner.select(*node, "n_leaves", (F.col("saved_tokens") + F.col("chain")).alias("saved_tokens")))


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of the conversations as they are, of (conv_id, turn, role, text); nulls and ties as in ``turns``."""
    ordered = scratch.materialise(turns(df).withColumnRenamed("rank", "pos"), "ordered-turns")
    return trie(ordered, scratch.materialise(own_lengths(ordered), "lengths"))


def node_texts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` with the ``role`` and ``text`` of their last turn, null at the root; ``rows``: (conv_id, pos, role, text)."""
    role, text, depth = fresh(nodes, "role", "text", "_depth")
    last = rows.select("conv_id", F.col("pos").alias("depth"), F.col("role").alias(role), F.col("text").alias(text))
    return nodes.join(last, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = f"""WITH RECURSIVE {CRC32_TABLE},
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, chars
  FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
convs AS (SELECT s.conv_id, s.conv_id - s.conv_id % 100 AS source, {crc32_of("CAST(s.conv_id AS VARCHAR)")} % 6 AS h FROM sizes s, crc_table),
taken AS (SELECT c.*, least(h, coalesce(s.n, 0)) AS taken FROM convs c LEFT JOIN sizes s ON s.conv_id = c.source),
turned AS (SELECT c.conv_id, o.pos, digest, chars FROM taken c JOIN own o ON o.conv_id = c.source AND o.pos <= c.taken
  UNION ALL SELECT c.conv_id, c.taken + o.pos - c.h, digest, chars FROM taken c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
prefixes AS (SELECT conv_id, pos AS depth, chars, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS prefix,
    pos = count(*) OVER (PARTITION BY conv_id) AS ends FROM turned
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turned) FROM sizes),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY depth, prefix),
ups AS (SELECT n.depth, n.prefix, p.prefix AS up FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM ups GROUP BY ALL),
counted AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.up = n.prefix AND c.depth = n.depth
  LEFT JOIN ups u ON u.prefix = n.prefix AND u.depth = n.depth LEFT JOIN nodes p ON p.prefix = u.up AND p.depth = n.depth - 1),
totals AS (SELECT a.depth, a.prefix, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, CAST(sum(n.own) AS BIGINT) AS saved_tokens FROM counted n JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.prefix)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN totals USING (depth, prefix)"""
