"""Operator 12, Merkle dataset manifest with parent-preimage paths.

Rows are leaves; per group (a source), every 16 consecutive nodes become one parent, until one is
left, and the groups' roots likewise.  A parent is stored as its preimage, the concatenated
digests of its children, under (group, index).  Paths are joined from the top: a parent's path is
its own preimage and the path of its parent, so only the last join touches all leaves.  A leaf
excises its own 64 characters from a preimage for its siblings, and folds by splicing another
digest in there.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import table
from .queries_sql import CRC32_TABLE, crc32_of
from .scans import running

#: Children of a node, and characters of a digest.
FAN_OUT, DIGEST = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage:string,slot:bigint>>"


@dataclass
class Manifest:
    """leaves: (id columns.., part, idx, leaf); above: (part, idx, preimage, path, top) of the leaves' parents; groups: (part, top, path)."""

    leaves: DataFrame
    above: DataFrame
    groups: DataFrame
    root: str | None


def field(value: Column) -> Column:
    """`-` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables (part, idx, preimage, alone), one for each level, of nodes (part, idx, hash) numbered from 0 in each part.

    A lone child of parent 0 is what remains of its part: its row is ``alone`` and its preimage that child's digest.
    """
    tables = []
    while True:
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        # FAN_OUT children at most in each group
        grouped = nodes.groupBy("part", F.shiftright("idx", 4).alias("up")).agg(run.alias("kids"))
        preimage = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        written = scratch.materialise(grouped.select("part", F.col("up").alias("idx"), preimage.alias("preimage"), ((F.col("up") == 0) & (F.size("kids") == 1)).alias("alone")), "level")
        tables.append(written)
        nodes = written.where("not alone").select("part", "idx", F.sha2("preimage", 256).alias("hash"))
        if nodes.isEmpty():
            return tables


def remains(tables: list[DataFrame]) -> DataFrame:
    """(part, top): the digest that remains of each part."""
    out = None
    for t in tables:
        tops = t.where("alone").select("part", F.col("preimage").alias("top"))
        out = tops if out is None else out.unionByName(tops)
    return out


def descend(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(part, idx, preimage, path, top) of the lowest level; ``tops``: (part, top, path) above each part.

    preimage is null where the child is all that remains of its part.
    """
    above = None
    for t in reversed(tables):
        found = t.where("alone").join(tops, "part").select("part", "idx", F.lit(None).cast("string").alias("preimage"), "path", "top")
        if above is not None:
            found = found.unionByName(under(t.where("not alone").select("part", "idx", "preimage"), above))
        above = found
    return above


def under(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes (part, idx, ..) with ``path``, their parents' preimages and their slots in them from below to the root, and ``top``."""
    parents = above.select("part", F.col("idx").alias("_up"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), "top")
    own = F.array(F.struct(F.col("_preimage").alias("preimage"), F.col("idx").bitwiseAND(F.lit(FAN_OUT - 1)).alias("slot")))
    joined = nodes.withColumn("_up", F.shiftright("idx", 4)).join(parents, ["part", "_up"])
    return joined.withColumn("path", F.when(F.col("_preimage").isNull(), F.col("_path")).otherwise(F.concat(own, F.col("_path")))).drop("_up", "_preimage", "_path")


def _before(step: Column) -> Column:
    return F.substring(step["preimage"], F.lit(1), (step["slot"] * DIGEST).cast("int"))


def _after(step: Column) -> Column:
    return F.substring(step["preimage"], ((step["slot"] + 1) * DIGEST + 1).cast("int"), F.lit(FAN_OUT * DIGEST))


def siblings(path: Column) -> Column:
    """The siblings' digests, left to right, level by level: every preimage without the own slot."""
    return F.array_join(F.transform(path, lambda s: F.concat(_before(s), _after(s))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives at this path: it is spliced into each preimage, the digest of which goes into the next."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_before(s), h, _after(s)), 256))


def build(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> Manifest:
    """The manifest of ``leaves``, a written table with a digest in ``leaf``.

    Leaves ascend by ``order`` (nulls first, ties by digest) in each value of ``group``; the groups are
    ordered by their UTF-8 bytes, null first.  A group of any share of the rows is ranked by
    ranges.  Equal rows are leaves each; an empty table has no root.  The columns part, idx,
    rank, path and top must not be among the leaves' own.
    """
    # a null sorts before every string and is a key like any other
    keyed = leaves.withColumn("part", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    ranked = scratch.materialise(running(keyed, ["part"], [*order, leaf]).withColumn("idx", F.col("rank") - 1).drop("rank"), "leaves")
    tables = climb(ranked.select("part", "idx", F.col(leaf).alias("hash")))
    subroots = scratch.materialise(remains(tables), "subroots")
    named = scratch.materialise(running(subroots, [], ["part"]).select(F.col("part").alias("name"), F.lit("").alias("part"), (F.col("rank") - 1).alias("idx"), F.col("top").alias("hash")), "groups")
    over = climb(named.select("part", "idx", "hash"))
    roots = remains(over).limit(1).collect()
    root = roots[0]["top"] if roots else None
    summit = leaves.sparkSession.range(1).select(F.lit("").alias("part"), F.lit(root).cast("string").alias("top"), F.array().cast(_PATH).alias("path"))
    groups = scratch.materialise(under(named.drop("part").withColumn("part", F.lit("")), descend(over, summit)).select(F.col("name").alias("part"), F.col("hash").alias("top"), "path"), "group-paths")
    return Manifest(ranked, descend(tables, groups), groups, root)


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves' own columns with part, idx, path (preimage and slot of each level) and top, the group's root."""
    return under(manifest.leaves, manifest.above)


def documents_manifest(df: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``df``.

    ``tampered``: a boolean; where it is true the root is folded from the row with A-Z lower-cased in its text, and
    verified says whether that still gives the root (a text without A-Z does).  Nulls in any field are
    `-`; empty texts are `0:`; repeated rows are leaves each, with equal leaves and their own proofs;
    rows of one id ascend by leaf; a null id comes first and isn't tampered with; an empty table gives none; other columns are not read.
    """
    # whole texts are read once; digests, ids and groups go on
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col(text), upper, upper.lower())
    values = [F.col(c) for c in fields]
    other = leaf_hash(*[lowered if c == text else F.col(c) for c in fields])
    changed = F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")
    hashed = df.select(F.col(order).alias("id"), F.col(group).alias("in_group"), leaf_hash(*values).alias("leaf"), changed.alias("other"))
    manifest = build(scratch.materialise(hashed, "hashes"), "in_group", ["id"])
    found = proofs(manifest).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    out = found.select(F.col("id").alias(order), "leaf", F.col("top").alias("subroot"), F.lit(manifest.root).cast("string").alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


_FIELDS_SQL = " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS)
_LEAF_SQL = "sha256(" + _FIELDS_SQL.format(**{c: c for c in FIELDS}) + ")"
_OTHER_SQL = "sha256(" + _FIELDS_SQL.format(**{c: c for c in FIELDS} | {"text": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}) + ")"
_UP_SQL = "SELECT l + 1, part, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {0}) WHERE n > 1 GROUP BY l, part, idx // 16"
_PREIMAGES_SQL = "SELECT l, part, idx // 16 AS up, string_agg(h, '' ORDER BY idx) AS p FROM (SELECT *, count(*) OVER (PARTITION BY l, part) AS n FROM {0}) WHERE n > 1 GROUP BY l, part, idx // 16"
_STEPS_SQL = "substr(p, 1, 64 * slot) AS b, substr(p, 64 * slot + 65) AS a"
OP12_SQL = f"""WITH RECURSIVE {CRC32_TABLE},
leaves AS (SELECT doc_id, part, leaf, folded, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS k
  FROM (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS part, {_LEAF_SQL} AS leaf,
    CASE WHEN {crc32_of("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_OTHER_SQL} ELSE {_LEAF_SQL} END AS folded FROM documents, crc_table)),
tree(l, part, idx, h) AS (SELECT 0, part, idx, leaf FROM leaves UNION ALL {_UP_SQL.format("tree")}),
subroots AS (SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS idx FROM (SELECT part, arg_max(h, l) AS h FROM tree GROUP BY part)),
over(l, part, idx, h) AS (SELECT 0, '', idx, h FROM subroots UNION ALL {_UP_SQL.format("over")}),
below AS ({_PREIMAGES_SQL.format("tree")}),
above AS ({_PREIMAGES_SQL.format("over")}),
steps AS (SELECT k, l, {_STEPS_SQL} FROM (SELECT k, l, p, (idx // CAST(16 ** l AS BIGINT)) % 16 AS slot FROM leaves JOIN below ON below.part = leaves.part AND below.up = leaves.idx // CAST(16 ** (l + 1) AS BIGINT))
  UNION ALL SELECT k, 100 + l, {_STEPS_SQL} FROM (SELECT k, l, p, (s.idx // CAST(16 ** l AS BIGINT)) % 16 AS slot FROM leaves JOIN subroots s ON s.part = leaves.part JOIN above ON above.up = s.idx // CAST(16 ** (l + 1) AS BIGINT))),
paths AS (SELECT k, string_agg(b || a, '' ORDER BY l) AS siblings, list({{'b': b, 'a': a}} ORDER BY l) AS path FROM steps GROUP BY k),
folds AS (SELECT doc_id, leaf, s.h AS subroot, (SELECT arg_max(h, l) FROM over) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend({{'b': folded, 'a': ''}}, coalesce(path, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
  FROM leaves JOIN subroots s ON s.part = leaves.part LEFT JOIN paths ON paths.k = leaves.k)
SELECT *, folded_root = root AS verified FROM folds"""
