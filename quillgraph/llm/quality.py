"""Operator 9, quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a SQL predicate that is true where a document fails.  On a bounded sample every rule
is timed and its rejections are counted; the cascade then tries the rules by rejections per second,
highest first, as one nested CASE, so a later rule is evaluated only on what the earlier ones left.
The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import table

GAP = r"[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """fails: SQL predicate over text, the words, lines and counts of ``statistics``."""

    name: str
    fails: str


#: Production rules; each compares counts, so that the verdict doesn't depend on rounding.
RULES = (
    Rule("too_long", "n_words > 100000"),
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbol_ratio", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > size(_lines)"),
    Rule("stutter", "5 * size(filter(_words, (w, i) -> w = get(_words, i - 1))) > n_words"),
    Rule("few_letters", rf"10 * size(filter(_words, w -> w RLIKE '[A-Za-z\\u0080-\\uFFFF]')) < 7 * n_words"),
    Rule("bullets", r"10 * size(filter(_lines, l -> l RLIKE '^[\\x20\\x09-\\x0D]*[-*]')) > 9 * size(_lines)"),
    Rule("ellipses", r"10 * size(filter(_lines, l -> l RLIKE '[.]{3}[\\x20\\x09-\\x0D]*$')) > 3 * size(_lines)"),
)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """(doc_id, _text, _words, _lines, and the five counts) of each row; a null text has none of anything.

    Repeated windows are found by the 64-bit hashes of all windows of a text, sorted only where
    two are equal; the words they cover are counted in one walk over their positions.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    parts = base.selectExpr("doc_id", "_text", f"filter(split(_text, '{GAP}'), w -> w <> '') AS _words", "filter(split(_text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]') AS _lines")
    counted = parts.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    grams = counted.selectExpr("*", f"CASE WHEN n_words >= {window} THEN transform(sequence(1, size(_words) - {window - 1}), i -> xxhash64(slice(_words, i, {window}))) ELSE cast(array() AS array<bigint>) END AS _grams")
    paired = grams.selectExpr("*", "CASE WHEN size(array_distinct(_grams)) < size(_grams) THEN array_sort(transform(_grams, (g, i) -> struct(g AS g, i AS i))) ELSE cast(array() AS array<struct<g:bigint,i:int>>) END AS _pairs")
    again = paired.selectExpr("*", "array_sort(filter(transform(_pairs, (p, k) -> CASE WHEN p.g <=> get(_pairs, k - 1).g OR p.g <=> get(_pairs, k + 1).g THEN p.i END), i -> i IS NOT NULL)) AS _again")
    covered = f"aggregate(_again, struct(0 AS upto, 0L AS n), (s, i) -> struct(i + {window} AS upto, s.n + i + {window} - greatest(s.upto, i) AS n)).n"
    return again.selectExpr("doc_id", "_text", "_words", "_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", f"CASE WHEN size(_again) > 0 THEN {covered} ELSE 0L END AS n_repeat_words")


def estimate(sample: DataFrame, rules: tuple[Rule, ...], repeat: int = 8) -> list[Rule]:
    """The rules in order of rejections per second on ``sample`` (a small written table of rows that the base lets through).

    A rule's cost is its time over the sample ``repeat`` times, less that of a constant, so that
    the rows outweigh the start of a job.  What a rule rejects is counted among the rows that the
    rules before it leave.
    """
    rows = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

    def seconds(column: Column) -> float:
        began = time.perf_counter()
        rows.agg(F.sum(F.when(column, 1).otherwise(0)).alias("n")).first()
        return time.perf_counter() - began

    idle = min(seconds(F.col("n_words") < 0) for _ in range(2))
    cost = {r.name: max(seconds(F.expr(r.fails)) - idle, 1e-4) for r in rules}
    # one row for each combination of verdicts, at most as many as the sample has
    left = sample.groupBy(*[F.coalesce(F.expr(r.fails), F.lit(False)).alias(r.name) for r in rules]).agg(F.count("*").alias("_n")).collect()
    order: list[Rule] = []
    while len(order) < len(rules):
        rejected = {r.name: sum(x["_n"] for x in left if x[r.name]) for r in rules if r not in order}
        best = max((r for r in rules if r not in order), key=lambda r: rejected[r.name] / cost[r.name])
        order.append(best)
        left = [x for x in left if not x[best.name]]
    return order


def cascade(rules: list[Rule], skip: str) -> Column:
    """True where no rule fails; rules after the first that fails, and all where ``skip`` holds, aren't evaluated."""
    verdict = F.when(F.expr(skip), F.lit(False))
    for rule in rules:
        verdict = verdict.when(F.expr(rule.fails), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A null or empty text has zero counts, fails the base (fewer than 20 words) and is not kept.
    Null ids stay null, repeated rows give repeated rows, an empty table gives none; other
    columns, whatever their names, are not read.  ``sample_rows`` bounds the sample that sets
    the order of the rules, by those of its rows that the base lets through; every row gets its verdict from all of them.
    """
    total = df.count()
    share = min(1.0, 2 * sample_rows / max(total, 1))
    failed = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    sample = scratch.materialise(statistics(df.sample(fraction=share, seed=11).limit(sample_rows), id_col, text_col), "rule-sample").where(f"NOT ({failed})")
    ordered = estimate(sample, rules)
    counts = statistics(df, id_col, text_col)
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(failed).alias("base_failed"), cascade(ordered, failed).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS s FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM c)),
k AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n >= 2),
o AS (SELECT r, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM k) GROUP BY r),
a AS (SELECT c.*, coalesce(o.n, 0) AS n_repeat_words FROM c LEFT JOIN o USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 100000 AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 10 * n_symbols <= n_words
       AND 2 * n_dup_lines <= len(ls) AND 5 * len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) <= n_words AND 10 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{FFFF}]'))) >= 7 * n_words
       AND 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*]'))) <= 9 * len(ls)
       AND 10 * len(list_filter(ls, lambda x: regexp_matches(x, '[.]{3}[\x20\x09-\x0D]*$'))) <= 3 * len(ls) AS kept
FROM b
"""
