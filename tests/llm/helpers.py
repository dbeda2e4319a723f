"""Awkward tables that every operator must take, and small brute-force versions."""

import random
import re

WORDS = ["the", "of", "and", "naïve", "straße", "x,", "Él", "data", "THE", "don't", "42", "€5", "a.b"]
COLUMNS = "doc_id long, text string, n_chars long, lang string, source string, fp long, bucket int, unit int, pos long, tie int, spans string, _text string, n_tokens string, score string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sentence(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


def texts(seed=0, n=40):
    """(doc_id, text): copies, near copies, shared passages, long, empty and null texts, a null id, repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, sentence(rng, rng.randint(0, 120))) for i in range(n)]
    base = sentence(rng, 400)
    near = base.split(" ")
    rows += [(100, base), (101, base), (102, " ".join(near[:200] + ["changed"] + near[201:])), (103, passage), (104, "before " + passage + " after"), (105, "other " + passage)]
    rows += [(200, ""), (201, None), (202, " \n\t "), (203, "one"), (204, "z" * 3000), (205, sentence(rng, 6000)), (206, "line\n" * 50), (None, "a text without an id"), (207, "twice"), (207, "twice"), (208, "same id"), (208, "same id, other text"), (300, "nul \x00 and   and   and 日本語 <|endoftext|> x")]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    """The rows with more columns, some named like what operators use inside."""
    full = [(d, t, None if t is None else len(t), "en", None, 1, 2, 3, 4, 5, "s", None, "n", None) for d, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in SPACE.split(lowered) if w]


def keyed(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
