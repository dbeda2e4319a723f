"""Randomness as a function of the data: independent of partitioning, and reproducible in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key(seed: int, purpose: str, *columns) -> Column:
    """A text that orders rows at random: md5 of seed, purpose and the columns, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def uniform(seed: int, purpose: str, *columns) -> Column:
    """A number in [0, 1) from the first 32 bits of ``sort_key``."""
    return F.conv(F.substring(sort_key(seed, purpose, *columns), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sql_key(seed: int, purpose: str, *columns: str) -> str:
    """DuckDB expression equal to ``sort_key``."""
    return f"md5(concat_ws(':', '{seed}', '{purpose}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}))"


def sql_uniform(seed: int, purpose: str, *columns: str) -> str:
    """DuckDB expression equal to ``uniform``."""
    return f"(CAST(('0x' || substr({sql_key(seed, purpose, *columns)}, 1, 8)) AS UBIGINT) / 4294967296.0)"


#: Hexadecimal digits of ``fine``: 52 bits, which a double holds exactly.
FINE = 13


def fine(seed: int, purpose: str, *columns) -> Column:
    """A number in (0, 1) from 52 bits of ``sort_key``, for tables of more than some billion rows and for logarithms."""
    return (F.conv(F.substring(sort_key(seed, purpose, *columns), 1, FINE), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**FINE))


def sql_fine(seed: int, purpose: str, *columns: str) -> str:
    """DuckDB expression equal to ``fine``."""
    return f"((CAST(('0x' || substr({sql_key(seed, purpose, *columns)}, 1, {FINE})) AS UBIGINT) + CAST(0.5 AS DOUBLE)) / CAST({16**FINE} AS DOUBLE))"


def plain_fine(seed: int, purpose: str, *values) -> float:
    """``fine`` of single values, for a few parameters on the driver."""
    return (int(hashlib.md5(":".join(map(str, (seed, purpose, *values))).encode()).hexdigest()[:FINE], 16) + 0.5) / 16**FINE
