"""SQL that several oracles share."""

from __future__ import annotations

#: CTEs that give ``crc_table``, one row with the 256 steps of CRC-32 (reflected, polynomial 0xEDB88320) in ``t``.
CRC32_TABLE = """crc_steps(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def crc32_of(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, where ``crc_table`` is joined."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
