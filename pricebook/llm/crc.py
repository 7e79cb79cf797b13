"""crc32 as SQL, for engines that have no such function."""

from __future__ import annotations

#: A common table of one row: the 256 remainders, ``crc_table.t``.
CRC32_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b))"""


def crc32_sql(column: str) -> str:
    """The unsigned crc32 of a blob column, as an expression over ``crc_table``."""
    byte = f"(instr('0123456789ABCDEF', substr(hex({column}), (2 * i - 1)::BIGINT, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({column}), (2 * i)::BIGINT, 1)) - 1"
    bytes_ = f"list_transform(range(1, octet_length({column}) + 1), lambda i: ({byte})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
