"""SQL that several operators' twins share."""

from __future__ import annotations

#: One row, tab: the 256 steps of crc32 by bytes, from its polynomial.
CRC_TABLE_SQL = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text that isn't null, as a BIGINT; crc's tab must be in reach."""
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {of_bytes}), lambda h, b: xor(h >> 8, tab[xor(h & 255, b) + 1])), 4294967295)"


def md5_bits_sql(text: str, digits: int) -> str:
    """The first hexadecimal digits of a text's md5, as a BIGINT."""
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"
