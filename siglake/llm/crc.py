"""CRC-32 of a value's decimal text in DuckDB SQL, which has no function for it; used by the queries' SQL alone."""

#: Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320


def crc32_table() -> str:
    """SQL: the 256 remainders as a list."""
    step = f"CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}) ELSE a >> 1 END"
    return f"(SELECT list(c ORDER BY n) FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, k: {step}) AS c FROM (SELECT unnest(range(256)) AS n)))"


def crc32_sql(value: str, table: str) -> str:
    """SQL: the unsigned CRC-32 of value's text. table: a column that holds crc32_table()."""
    codes = f"list_transform(string_split({value}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, {table}[xor(a & 255, b) + 1])))"
