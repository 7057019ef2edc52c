"""Where queries register with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable(spark, folder) and, where there is one, the DuckDB SQL with the same result."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: White space at either end, as DuckDB's pattern (the same set as functions.text.strip_ends).
ENDS = r"^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{ENDS}', '', 'g')"
