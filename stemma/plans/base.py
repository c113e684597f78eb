"""The registers of queries and of their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The same white space class as ``functions.SPACE``.
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, or under ``name`` where that is the name of a column function too."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def collapsed(text: str) -> str:
    """SQL of ``functions.collapse``."""
    return f"trim(regexp_replace({text}, '{WS}', ' ', 'g'))"


def lines_of(table: str, key: str) -> str:
    """SQL of the numbered lines of a table's texts that hold more than white space: (key, ordinal, text)."""
    parts = f"string_split(text, chr(10))"
    return f"(SELECT {key}, ordinal::INTEGER AS ordinal, line AS text FROM (SELECT {key}, unnest({parts}) AS line, unnest(range(1, len({parts}) + 1)) AS ordinal FROM {table}) WHERE regexp_replace(line, '{WS}', '', 'g') <> '')"
