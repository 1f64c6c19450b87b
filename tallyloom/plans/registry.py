"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    """Literal rows as a SQL table."""

    def word(x: object) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)}) AS t({names})"
