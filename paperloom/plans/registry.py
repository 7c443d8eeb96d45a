"""The registry of queries: a name, a function of the tables and, where SQL can say it, oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.tables import DERIVED, Tables, derived_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables)``. In the SQL, ``{jobs}`` and the like stand for derived tables."""

    def wrap(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = _plain_counts(re.sub(r"\{(" + "|".join(DERIVED) + r")\}", lambda m: derived_sql(m[1]), sql))
        return f

    return wrap


def _plain_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``, which is a bigint and never null in DuckDB."""
    mark = "count_if("
    while (start := sql.find(mark)) >= 0:
        depth, quoted, at = 1, False, start + len(mark)
        while depth:
            c = sql[at]
            quoted ^= c == "'"
            depth += (not quoted) * ((c == "(") - (c == ")"))
            at += 1
        sql = f"{sql[:start]}count(*) FILTER (WHERE {sql[start + len(mark) : at - 1]}){sql[at:]}"
    return sql


def values_sql(rows: list[tuple], columns: str) -> str:
    """``(VALUES ...) AS v(columns)`` for DuckDB."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, str):
            return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n")) if "\n" in x else "'" + x.replace("'", "''") + "'"
        return f"CAST({x!r} AS {'DOUBLE' if isinstance(x, float) else 'BIGINT'})"

    return "(VALUES " + ", ".join("(" + ", ".join(cell(c) for c in r) + ")" for r in rows) + f") AS v({columns})"
