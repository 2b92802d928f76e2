"""The table of queries and their SQL, filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def sql_list(values: tuple | list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_cut(value: str, most: int) -> str:
    """SQL of functions.text.shorten for a trimmed value."""
    head = f"left({value}, {most})"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    cut = f"case when contains({head}, ' ') and {last} > {most * 0.6} then left({head}, {last}) else {head} end"
    return f"case when length({value}) <= {most} then {value} else concat(regexp_replace({cut}, '[\\s.,;:—-]+$', ''), '…') end"
