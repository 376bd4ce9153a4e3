"""Named queries, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facadelake.sources.tables import ORACLE_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = dict(ORACLE_VIEWS)


def sql_view(name: str, text: str) -> None:
    """A named subquery for use in the SQL texts; it may use views named before it."""
    SQL_VIEWS[name] = text


def _needed(text: str, found: list[str]) -> list[str]:
    for name in SQL_VIEWS:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(SQL_VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def with_views(body: str) -> str:
    names = _needed(body, [])
    if not names:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {head}\nSELECT * FROM ({body}) q"


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` is the equivalent text over the same tables."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
