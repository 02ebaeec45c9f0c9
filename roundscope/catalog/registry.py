"""Pairs each query with DuckDB SQL over the same tables.

``cte`` adds a named oracle relation, ``query`` registers a Spark function with
its oracle.  Only the relations an oracle mentions are put in its WITH clause.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.common import release_shared
from ..sources.bridge import MatchTables, duck_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TABLES: dict[tuple[str, str], MatchTables] = {}
_CTES: dict[str, str] = dict(duck_ctes())


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


def with_clause(sql: str, given: dict[str, str] | None = None) -> str:
    given = given or {}
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for word in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in _CTES and word not in needed and word not in given:
                needed.add(word)
                todo.append(_CTES[word])
    parts = [f"{n} AS ({q})" for n, q in given.items()] + [f"{n} AS ({_CTES[n]})" for n in _CTES if n in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql


def scoped(sql: str, given: dict[str, str]) -> str:
    """``sql`` with some relations replaced: ``given`` may name relations of the surrounding query."""
    inner = with_clause(sql, given)
    return inner if inner.startswith("WITH") else f"WITH RECURSIVE {', '.join(f'{n} AS ({q})' for n, q in given.items())} {sql}"


def tables(spark: SparkSession, path: str) -> MatchTables:
    """Tables of one session and folder; derived layers built on them are reused by later queries."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = MatchTables(spark, path)
    return _TABLES[key]


def forget_layers() -> None:
    """Drop reused layers and their files, so the next query builds everything itself (used by the benchmark)."""
    for t in _TABLES.values():
        t.close()
    _TABLES.clear()
    release_shared()


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its oracle."""

    def wrap(fn):
        QUERIES[name] = lambda spark, path: fn(tables(spark, path))
        if sql is not None:
            ORACLES[name] = with_clause(sql)
        return fn

    return wrap
