"""Registry of queries by inventory id, and assembly of their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridian.sources.bindings import BINDINGS, Tables, names_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Views of DuckDB queries only: what the operators derive at run time, written in plain SQL.
ORACLE_VIEWS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of Tables under an inventory id, with its DuckDB query."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def oracle_view(name: str, sql: str) -> None:
    if name in ORACLE_VIEWS:
        raise ValueError(f"there is a view {name} already")
    ORACLE_VIEWS[name] = sql


def oracle(sql: str) -> str:
    """The query with the bindings and views that it needs as common table expressions."""
    views = {**BINDINGS, **ORACLE_VIEWS}
    order: list[str] = []

    def need(text: str) -> None:
        for name in names_in(text, views):
            if name not in order:
                need(re.sub(rf"\b{name}\b", "", views[name]))
                order.append(name)

    need(sql)
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in dict.fromkeys(order))
    if not ctes:
        return sql
    own = sql.lstrip()
    return f"WITH {ctes},\n{own[4:]}" if own.startswith("WITH ") else f"WITH {ctes}\n{sql}"
