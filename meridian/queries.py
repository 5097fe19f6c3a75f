"""One query and, where SQL can express it, one DuckDB query per inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridian.plans import aggregate_queries, market_queries, model_queries, source_queries, text_queries  # noqa: F401
from meridian.plans.registry import ORACLES, QUERIES, oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: oracle(sql) for k, sql in ORACLES.items()}
