"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def u(key: str, seed: str) -> str:
    """SQL of functions.scalar.keyed."""
    return f"CAST(('0x' || substr(md5({key} || '|' || {seed}), 1, 8))::UBIGINT AS BIGINT)"


def corr(a: str, b: str) -> str:
    """SQL of operators.stats.pearson."""
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
