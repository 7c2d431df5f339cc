"""Schemas and eager assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPR = "cell_id bigint, gene string, value double"
OBS = "cell_id bigint, donor_id string, cell_type string, region string"
PREDICTIONS = "seed int, arm string, donor_id string, observed double, predicted double"


def require(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """Raise ValueError if any row is broken; one aggregate job, so that lazy plans don't swallow the error."""
    n = df.agg(F.count(F.when(broken, 1))).first()[0]
    if n:
        raise ValueError(f"{message} ({n} rows)")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{', '.join(keys)} must be unique")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keep_and_rename(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns by name, or ``SRC=DST`` to rename; one that is missing is an error."""
    pairs = [(w.partition("=")[0], w.partition("=")[2] or w) for w in wanted]
    require_columns(df, *(s for s, _ in pairs))
    return df.select(*(F.col(f"`{s}`").alias(d) for s, d in pairs))


def normalize_obs(df: DataFrame, donor: str, kind: str, region: str, renamed: dict[str, str]) -> DataFrame:
    """The table with ``donor_id`` and ``cell_type`` as text, a constant ``region``, and copies of columns under new names where they exist."""
    require_columns(df, donor, kind)
    extra = {dst: F.col(f"`{src}`") for src, dst in renamed.items() if src in df.columns}
    return df.withColumns({"cell_type": F.col(f"`{kind}`").cast("string"), "donor_id": F.col(f"`{donor}`").cast("string"), **extra, "region": F.lit(region)})


def sanitised(df: DataFrame) -> DataFrame:
    """Names with ``_`` for ``/``; columns that aren't numbers or booleans become text."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string")
    return df.select(*(F.col(f"`{n}`").cast(t if t in plain or t.startswith("decimal") else "string").alias(n.replace("/", "_")) for n, t in df.dtypes))
