"""A store of run results: all runs of a table are written in one job, told by manifests, read back and checked.

A store is a folder made once.  ``predictions`` has a folder for each run
(``arm=A/seed=0``) with CSV files, ``manifest`` has a JSON line for each run:
how many rows it has, the digest of its donors, and its settings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require_unique
from . import readers, sinks
from .shared import written

#: Columns of a run's file.
ROW = "donor_id string, observed double, predicted double"
#: What the keys of a run may look like, since they name folders.
NAME = r"^[A-Za-z0-9_.-]+$"


def told(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, ids_sha256) of each run."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(sinks.id_set_sha256(rows, "donor_id", *keys).withColumnRenamed("sha256", "ids_sha256"), keys)


def write_runs(runs: DataFrame, path: str, keys: list[str], settings: DataFrame | None = None, files: int = 4) -> str:
    """Store ``runs(keys, donor_id, observed, predicted)``; ``settings(keys, settings)`` has a JSON text for each run.

    The folder is reserved first: FileExistsError where it is there.  A run is
    dealt over at most ``files`` files by its donors, so that a large one isn't
    one task's work.  ValueError for a key that is null or can't name a folder;
    a run without settings has null.  The manifests come last, so a store
    without them isn't whole.
    """
    spark = runs.sparkSession
    if settings is not None:
        require_unique(settings, *keys)
    rows = written(runs.select(*(F.col(k).cast("string").alias(k) for k in keys), "donor_id", "observed", "predicted"), "runs")
    odd = reduce(lambda a, b: a | b, (F.coalesce(~F.col(k).rlike(NAME), F.lit(True)) for k in keys))
    if not rows.where(odd).isEmpty():
        raise ValueError(f"{', '.join(keys)} must be names")
    sinks.reserve_output(spark, path)
    dealt = rows.repartition(*keys, F.pmod(F.xxhash64("donor_id"), F.lit(files)))
    dealt.write.partitionBy(*keys).csv(f"{path}/predictions", header=True)
    lines = told(rows, keys)
    if settings is not None:
        named = settings.select(*(F.col(k).cast("string").alias(k) for k in keys), "settings")
        lines = lines.join(named, keys, "left")
    else:
        lines = lines.withColumn("settings", F.lit(None).cast("string"))
    sinks.json_lines(lines, f"{path}/manifest", [*keys, "n_rows", "ids_sha256", "settings"])
    return path


def read_runs(spark: SparkSession, path: str, keys: list[str], **only: str) -> DataFrame:
    """Rows of a store's runs with their keys from the folders' names; ``arm="B*"`` reads only the folders that match."""
    folders = "".join(f"/{k}={only.get(k, '*')}" for k in keys)
    pattern = "".join(f"/{k}=([^/]+)" for k in keys) + "/[^/]+$"
    return readers.csv_runs(spark, [f"{path}/predictions{folders}/*.csv"], ROW, pattern, keys)


def read_manifests(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{k} string" for k in keys) + ", n_rows long, ids_sha256 string, settings string"
    return readers.json_lines(spark, f"{path}/manifest", schema)


def run_status(expected: DataFrame, manifests: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status) of runs that are expected, have a manifest or have rows.

    ``complete``, or what is wrong first: ``not expected``, ``no manifest``,
    ``no results``, ``rows differ`` (their number), ``ids differ`` (the donors).
    """
    names = [F.col(k).cast("string").alias(k) for k in keys]
    want = require_unique(expected, *keys).select(*names, F.lit(True).alias("_want"))
    have = require_unique(manifests, *keys).select(*names, F.col("n_rows").alias("_n"), F.col("ids_sha256").alias("_ids"))
    rows = told(found, keys).select(*names, "n_rows", "ids_sha256")
    all_runs = want.join(have, keys, "full").join(rows, keys, "full")
    status = F.when(F.col("_want").isNull(), "not expected").when(F.col("_n").isNull(), "no manifest").when(F.col("n_rows").isNull(), "no results")
    status = status.when(F.col("n_rows") != F.col("_n"), "rows differ").when(F.col("ids_sha256") != F.col("_ids"), "ids differ").otherwise("complete")
    return all_runs.select(*keys, status.alias("status"))
