"""Reports over many runs: pivots, manifests, completeness, column coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, index: list[str], column: str, values: list, value: str, how: str = "avg") -> DataFrame:
    """A column per given value (given, so that no job has to find them)."""
    return df.groupBy(*index).pivot(column, values).agg(getattr(F, how)(value))


def pivot_mean_std(df: DataFrame, index: list[str], value: str) -> DataFrame:
    return df.groupBy(*index).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def custom_order(arm: Column, order: list[str]) -> Column:
    """Place in a list, 99 where it isn't."""
    names = F.array(*map(F.lit, order))
    at = F.array_position(names, arm)
    return F.when(at > 0, at - 1).otherwise(99)


def missing_artifacts(expected: DataFrame, existing: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n_expected, n_missing) of files by job."""
    have = existing.select(key).distinct().withColumn("_have", F.lit(1))
    return expected.join(have, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_expected"), F.count(F.when(F.col("_have").isNull(), 1)).alias("n_missing"))


def not_superseded(runs: DataFrame, superseded: DataFrame, key: str = "run") -> DataFrame:
    return runs.join(superseded, key, "left_anti")


def leakage_flag(mode: Column, text: Column) -> Column:
    """Any of three signs that labels reached the text side."""
    return F.coalesce(mode.contains("label") | text.contains("type_") | text.contains("cell type"), F.lit(False))


def arm_parts(arm: Column) -> tuple[Column, Column]:
    """Encoder and region of an arm name such as ``pca_MTG``."""
    return F.split_part(arm, F.lit("_"), F.lit(1)), F.regexp_extract(arm, r"_([A-Za-z]+)$", 1)


def level_order(labels: DataFrame, label: str, known: list[str]) -> DataFrame:
    """(label, place): known labels in their order, others behind by their trailing integer, then name; nulls are left out."""
    from pyspark.sql import Window

    from ..functions.scalar import trailing_integer

    names = labels.select(label).where(F.col(label).isNotNull()).distinct()
    at = F.array_position(F.array(*map(F.lit, known)), F.col(label)) if known else F.lit(0)
    key = F.when(at > 0, at).otherwise(10**7 + trailing_integer(F.col(label)))
    return names.select(label, (F.row_number().over(Window.orderBy(key, label)) - 1).alias("place"))


def quantile_bins(donors: DataFrame, value: str, train: Column, edges: list[float]) -> DataFrame:
    """(donor_id, bin): how many quantile edges of train donors a value reaches; a missing value is in the top bin."""
    cuts = donors.where(train).agg(F.percentile(value, F.array(*map(F.lit, edges))).alias("e"))
    n = F.size(F.filter("e", lambda x: F.col(value) >= x))
    return donors.join(F.broadcast(cuts)).select("donor_id", F.concat(F.lit(f"{value}_q"), F.when(F.col(value).isNull(), F.lit(len(edges))).otherwise(n).cast("string")).alias("bin"))


def binary_covariate(df: DataFrame, column: str) -> DataFrame:
    """Numeric cast where 90 % of known values are numbers; else 0/1 where there are two categories (the later by name is 1); else null."""
    c = F.col(column)
    stats = df.agg((F.count(c.try_cast("double")) / F.nullif(F.count(c), F.lit(0))).alias("share"), F.count_distinct(c).alias("k"), F.max(c).alias("top"))
    coded = F.when(F.col("share") >= 0.9, c.try_cast("double")).when(F.col("k") == 2, F.when(c.isNotNull(), (c == F.col("top")).cast("double")))
    return df.join(F.broadcast(stats)).withColumn("coded", coded).drop("share", "k", "top")


def dataset_manifest(obs: DataFrame) -> DataFrame:
    """Cells per donor and type, and totals, as (kind, name, n)."""
    parts = [obs.groupBy(F.lit(k).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")) for k, c in (("donor", "donor_id"), ("type", "cell_type"))]
    return parts[0].unionByName(parts[1]).unionByName(obs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("kind"), F.lit("all").alias("name"), "n"))


def profile(df: DataFrame, columns: list[str], most: int = 30) -> DataFrame:
    """(column, value, n): value counts of columns with at most ``most`` values; of others only how many there are."""
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    k = F.count(F.lit(1)).over(Window.partitionBy("column"))
    sized = counts.withColumn("k", k)
    return sized.where(F.col("k") <= most).select("column", "value", "n").unionByName(sized.where(F.col("k") > most).groupBy("column").agg(F.first("k").alias("n")).select("column", F.lit(None).cast("string").alias("value"), "n"))


def typed_config(manifests: DataFrame, column: str, schema: str) -> DataFrame:
    """A manifest's stringified settings with their types; what can't be read is null."""
    return manifests.withColumn(column, F.from_json(column, schema, {"allowUnquotedFieldNames": "true"}))


def environment(spark) -> DataFrame:
    """One row: versions of Spark, Python and libraries, and the repository's revision or null."""
    import platform
    import subprocess
    from importlib import metadata
    from pathlib import Path

    try:
        run = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10)
        revision = run.stdout.strip() if run.returncode == 0 else None
    except OSError:
        revision = None
    versions = [metadata.version(n) for n in ("numpy", "pyarrow")]
    return spark.createDataFrame([(spark.version, platform.python_version(), *versions, revision)], "spark string, python string, numpy string, pyarrow string, revision string")


def ordinal_map(label: Column, levels: dict[str, float]) -> Column:
    """The number of a label, null for a label that isn't in the map."""
    return F.create_map(*(F.lit(x) for pair in levels.items() for x in pair))[label]


def level_ids(label: Column, order: list[str]) -> Column:
    """Place of a label in an order from 0, -1 where it isn't there."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), label) - 1, F.lit(-1)).cast("int")
