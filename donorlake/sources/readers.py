"""Scans: lazy, with pushed-down filters and pruned columns wherever the format allows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import require_columns
from .shared import written

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Name a data set so that ``load_dataset`` finds it."""

    def add(f):
        _REGISTRY[name] = f
        return f

    return add


def load_dataset(spark: SparkSession, name: str, root: str = "") -> DataFrame:
    """A registered data set, or a Parquet file or folder by its path; anything else is an error."""
    if name in _REGISTRY:
        return _REGISTRY[name](spark, root)
    if name.endswith(".parquet"):
        return spark.read.parquet(name)
    raise ValueError(f"unknown data set: {name}")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """CSV (also gzip, also tab-separated) with a header and an explicit schema."""
    return spark.read.csv(path, header=True, schema=schema, sep=sep)


def csv_runs(spark: SparkSession, paths: list[str], schema: str, pattern: str, keys: list[str]) -> DataFrame:
    """Union of result files; ``keys`` are the groups of ``pattern`` in each file's path, files that don't match are left out."""
    df = spark.read.csv(paths, header=True, schema=schema).withColumn("_path", F.col("_metadata.file_path"))
    df = df.where(F.col("_path").rlike(pattern))
    for i, key in enumerate(keys, 1):
        df = df.withColumn(key, F.regexp_extract("_path", pattern, i))
    if df.isEmpty():
        raise ValueError("no run matches")
    return df.drop("_path")


def permutation_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """All perm_*.csv of a folder; a typed empty table where there is none."""
    schema = "arm string, perm int, perm_seed long, rho double, n_train_donors int, n_test_donors int"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/perm_*.csv")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return spark.read.csv(f"{folder}/perm_*.csv", header=True, schema=schema) if found else spark.createDataFrame([], schema)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A predictions file: its first column is the donor; observed and predicted must be there."""
    df = spark.read.csv(path, header=True)
    df = require_columns(df.withColumnRenamed(df.columns[0], "donor_id"), "observed", "predicted")
    return df.select("donor_id", F.col("observed").cast("double"), F.col("predicted").cast("double"))


def json_map(spark: SparkSession, path: str, values: str = "string") -> DataFrame:
    """A JSON file that is one object, as rows (key, value); ``values`` is the type of a value, e.g. ``array<string>``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{values}>")).alias("key", "value"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def source_scan(obs: DataFrame, names: DataFrame, part: str, tissue: str, dataset: str = "dataset_id", title: str = "title") -> DataFrame:
    """Cells of the data sets whose title contains a text, of one tissue, primary data only."""
    wanted = names.where(F.coalesce(F.lower(title).contains(part.lower()), F.lit(False))).select(dataset)
    return obs.where((F.col("tissue_general") == tissue) & F.col("is_primary_data")).join(wanted, dataset, "left_semi")


def within_budget(rows: DataFrame, order: list[str], text: str, most_rows: int | None = None, most_chars: int | None = None) -> DataFrame:
    """The first rows in a total order until so many rows, or so many characters of ``text``, have been read; the row that crosses the limit of characters is the last.

    A reader in order, without one: rows are dealt by ranges of the order, each
    range's sums are added up over the ranges, ranges in front of the limit are
    kept whole and only the one that crosses it is counted row by row.  A null
    text has no characters; rows that are equal in the order stand in any order
    among themselves, so let it be total.
    """
    keys = [F.col(f"_row.{c}") for c in order]
    dealt = rows.select(F.struct("*").alias("_row")).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = written(dealt, "budget")
    part, size = F.shiftright("_at", 33), F.coalesce(F.length(F.col(f"_row.{text}")), F.lit(0)).cast("long")
    sums = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_c"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("_part", "_n", "_c", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_chars"))
    opened, whole = F.lit(True), F.lit(True)
    if most_rows is not None:
        opened, whole = opened & (F.col("_rows") < most_rows), whole & (F.col("_rows") + F.col("_n") <= most_rows)
    if most_chars is not None:
        opened, whole = opened & (F.col("_chars") < most_chars), whole & (F.col("_chars") + F.col("_c") < most_chars)
    marked = placed.join(F.broadcast(sums.where(opened)), part == F.col("_part"))
    own = Window.partitionBy("_part").orderBy("_at")
    crossing = marked.where(~whole).withColumns({"_i": F.col("_rows") + F.row_number().over(own) - 1, "_b": F.col("_chars") + F.sum(size).over(own) - size})
    if most_rows is not None:
        crossing = crossing.where(F.col("_i") < most_rows)
    if most_chars is not None:
        crossing = crossing.where(F.col("_b") < most_chars)
    return marked.where(whole).select("_row.*").unionByName(crossing.select("_row.*"))


def json_lines_within(spark: SparkSession, paths: list[str], schema: str, text: str, most_rows: int | None = None, most_chars: int | None = None) -> DataFrame:
    """Lines of JSON files, file by file by name and in the order of lines, until a budget is used up."""
    rows = spark.read.json(paths, schema=schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return within_budget(rows, ["_file", "_block", "_line"], text, most_rows, most_chars).drop("_file", "_block", "_line")


def released(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a release; an error where the release isn't whole, or the table's rows aren't those that the manifest tells."""
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/release.json").collect())
    entry = json.loads(text)["tables"][name]
    got = spark.read.parquet(f"{path}/{entry['folder']}")
    n = got.count()
    if n != entry["rows"]:
        raise ValueError(f"{name} has {n} rows, the release tells of {entry['rows']}")
    return got
