"""Sinks that write once: an existing path is an error before any work."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def reserve_output(spark: SparkSession, path: str) -> str:
    """Make a folder; FileExistsError if it is there."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    fs.mkdirs(p)
    return path


def require_reserved(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} isn't reserved")
    return path


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    """With a header; empty texts read back as null, as CSV has one sign for both."""
    df.write.mode("errorifexists").csv(path, header=True, sep=sep, compression=compression)


def json_lines(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").json(path)


def manifest(spark: SparkSession, path: str, record: dict, indent: int | None = 1) -> None:
    """One JSON file by exclusive create; without indent it is one line."""
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(record, sort_keys=True, indent=indent).encode()))
    out.close()


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small table (a report's rows) as Markdown."""
    rows = [["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


#: Ids of one digest, which one task hashes in their order.
MOST_IDS = 1_000_000


def ordered_ids_sha256(ids: DataFrame, key: str, order: str, *by: str, most: int = MOST_IDS) -> DataFrame:
    """(by, sha256) over the ids of each group in order, each behind its length as 8 bytes (big-endian).

    Such a digest is sequential, so a group's ids meet in one task: more than
    ``most`` in a group are an error, as is a null id.  Without ``by`` all rows
    are one group, which may be empty.
    """
    sizes = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count(key).alias("_known"))
    bad = sizes.where((F.col("_n") > most) | (F.col("_known") < F.col("_n"))).first()
    if bad is not None:
        raise ValueError(f"more than {most} ids in a digest" if bad["_n"] > most else f"{key} has nulls")
    piece = F.concat(F.lpad(F.hex(F.octet_length(key).cast("bigint")), 16, "0"), F.hex(F.col(key).cast("binary")))
    listed = ids.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))).alias("l"))
    return listed.select(*by, F.sha2(F.unhex(F.array_join(F.transform("l", lambda x: x["p"]), "")), 256).alias("sha256"))


def id_set_sha256(ids: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, sha256) of groups of any size: ids fall into 4,096 blocks by the first digits of their own digest, each block is digested in order, then the blocks' digests are.

    Repeated ids count as often as they stand there.  A group without rows has
    no row.
    """
    block = F.substring(F.sha2(F.col(key).cast("binary"), 256), 1, 3)
    each = ordered_ids_sha256(ids.select(*by, F.col(key), block.alias("_block")), key, key, *by, "_block")
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.concat("_block", "sha256"))).alias("l"))
    return listed.select(*by, F.sha2(F.array_join("l", ""), 256).alias("sha256"))


def release(spark: SparkSession, path: str, tables: dict[str, DataFrame], allowed: tuple[str, ...]) -> None:
    """Several tables, all or none: written into a folder of their own, told by a manifest that comes last and is created exclusively.

    ValueError for a name that isn't allowed; FileExistsError where a release
    is there.  A crash leaves no release, and a second try isn't in its way.
    """
    odd = sorted(set(tables) - set(allowed))
    if odd:
        raise ValueError(f"not to be released: {', '.join(odd)}")
    p, fs = _path(spark, f"{path}/release.json")
    if fs.exists(p):
        raise FileExistsError(path)
    stage, told = f"stage-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        parquet(df, f"{path}/{stage}/{name}")
        back = spark.read.parquet(f"{path}/{stage}/{name}")
        told[name] = {"folder": f"{stage}/{name}", "rows": back.count(), "columns": back.columns}
    manifest(spark, f"{path}/release.json", {"tables": told})
