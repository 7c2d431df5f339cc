"""What the operators share: the shared folder, shipping of code, Arrow helpers.

Every operator that has to write (token files, archives, materialised tables)
writes below ``spark.checkpoint.dir``, the one folder that driver and executors
share; only where it is unset in local mode (tests, notebooks) a temporary folder
is made.
Files are written under a temporary name and moved to a name that depends on
the partition only, so a retried or speculative task leaves the same file.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch.  Texts may be long, so batches are short.
BATCH_ROWS = 512

_shipped: set[str] = set()


_kept: dict = {}


def kept(key, make):
    """What a worker process keeps between tasks: one object, so that operators that follow each other don't add up."""
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors and keep Arrow batches short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="donorlake-")) / "donorlake_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (as a URI, not yet made) in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="donorlake-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/donorlake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write byte strings to a file by way of a temporary name; returns the bytes written."""
    f, path = open_fs(uri)
    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with f.open_output_stream(tmp, compression=None) as out:
        for x in parts:
            out.write(x)
            n += len(x)
    f.move(tmp, path)
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
