"""Tables that are written once and read by later jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, not yet made, below ``spark.checkpoint.dir``; where that is unset, a temporary one, with a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="donorlake-tables-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: what made it isn't run twice, and lost executors lose nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make this package importable where tasks run, once in an application; threads that come together wait for the first."""
    app = spark.sparkContext.applicationId
    with _shipping:
        if app in _shipped:
            return
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="donorlake-code-")) / "donorlake_core.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
