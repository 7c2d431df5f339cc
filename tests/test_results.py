"""Run stores and digests of ids against plain versions."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from donorlake.sources import readers, results, sinks

KEYS = ["arm", "seed"]


def ordered(ids):
    return hashlib.sha256(b"".join(struct.pack(">Q", len(x.encode())) + x.encode() for x in ids)).hexdigest()


def blocks(ids):
    by = {}
    for x in sorted(ids):
        by.setdefault(hashlib.sha256(x.encode()).hexdigest()[:3], []).append(x)
    return hashlib.sha256("".join(b + ordered(by[b]) for b in sorted(by)).encode()).hexdigest()


def test_digests(spark):
    rows = [("a", "x", 3), ("a", "dé日", 1), ("a", "", 2), ("b", "y" * 300, 1), ("b", "y" * 300, 2)]
    df = spark.createDataFrame(rows, "g string, id string, at int").repartition(3)
    got = {r.g: r.sha256 for r in sinks.ordered_ids_sha256(df, "id", "at", "g").collect()}
    assert got == {"a": ordered(["dé日", "", "x"]), "b": ordered(["y" * 300] * 2)}
    assert {r.g: r.sha256 for r in sinks.id_set_sha256(df, "id", "g").collect()} == {g: blocks([r[1] for r in rows if r[0] == g]) for g in "ab"}
    assert sinks.ordered_ids_sha256(df.limit(0), "id", "at").first().sha256 == ordered([])
    assert sinks.id_set_sha256(df.limit(0), "id", "g").count() == 0
    with pytest.raises(ValueError, match="more than 2"):
        sinks.ordered_ids_sha256(df, "id", "at", "g", most=2)
    with pytest.raises(ValueError, match="nulls"):
        sinks.ordered_ids_sha256(df.union(spark.createDataFrame([("a", None, 9)], df.schema)), "id", "at", "g")


def test_store(spark, tmp_path):
    rows = [(a, s, f"d{i}", i / 7, None if i == 3 else -1e-9 * i) for a in ("B0", "T-1") for s in (0, 1) for i in range(9)]
    runs = spark.createDataFrame(rows, "arm string, seed int, donor_id string, observed double, predicted double")
    settings = spark.createDataFrame([("B0", 0, '{"lr": 0.5}')], "arm string, seed int, settings string")
    path = results.write_runs(runs, f"file://{tmp_path}/store", KEYS, settings, files=2)
    back = results.read_runs(spark, path, KEYS)
    assert sorted((r.arm, int(r.seed), *r[:3]) for r in back.select(*["donor_id", "observed", "predicted", *KEYS]).collect() if r.predicted is not None) == sorted(r for r in rows if r[4] is not None)
    assert results.read_runs(spark, path, KEYS, arm="T*").count() == 18
    assert len(list((tmp_path / "store/predictions/arm=B0/seed=0").glob("*.csv"))) <= 2
    told = {(r.arm, r.seed): r for r in results.read_manifests(spark, path, KEYS).collect()}
    assert told["B0", "0"].settings == '{"lr": 0.5}' and told["B0", "1"].settings is None
    assert {(r.n_rows, r.ids_sha256) for r in told.values()} == {(9, blocks([f"d{i}" for i in range(9)]))}
    with pytest.raises(FileExistsError):
        results.write_runs(runs, path, KEYS)
    with pytest.raises(ValueError, match="unique"):
        results.write_runs(runs, f"file://{tmp_path}/twice", KEYS, settings.union(settings))
    for odd in (None, "a/b", ""):
        with pytest.raises(ValueError, match="names"):
            results.write_runs(runs.withColumn("arm", F.lit(odd).cast("string")), f"file://{tmp_path}/odd", KEYS)
        assert not (tmp_path / "odd").exists()  # nothing is reserved by a table that can't be stored


def test_status(spark, tmp_path):
    rows = [("A", s, f"d{i}", 1.0, 2.0) for s in range(5) for i in range(4)]
    runs = spark.createDataFrame(rows, "arm string, seed int, donor_id string, observed double, predicted double")
    path = results.write_runs(runs, f"file://{tmp_path}/store", KEYS)
    found, manifests = results.read_runs(spark, path, KEYS), results.read_manifests(spark, path, KEYS)
    expected = spark.range(1, 7).select(F.lit("A").alias("arm"), F.col("id").alias("seed"))
    damaged = found.where("not (seed = '2' and donor_id = 'd1') and seed <> '4'").withColumn("donor_id", F.when(F.col("seed") == "3", F.upper("donor_id")).otherwise(F.col("donor_id")))
    got = {r.seed: r.status for r in results.run_status(expected, manifests, damaged, KEYS).collect()}
    assert got == {"0": "not expected", "1": "complete", "2": "rows differ", "3": "ids differ", "4": "no results", "5": "no manifest", "6": "no manifest"}
    with pytest.raises(ValueError):
        results.run_status(expected.union(expected), manifests, found, KEYS)


def test_compressed_tables(spark, tmp_path):
    rows = [(1, "a\tb", None), (2, "", 0.1), (3, 'say "x"', 1e300)]
    df = spark.createDataFrame(rows, "n int, t string, x double")
    sinks.csv(df, f"file://{tmp_path}/t", sep="\t", compression="gzip")
    assert list((tmp_path / "t").glob("*.csv.gz"))
    assert sorted(map(tuple, readers.csv(spark, f"file://{tmp_path}/t", df.schema, sep="\t").collect())) == [rows[0], (2, None, 0.1), rows[2]]
