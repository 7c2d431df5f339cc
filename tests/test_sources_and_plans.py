"""Readers, sinks, task graphs, the stream and the driver's contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from donorlake.plans import catalogue, tasks
from donorlake.sources import readers, sinks
from donorlake.streaming import events
from tests.conftest import ROOT, SF


def test_write_once(spark, tmp_path):
    path = sinks.reserve_output(spark, f"file://{tmp_path}/run")
    with pytest.raises(FileExistsError):
        sinks.reserve_output(spark, path)
    with pytest.raises(FileNotFoundError):
        sinks.require_reserved(spark, f"file://{tmp_path}/none")
    sinks.manifest(spark, f"{path}/m.json", {"a": 1})
    assert json.loads((tmp_path / "run/m.json").read_text()) == {"a": 1}
    with pytest.raises(Exception):
        sinks.manifest(spark, f"{path}/m.json", {"a": 2})
    df = spark.range(3)
    sinks.parquet(df, f"{path}/p")
    with pytest.raises(Exception):
        sinks.parquet(df, f"{path}/p")
    assert sinks.markdown(df.limit(1)) == "| id |\n| --- |\n| 0 |"


def test_readers(spark, tmp_path):
    for s in range(2):
        d = tmp_path / f"c1/run_s{s}_x"
        d.mkdir(parents=True)
        (d / "metrics.csv").write_text("arm,rho\nB0,0.5\n")
    got = readers.csv_runs(spark, [f"{tmp_path}/c1/*/metrics.csv"], "arm string, rho double", r"/(c\d)/run_s(\d+)_", ["cohort", "seed"])
    assert sorted((r.cohort, r.seed, r.rho) for r in got.collect()) == [("c1", "0", 0.5), ("c1", "1", 0.5)]
    with pytest.raises(ValueError):
        readers.csv_runs(spark, [f"{tmp_path}/c1/*/metrics.csv"], "arm string, rho double", "nothing", [])
    assert readers.permutation_nulls(spark, f"{tmp_path}").count() == 0
    (tmp_path / "perm_1.csv").write_text("arm,perm,perm_seed,rho,n_train_donors,n_test_donors\nB0,1,5,0.1,6,2\n")
    assert readers.permutation_nulls(spark, f"{tmp_path}").first().rho == 0.1
    (tmp_path / "p.csv").write_text("who,observed,predicted\na,1,2\n")
    assert readers.predictions(spark, f"{tmp_path}/p.csv").first().donor_id == "a"
    (tmp_path / "m.json").write_text('{"T": ["a", "b"]}')
    assert readers.json_map(spark, f"{tmp_path}/m.json", "array<string>").first().value == ["a", "b"]
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "nothing")
    assert readers.file_hashes(spark, f"{tmp_path}/m.json").count() == 1


def test_task_graph(spark):
    schema = "id string, status string, depends_on array<string>, evidence array<string>"
    chain = spark.createDataFrame([("A", "completed", [], ["x"]), ("B", "pending", ["A"], []), ("C", "pending", ["B"], [])], schema)
    assert tasks.validate_plan(chain) == ["A", "B", "C"]
    assert {r.id: r.status for r in tasks.plan_status(chain).collect()} == {"A": "completed", "B": "ready", "C": "blocked"}
    for bad in ([("A", "pending", ["B"], []), ("B", "pending", ["A"], [])], [("A", "completed", [], [])], [("A", "odd", [], [])], [("A", "pending", ["Z"], [])], [("A", "pending", [], []), ("A", "pending", [], [])]):
        with pytest.raises(ValueError):
            tasks.validate_plan(spark.createDataFrame(bad, schema))


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.hourly(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.hour, r.event_type): r.n for r in spark.sql("select * from hourly").collect()}
    assert got == {(r.hour, r.event_type): r.n for r in events.hourly(table).collect()}


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in sorted((ROOT / SF).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted(str([norm(dict(zip(names, x))[c]) for c in cols]) for x in r.fetchall())
    assert sorted(str([norm(x[c]) for c in cols]) for x in df.select(*(F.col(f"`{c}`") for c in cols)).collect()) == want
