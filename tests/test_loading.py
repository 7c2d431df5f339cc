"""Running budgets, releases and the region loader against sequential versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.operators import prep
from donorlake.sources import readers, sinks


def read_in_turn(texts, most_rows, most_chars):
    kept, used = [], 0
    for t in texts:
        if most_rows is not None and len(kept) >= most_rows or most_chars is not None and used >= most_chars:
            break
        kept.append(t)
        used += len(t or "")
    return kept


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_budgets(spark, partitions):
    rng = np.random.default_rng(2)
    texts = [None if i % 17 == 0 else "x" * int(rng.integers(0, 40)) for i in range(300)]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "n int, text string, _part int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for most_rows, most_chars in ((None, None), (0, None), (5, None), (300, None), (999, 10**9), (None, 0), (None, 1), (None, 777), (120, 2000), (30, 2000), (None, sum(len(t or "") for t in texts)), (None, sum(len(t or "") for t in texts[:100]))):
            got = sorted(readers.within_budget(rows, ["n"], "text", most_rows, most_chars).collect())
            want = read_in_turn(texts, most_rows, most_chars)
            assert [r.n for r in got] == list(range(len(want))), (most_rows, most_chars)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_budget_over_files(spark, tmp_path):
    want = []
    for f in ("a", "b", "c"):
        lines = [f"{f}{i}" * (i % 5 + 1) for i in range(40)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(json.dumps({"t": x}) for x in lines))
        want += lines
    got = readers.json_lines_within(spark, [f"{tmp_path}/{f}.jsonl" for f in "cab"], "t string", "t", 70, 10_000)
    assert got.columns == ["t"] and sorted(r.t for r in got.collect()) == sorted(want[:70])
    got = readers.json_lines_within(spark, [f"{tmp_path}/*.jsonl"], "t string", "t", None, 300)
    assert sorted(r.t for r in got.collect()) == sorted(read_in_turn(want, None, 300))


def test_release(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    good, bad = spark.range(5), spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):  # between two tables
        sinks.release(spark, path, {"a": good, "b": bad}, ("a", "b"))
    with pytest.raises(Exception):
        readers.released(spark, path, "a")
    with pytest.raises(ValueError):
        sinks.release(spark, path, {"a": good, "secret": good}, ("a", "b"))
    sinks.release(spark, path, {"a": good, "b": spark.range(0)}, ("a", "b"))
    assert readers.released(spark, path, "a").count() == 5 and readers.released(spark, path, "b").count() == 0
    with pytest.raises(FileExistsError):
        sinks.release(spark, path, {"a": good}, ("a",))
    with pytest.raises(KeyError):
        readers.released(spark, path, "none")


def test_region(spark):
    cells = [(i, f"d{i % 4}", "t1" if i % 3 else "t2", "A" if i < 90 else "B", i % 5, None if i < 8 else "x") for i in range(120)] + [(500 + i, "d9", "rare", "A", 1, "y") for i in range(3)]
    cells = spark.createDataFrame(cells, "cell_id long, donor_id string, cell_type string, region string, braak int, sex string")
    counts = spark.createDataFrame([(i, g, float(i + 1)) for i in range(120) for g in ("g1", "g2")], "cell_id long, gene string, value double")
    scores = spark.createDataFrame([("d0", "A", 0.5, 7), ("d0", "B", 0.9, 7), ("d1", "A", 0.1, 7)], "donor_id string, region string, CPS_Global double, braak int")
    kept, sub, donors = prep.load_region(cells, counts, "A", scores, 40, 10, 3)
    rows = kept.collect()
    groups = {}
    for r in rows:
        groups[r.donor_id, r.cell_type] = groups.get((r.donor_id, r.cell_type), 0) + 1
    assert {r.cell_type for r in rows} == {"t1", "t2"} and all(r.region == "A" for r in rows) and len(groups) == 8 and sum(groups.values()) <= 40 + 4
    assert {(r.donor_id, r.CPS_Global) for r in rows} == {("d0", 0.5), ("d1", 0.1), ("d2", None), ("d3", None)} and {r.braak_cps for r in rows} == {7, None}
    assert sub.count() == 2 * len(rows)
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    first = {r.donor_id: r for r in donors.collect()}
    assert set(first) == {"d0", "d1", "d2", "d3"} and all(first[d].braak == min((r.cell_id, r.braak) for r in rows if r.donor_id == d)[1] for d in first)
    whole, _, _ = prep.load_region(cells, counts, "A", None, 1000, 1, 3)
    assert whole.count() == 93
    with pytest.raises(ValueError):
        prep.load_region(cells, counts, "A", scores.union(scores), 40, 10)
    with pytest.raises(ValueError):
        prep.load_region(cells, counts, "A", max_cells=10**9)
