"""The text vector cache, the trained linear map, and differences over blocks."""

import hashlib
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.operators import contrast, infer, vectors
from donorlake.sources import shared


def _texts(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


def test_vectors_are_kept(spark):
    cache = vectors.Cache(spark, shared.folder(spark, "test-vectors"), 16, 2)
    assert cache.rows().count() == 0
    assert cache.add(_texts(spark, ["one two", "one two", None, "three"])) == 3
    assert cache.add(_texts(spark, ["three", "", "one two"])) == 0  # a null text is an empty one
    assert cache.add(_texts(spark, ["three", "four"])) == 1
    got = {r.text: np.array(r.vector) for r in cache.vectors(_texts(spark, ["one two", "ONE, two!", None, "five"])).collect()}
    assert np.allclose(got["one two"], got["ONE, two!"]) and np.allclose(got[None], 0) and np.linalg.norm(got["five"]) == pytest.approx(1)
    want = np.zeros(16)
    for w in ("one", "two"):
        h = int(hashlib.md5(f"{w}|2".encode()).hexdigest()[:8], 16)
        want[h % 16] += 1 if h // 16 % 2 == 0 else -1
    assert np.allclose(got["one two"], want / np.linalg.norm(want))
    assert cache.rows().count() == cache.rows().select("digest").distinct().count() == 6
    with pytest.raises(ValueError):
        vectors.Cache(spark, cache.path, 8, 2).rows()
    mean = vectors.mean_vectors(cache.vectors(_texts(spark, ["one two", "five"])).withColumn("g", F.lit("a")), "g").first()
    assert np.allclose(mean.vector, (got["one two"] + got["five"]) / 2)


def test_text_vectors_of_any_letters_equal_their_sql(spark, tmp_path):
    """A dotted capital I stays in its word, as in the SQL's lower()."""
    import duckdb

    from donorlake.plans import catalogue

    rows = [(1, "ISTANBUL \u0130stanbul K\u0130TAP", "tr", "a"), (2, "\u212aelvin \u03a3\u03a3 \u00c5", "el", "a"), (3, None, None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("text_vectors", "mean_text_vectors"):
        want = duckdb.sql(catalogue.ORACLES[name])
        got = catalogue.QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_words_that_cancel_out_equal_their_sql(spark, tmp_path):
    """A text whose words cancel each other out has no direction: NaN at their place, which its source's mean has too."""
    import duckdb

    from donorlake.plans import catalogue

    at = {}
    for k in range(500):
        h = int(hashlib.md5(f"w{k}|0".encode()).hexdigest()[:8], 16)
        at.setdefault((h % 32, h // 32 % 2), f"w{k}")
    place = next(p for p in range(32) if (p, 0) in at and (p, 1) in at)
    gone = f"{at[place, 0]} {at[place, 1]}"
    rows = [(1, gone, "en", "a"), (2, f"{gone} other words", "en", "a"), (3, "other", "en", "b"), (4, None, None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("text_vectors", "mean_text_vectors"):
        want = duckdb.sql(catalogue.ORACLES[name])
        got = catalogue.QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
        assert sum(np.isnan(r.value) for r in got) == 1


def test_two_writers(spark):
    """Both read the same state and project the same text; the second to publish leaves it out."""
    path = shared.folder(spark, "test-vectors")
    both, errors = threading.Barrier(2, timeout=60), []

    class Slow(vectors.Cache):
        first = True

        def _publish(self, version, batches):
            if self.first:
                self.first = False
                both.wait()
            return super()._publish(version, batches)

    def write(rows):
        try:
            Slow(spark, path, 8).add(_texts(spark, rows))
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=write, args=(r,)) for r in (["same", "left"], ["same", "right"])]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    rows = vectors.Cache(spark, path, 8).rows()
    assert rows.count() == rows.select("digest").distinct().count() == 3


def test_trained_map(spark):
    rng = np.random.default_rng(7)
    n, p, d = 120, 9, 4
    label = np.arange(n) % 3
    x = np.where(rng.random((n, p)) < 0.6, rng.random((n, p)), 0)
    x[np.arange(n), label] += 2
    x[5] = 0  # a cell without features
    bank = rng.normal(size=(3, d))
    expr = spark.createDataFrame([(int(i), f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(0, "unknown", 5.0)], "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(i, int(label[i])) for i in range(n)], "cell_id long, label int")
    rows = contrast.cell_rows(expr, cells, [f"g{j}" for j in range(p)]).repartition(5)
    got = contrast.train(rows, bank, p, seed=2, rounds=8, rate=0.3)
    assert len(got.history) > 3 and all(b < a for a, b in zip(got.history, got.history[1:]))

    unit = bank / np.linalg.norm(bank, axis=1, keepdims=True)
    w, c = contrast.start(d, p, 2)
    rate, (loss, dw, dc) = 0.3, contrast.loss_and_gradient(x, label, unit, w, c, 0.07)
    history = [loss / n]
    for _ in range(8):
        new_w, new_c = w - rate * dw / n, c - rate * dc / n
        new = contrast.loss_and_gradient(x, label, unit, new_w, new_c, 0.07)
        if not new[0] < loss:
            rate /= 2
            continue
        w, c, (loss, dw, dc) = new_w, new_c, new
        history.append(loss / n)
    assert np.allclose(got.weights, w, atol=1e-6) and np.allclose(got.bias, c, atol=1e-6) and np.allclose(got.history, history, atol=1e-6)

    eps, k = 1e-6, (1, 2)  # the gradient against a difference
    up = w.copy()
    up[k] += eps
    a, b = contrast.loss_and_gradient(x, label, unit, w, c, 0.07), contrast.loss_and_gradient(x, label, unit, up, c, 0.07)
    assert (b[0] - a[0]) / eps == pytest.approx(a[1][k], rel=1e-3, abs=1e-2)

    z = x @ w.T + c
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    for r in contrast.encoded(rows, got).collect():
        assert np.allclose(r.embedding, z[r.cell_id], atol=1e-6)
    none = contrast.train(rows.limit(0), bank, p, seed=2)
    assert np.allclose(none.weights, contrast.start(d, p, 2)[0])


def test_arms_share_their_passes(spark, monkeypatch):
    """All arms read the cells in the same jobs, and each gets what it would get alone."""
    rng = np.random.default_rng(8)
    n, p, kinds = 90, 6, ["a", "b", "c"]
    x = np.where(rng.random((n, p)) < 0.6, rng.random((n, p)), 0)
    x[np.arange(n), np.arange(n) % 3] += 2
    expr = spark.createDataFrame([(int(i), f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(i, f"d{i % 7}", kinds[i % 3]) for i in range(n)], "cell_id long, donor_id string, cell_type string").repartition(4)
    donors = spark.createDataFrame([(f"d{i}", i > 4) for i in range(7)], "donor_id string, is_test boolean")
    banks = {"one": {k: rng.normal(size=4) for k in kinds}, "two": {k: rng.normal(size=3) for k in kinds}, "lacks": {k: rng.normal(size=4) for k in "ab"}}
    calls, added = [], contrast.added_up
    monkeypatch.setattr(contrast, "added_up", lambda *a: calls.append(1) or added(*a))
    genes = [f"g{j}" for j in range(p)]
    blocks, made = contrast.donor_block(expr, cells, donors, genes, banks, seed=2, rounds=3)
    assert len(calls) == 4  # the start and three rounds, whatever the number of arms
    rows = contrast.cell_rows(expr, cells.join(donors, "donor_id"), genes)
    for arm, bank in banks.items():
        labels = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(bank))], "cell_type string, label int")
        alone = contrast.train(rows.where("not is_test").join(labels, "cell_type"), np.array([bank[k] for k in sorted(bank)]), p, 2, 3)
        assert np.allclose(made[arm].weights, alone.weights) and np.allclose(made[arm].bias, alone.bias) and np.allclose(made[arm].history, alone.history)
        want = {r.donor_id: np.array(r.vector) for r in vectors.mean_vectors(contrast.encoded(rows.select("donor_id", "at", "x"), alone).withColumnRenamed("embedding", "vector"), "donor_id").collect()}
        got = {(r.donor_id, int(r.feature)): r.value for r in blocks[arm].collect()}
        assert len(got) == 7 * len(bank[min(bank)]) and all(got[d, k] == pytest.approx(v) for d, m in want.items() for k, v in enumerate(m))
    monkeypatch.setattr(contrast, "HELD", 1)  # a donor at a time
    few = contrast.donor_means(rows, list(made.values())).collect()
    assert sorted(r.donor_id for r in few) == [f"d{i}" for i in range(7)]
    assert all(np.allclose(r["mean"][:4], [b.value for b in sorted(blocks["one"].where(F.col("donor_id") == r.donor_id).collect(), key=lambda b: int(b.feature))]) for r in few)


def test_differences_over_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(b, f"{b}{i}", float(i), float(i) + rng.normal() * 0.1, float(rng.normal())) for b in ("x", "y") for i in range(12)] + [("z", "z1", 1.0, 1.0, 2.0)]
    got = {r.block: r for r in infer.block_differences(spark.createDataFrame(rows, "block string, donor_id string, observed_a double, predicted_a double, predicted_b double"), 40, 3).collect()}
    assert set(got) == {"x", "y", "z", "all"} and got["z"].delta_rho is None and got["z"].n_valid == 0
    assert got["all"].delta_rho == pytest.approx((got["x"].delta_rho + got["y"].delta_rho) / 2) and got["all"].n == 25
    for r in (got["x"], got["y"], got["all"]):
        assert r.ci_low <= r.mean_delta <= r.ci_high and r.n_valid == 40 and r.ci_low > 0


def test_threads_ship_the_package_once(spark, monkeypatch):
    """Threads that come together add one file; each adding its own under the same name was an error."""
    added, both = [], threading.Barrier(4, timeout=60)
    monkeypatch.setattr(shared, "_shipped", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: (time.sleep(0.2), added.append(path)))

    def come():
        both.wait()
        shared.ship(spark)

    threads = [threading.Thread(target=come) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(added) == 1
