"""The arm matrix, pooled comparisons, and retrieval by phrase, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake import schema
from donorlake.operators import arms, gram, infer, prep, report, retrieve
from tests.conftest import SF


def _fold(spark, n=24, p=40, signal=0.0, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    x = rng.normal(size=(n, p))
    x[:, 0] += signal * y
    x[:, 1] = 3.0  # constant
    donors = [(f"d{i:02d}", bool(i % 4 == 0), float(y[i])) for i in range(n)]
    long = [(f"d{i:02d}", f"f{j}", float(x[i, j])) for i in range(n) for j in range(p)]
    return spark.createDataFrame(donors, arms.FOLD), spark.createDataFrame(long, "donor_id string, feature string, value double"), x, y


def test_ridge_over_donors_equals_ridge_over_features(spark):
    donors, long, x, y = _fold(spark)
    test = np.arange(len(y)) % 4 == 0
    m, s = x[~test].mean(0), x[~test].std(0)
    z = (x - m) / np.where(s < 1e-12, 1, s)
    w = np.linalg.solve(z[~test].T @ z[~test] + np.eye(z.shape[1]), z[~test].T @ (y[~test] - y[~test].mean()))
    got = {r.donor_id: r.predicted for r in arms.ridge_arm(long, donors).collect()}
    assert len(got) == test.sum()
    for i in np.where(test)[0]:
        assert got[f"d{i:02d}"] == pytest.approx(y[~test].mean() + z[i] @ w, abs=1e-8)


def test_components_equal_an_eigendecomposition(spark):
    donors, long, x, y = _fold(spark, p=6)
    test = np.arange(len(y)) % 4 == 0
    c = x - x[~test].mean(0)
    values, load = np.linalg.eigh(c[~test].T @ c[~test])
    scores = c @ load[:, np.argsort(-values)[:5]]  # the constant feature has no variance
    z = scores / scores[~test].std(0)
    w = np.linalg.solve(z[~test].T @ z[~test] + np.eye(5), z[~test].T @ (y[~test] - y[~test].mean()))
    got = {r.donor_id: r.predicted for r in arms.pca_ridge_arm(long, donors).collect()}
    for i in np.where(test)[0]:
        assert got[f"d{i:02d}"] == pytest.approx(y[~test].mean() + z[i] @ w, abs=1e-8)


def test_products_of_many_features(spark):
    donors, _, _, y = _fold(spark, n=37, p=2)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((37, 1500)) < 0.1, rng.normal(size=(37, 1500)), 0)
    long = spark.createDataFrame([(f"d{i:02d}", f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [("stranger", "f0", 9.0), ("d00", None, 1.0), ("d00", "f1", None)], "donor_id string, feature string, value double")
    order = sorted(range(37), key=lambda i: (i % 4 == 0, i))
    train = order[: sum(i % 4 != 0 for i in range(37))]
    for scale in (True, False):
        rows, k = arms.products(long, donors, scale)
        d = x[train].std(0) if scale else np.ones(1500)
        z = (x - x[train].mean(0)) / np.where(d < 1e-12, 1, d)
        assert [r[0] for r in rows] == [f"d{i:02d}" for i in order] and np.allclose(k, z[order] @ z[train].T)
    plan = gram.placed(long, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        arms.products(long, donors.union(donors.limit(1)))
    assert arms.products(long, donors.where("is_test"))[1].shape == (10, 0)
    assert np.allclose(arms.products(long.limit(0), donors)[1], 0)


@pytest.mark.parametrize("most", [None, 4])
def test_a_source_cohort_is_read_out_on_another(spark, most):
    donors, long, x, y = _fold(spark, n=28, p=30, signal=2.0)
    others, far, u, v = _fold(spark, n=20, p=36, signal=2.0, seed=2)
    far = far.where("feature <> 'f5'")  # the target lacks one, and has six of its own
    u = u[:, :30].copy()
    u[:, 5] = 0
    train = np.arange(28) % 4 != 0
    m = x[train].mean(0)
    if most is None:
        s = x[train].std(0)
        load = np.diag(1 / np.where(s < 1e-12, 1, s))
    else:
        values, vectors = np.linalg.eigh((x[train] - m).T @ (x[train] - m))
        load = vectors[:, np.argsort(-values)[:most]]
    a, b = (x - m) @ load, (u - m) @ load

    def ridge(fx, fy, to):
        mean, sd = fx.mean(0), fx.std(0)
        sd = np.where(sd < 1e-12, 1, sd)
        z = (fx - mean) / sd
        w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (fy - fy.mean()))
        return fy.mean() + (to - mean) / sd @ w

    got, model = arms.transfer((long, donors), (far, others), most)
    rows = {(r["mode"], r["eval_subset"], r.donor_id): r.predicted for r in got.collect()}
    strict = ridge(a[train], y[train], b)
    test = np.arange(20) % 4 == 0
    refit = ridge(b[~test] if most else u[~test], v[~test], b if most else u)
    assert len(rows) == 20 + 2 * test.sum()
    for i in range(20):
        assert rows["strict", "all_donors", f"d{i:02d}"] == pytest.approx(strict[i], abs=1e-7)
        if test[i]:
            assert rows["strict", "test_donors", f"d{i:02d}"] == pytest.approx(strict[i], abs=1e-7)
            assert rows["refit", "test_donors", f"d{i:02d}"] == pytest.approx(refit[i], abs=1e-7)
    stored = arms.ridge_arm(long, donors) if most is None else arms.pca_ridge_arm(long, donors, most=most)
    gap = arms.verification_gap(model, (long, donors), stored).first()
    assert gap.n == 7 and gap.max_gap < 1e-7
    assert arms.verification_gap(model, (long, donors), stored.withColumn("predicted", F.col("predicted") + 1)).first().max_gap == pytest.approx(1)
    assert arms.verification_gap(model, (long, donors), stored.limit(2)).first().max_gap is None
    figures = {(r["mode"], r.eval_subset): r for r in arms.transfer_report("X", got).collect()}
    assert figures["strict", "all_donors"].n == 20 and figures["strict", "all_donors"].rho is not None
    few, _ = arms.transfer((long, donors), (far, others.where("not is_test or donor_id = 'd00'")), most)
    assert {r["mode"] for r in few.select("mode").distinct().collect()} == {"strict"}
    with pytest.raises(ValueError):
        arms.transfer((long, donors.where("is_test")), (far, others), most)


def test_a_tie_is_a_tie_on_both_sides(spark):
    """Differences that are 0 but for rounding count on both sides, so p is 1."""
    rng = np.random.default_rng(6)
    rows = [(s, f"d{i}", float(i % 7), p := float(rng.normal()), p * (1 + 1e-12)) for s in range(3) for i in range(15)]
    got = infer.clustered_bootstrap(spark.createDataFrame(rows, "seed int, donor_id string, observed_a double, predicted_a double, predicted_b double"), 30, 2).first()
    assert got.p_emp == 1.0 and got.ci_low == got.ci_high == 0.0


def test_a_signal_is_found_and_goes_under_permuted_labels(spark):
    donors, long, _, y = _fold(spark, n=48, p=3, signal=6.0)
    got = arms.run_fold(donors, {"B2": long}, ["B2", "N1"], seed=5).toPandas()
    rho = {a: g.observed.rank().corr(g.predicted.rank()) for a, g in got.groupby("arm")}
    assert rho["B2"] > 0.8 and abs(rho["N1"]) < rho["B2"]
    truth = {f"d{i:02d}": v for i, v in enumerate(y)}
    assert all(abs(truth[d] - o) < 1e-12 for d, o in zip(got.donor_id, got.observed))


def test_arguments_of_a_fold(spark):
    for given, kw in ((["X9"], {}), (["T2"], {}), (["N1"], {"has_target": False})):
        with pytest.raises(ValueError):
            arms.check_arms(given, **kw)
    arms.check_arms(["T2", "B0"], captioned=["T2"])
    donors, long, *_ = _fold(spark)
    with pytest.raises(ValueError):
        arms.run_fold(donors.where("is_test"), {"B0": long}, ["B0"])
    with pytest.raises(ValueError):
        arms.run_fold(donors, {}, ["B0"])
    few = donors.where("is_test or donor_id < 'd05'")
    assert arms.run_fold(few, {"B0": long}, ["B0"]).isEmpty()


def _runs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for seed in range(2):
        for d in range(20):
            o = float(d)
            rows += [("c", "T2", seed, f"d{d}", o, o + rng.normal() * 0.1), ("c", "B2", seed, f"d{d}", o, float(rng.normal())), ("c", "T1", seed, f"d{d}", o, float(rng.normal())), ("c", "T0", seed, f"d{d}", o, float(rng.normal()))]
    return spark.createDataFrame(rows, "cohort string, arm string, seed int, donor_id string, observed double, predicted double")


def test_pooled_comparisons(spark):
    got = {(r.candidate, r.reference): r for r in infer.pooled_comparisons(_runs(spark), "c", 40, 7).collect()}
    assert set(got) == {("T2", "B2"), ("T2", "T1"), ("T0", "B2"), ("T0", "T1"), ("T2", "T0")}
    best = got["T2", "B2"]
    assert best.role == "primary" and best.q_fdr is None and best.delta_rho > 0.5 and best.ci_low > 0 and best.n_donors == 20
    other = got["T2", "T0"]
    assert other.role == "secondary" and other.q_fdr >= other.p_emp
    empty = infer.pooled_comparisons(_runs(spark).where("false"), "c", 40, 7)
    assert empty.isEmpty()


def test_strict_pairs(spark):
    runs = _runs(spark).where("seed = 0")
    a, b = runs.where("arm = 'T2'"), runs.where("arm = 'B2'")
    got = infer.paired_difference(a, b, 30, 1).first()
    assert got.n == 20 and got.delta_rho > 0.5 and got.ci_low <= got.mean_delta <= got.ci_high
    for bad in (b.where("donor_id <> 'd1'"), b.union(b.limit(1)), b.withColumn("observed", F.col("observed") + 1), b.withColumn("predicted", F.lit(1.0))):
        with pytest.raises(ValueError):
            infer.paired_difference(a, bad, 30, 1)


def test_go_needs_both_encoders(spark):
    rows = [("x", 0.6, 0.2, 0.1), ("y", 0.5, 0.15, 0.1)]
    cols = "encoder string, rho double, gap double, trajectory double"
    assert infer.go_gate(spark.createDataFrame(rows, cols)).first().go == "GO"
    assert infer.go_gate(spark.createDataFrame([rows[0], ("y", 0.49, 0.15, 0.1)], cols)).first().go == "NO_GO"
    assert infer.go_gate(spark.createDataFrame([rows[0], ("y", None, 0.15, 0.1)], cols)).first().go == "NO_GO"


def test_phrases_and_aliases(spark):
    docs = spark.createDataFrame([(1, "Beta cells.", "Of the endocrine pancreas", "m"), (2, "cells beta", None, None), (3, None, "INS1 and beta  cells", "m")], "doc_id int, title string, abstract string, mesh string")
    asked = spark.createDataFrame([("q", "beta cells"), ("q", "no such"), ("q", "..")], "k string, phrase string")
    got = {(r.phrase, r.doc_id) for r in retrieve.phrase_hits(docs, asked, ["k"]).collect()}
    assert got == {("beta cells", 1), ("beta cells", 3)}
    terms = F.array(F.array(F.lit("ins"), F.lit("ins1")), F.array(F.lit("gcg")))
    assert [r[0] for r in docs.orderBy("doc_id").select(retrieve.alias_coverage(retrieve.body(docs), terms)).collect()] == [0.0, 0.0, 0.5]


@pytest.mark.parametrize("most", [200_000, 0])
def test_phrases_are_found_without_an_index(spark, monkeypatch, most):
    """Phrases of one word to five, at a text's end, twice in a text and asked for twice; texts are not shuffled for few phrases."""
    monkeypatch.setattr(retrieve, "MOST_PHRASES", most)
    docs = spark.createDataFrame([(1, "a b c d e", "a b c", None), (2, "c d", None, "e"), (3, "x a b", "", ""), (4, None, None, None)], "doc_id int, title string, abstract string, mesh string")
    asked = spark.createDataFrame([(0, "a b c"), (1, "A-b c!"), (2, "a b c d e"), (3, "a b c d x"), (4, "e"), (5, "d e"), (6, "a b"), (6, "a b"), (7, "")], "k int, phrase string")
    found = retrieve.phrase_hits(docs, asked, ["k"])
    assert sorted((r.k, r.doc_id) for r in found.collect()) == [(0, 1), (1, 1), (2, 1), (4, 1), (4, 2), (5, 1), (5, 2), (6, 1), (6, 1), (6, 3), (6, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert most == 0 or plan.count("LogicalRDD") == 3  # phrases for the answer, for the lookup; texts once


def test_transfer_reads_counts_once(spark, monkeypatch):
    """Both cohorts' counts are normalised in one pass, and what follows reads donor means."""
    from donorlake.operators import joins
    from donorlake.plans import cohorts

    made, logged = [], joins.logged
    monkeypatch.setattr(joins, "logged", lambda rows: made.append(rows) or logged(rows))
    report, gap, cover = cohorts._transferred(spark, SF, ["B1"])["B1"]
    assert len(made) == 1
    assert not any("lineitem" in f for t in (report, gap, cover) for f in t.inputFiles())


def test_term_counts_need_no_index(spark):
    docs = spark.createDataFrame([(1, "Beta beta cells.", "of", None), (2, None, "cells BETA", "m"), (3, "", None, None)], "doc_id int, title string, abstract string, mesh string")
    rows, n, mean = retrieve.term_counts(docs, ["beta", "of", "none", "beta"])
    assert sorted(map(tuple, rows.select("doc_id", "term", "tf", "len").collect())) == [(1, "beta", 2, 4), (1, "of", 1, 4), (2, "beta", 1, 3)]
    assert (n, mean) == (3, 3.5)
    for bad in (docs.union(docs.limit(1)), docs.withColumn("doc_id", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            retrieve.term_counts(bad, ["beta"])


def test_excerpts_stop_once_the_budget_is_used(spark):
    docs = spark.createDataFrame([("g", i, f"t{i}", "x" * 50) for i in range(5)] + [("h", 1, None, None)], "g string, i int, title string, abstract string")
    got = {r.g: r.excerpt for r in retrieve.excerpts(docs, ["i"], "g", most_docs=4, most_chars=20, most_abstract=10).collect()}
    assert got["g"] == "- t0. xxxxxxxxxx\n- t1. xxxxxxxxxx"
    assert got["h"] == "- ."


def test_observation_tables(spark):
    raw = spark.createDataFrame([(1, "a", "x/y")], "`Donor ID` int, Subclass string, `Race/Other` string")
    assert schema.normalize_obs(raw, "Donor ID", "Subclass", "r", {"Race/Other": "race", "none": "n"}).select("donor_id", "cell_type", "race", "region").first() == ("1", "a", "x/y", "r")
    assert schema.sanitised(raw.withColumn("l", F.array(F.lit(1)))).columns == ["Donor ID", "Subclass", "Race_Other", "l"]
    with pytest.raises(ValueError):
        schema.keep_and_rename(raw, ["absent=a"])
    one = spark.createDataFrame([("lo",), ("?",), (None,)], "l string")
    assert [tuple(r) for r in one.select(report.ordinal_map(F.col("l"), {"lo": 1.0}), report.level_ids(F.col("l"), ["hi", "lo"])).collect()] == [(1.0, 1), (None, -1), (None, -1)]
    cells = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "donor_id string, cell_id int")
    got = prep.bags(cells, 1, 3).groupBy("donor_id").agg(F.count(F.lit(1)).alias("slots"), F.count("cell_id").alias("cells"))
    assert sorted(map(tuple, got.collect())) == [("a", 3, 3), ("b", 3, 1)]


def test_resamples_by_weights_equal_repeated_rows(spark, monkeypatch):
    """Ties, nulls, NaN, groups that few donors have, more replicates and draws than stand side by side; rows are never repeated."""
    rng = np.random.default_rng(4)
    odd = lambda v: None if v == 3 else float("nan") if v == 4 else float(v)
    rows = [(g, s, f"d{i}", float(rng.integers(0, 9)), odd(rng.integers(0, 6)), float(rng.normal())) for g in ("x", "y") for s in range(2) for i in range(30) if (i + s) % 3 or g == "x"]
    rows += [("x", 2, "d1", 1.0, 2.0, 3.0), ("x", 2, "d2", 2.0, 1.0, 3.5)]
    pairs = spark.createDataFrame(rows, "g string, seed int, donor_id string, observed_a double, predicted_a double, predicted_b double")
    monkeypatch.setattr(infer, "REPLICATES", 4)
    monkeypatch.setattr(infer, "DRAWS", 7)
    got = {(r.g, r.seed, r.rep): r.delta for r in infer.resampled(pairs, 10, 5, ("g",), ("seed",)).collect()}
    chosen = infer.draws(pairs.select("g", "donor_id").distinct(), 10, 5, "g").join(pairs, ["g", "donor_id"])
    want = {(r.g, r.seed, r.rep): r.delta for r in infer.delta_rho(chosen, "g", "rep", "seed").where("delta is not null").collect()}
    assert got.keys() == want.keys() and len(want) >= 40 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    plan = infer.resampled(pairs, 10, 5, ("g",), ("seed",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 1  # the donors' numbers alone
    got = infer.pooled_comparisons(pairs.selectExpr("g cohort", "'T2' arm", "seed", "donor_id", "observed_a observed", "predicted_a predicted").union(pairs.selectExpr("g", "'B2'", "seed", "donor_id", "observed_a", "predicted_b")), "x", 3, 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("(strategy=merge)") >= 3  # a table of donors is never broadcast
