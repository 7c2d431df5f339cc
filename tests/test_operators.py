"""Invariance, algebra and rules of the cohort operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.functions import scalar
from donorlake.operators import captions, features, infer, joins, markers, prep, readout, report, retrieve, stats, tokens


def cells(spark, n=60, genes=30):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.4, (n, genes))
    kind = np.arange(n) % 3
    for k in range(3):
        x[kind == k, 10 * k : 10 * k + 10] += 5
    obs = spark.createDataFrame([(i, f"d{i % 6}", "TBM"[kind[i]], f"r{i % 2}") for i in range(n)], "cell_id long, donor_id string, cell_type string, region string")
    expr = spark.createDataFrame([(int(i), f"g{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell_id long, gene string, value double")
    return expr, obs, x, kind


@pytest.mark.parametrize("n", [9, 84, 111, 127])
def test_split_sizes_and_order(spark, n):
    donors = spark.createDataFrame([(f"d{i}",) for i in range(n)], "donor_id string")
    a = {r.donor_id for r in prep.donor_split(donors, 3).where("is_test").collect()}
    b = {r.donor_id for r in prep.donor_split(donors.orderBy(F.desc("donor_id")), 3).where("is_test").collect()}
    assert a == b and len(a) == max(1, round(n / 4))


def test_split_rejects(spark):
    one = spark.createDataFrame([("a",), ("a",)], "donor_id string")
    with pytest.raises(ValueError):
        prep.donor_split(one, 1)
    with pytest.raises(ValueError):
        prep.donor_split(one, 1, 1.0)
    with pytest.raises(ValueError):
        prep.donor_split(spark.createDataFrame([("a",), (None,)], "donor_id string"), 1)
    with pytest.raises(ValueError):
        prep.donors_from_mask(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "donor_id string, is_test boolean"))


def test_validation(spark):
    good = spark.createDataFrame([(1, "a", 3.0)], "cell_id long, gene string, value double")
    assert prep.validate_counts(good).count() == 1
    for bad in (0.5, -1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            prep.validate_counts(good.union(spark.createDataFrame([(2, "b", bad)], good.schema)))
    with pytest.raises(ValueError):
        prep.validate_counts(good, "log1p_hvg")


def test_fold_looks_at_train_only(spark):
    expr, obs, *_ = cells(spark)
    split = prep.donor_split(obs, 1)
    test_cells = [r.cell_id for r in obs.join(split.where("is_test"), "donor_id").collect()]
    changed = expr.withColumn("value", F.when(F.col("cell_id").isin(test_cells), F.col("value") * 7 + 1).otherwise(F.col("value")))
    folds = [prep.build_fold(e, obs, 1, min_genes=2, min_cells=3, n_hvg=8) for e in (expr, changed)]
    train = [sorted((r.cell_id, r.gene, round(r.value, 9)) for r in f["expr"].where(~F.col("cell_id").isin(test_cells)).collect()) for f in folds]
    assert train[0] == train[1] and folds[0]["genes"].count() == 8
    with pytest.raises(ValueError):
        prep.build_fold(expr, obs, 1, min_genes=10**6)
    with pytest.raises(ValueError):
        prep.build_fold(expr.union(expr.limit(1)), obs, 1)


def test_normalisation_uses_the_full_library(spark):
    expr, _, x, _ = cells(spark)
    got = {(r.cell_id, r.gene): r.value for r in prep.normalize_log1p(expr).collect()}
    for i, j in [(0, 3), (7, 15)]:
        if x[i, j]:
            assert abs(got[i, f"g{j:02d}"] - np.log1p(x[i, j] * 1e4 / x[i].sum())) < 1e-9


def test_markers_recover_blocks(spark):
    expr, obs, x, kind = cells(spark)
    diff = {(r["class"], r.gene): r.diff for r in markers.mean_difference(expr, obs).collect()}
    z = {(r["class"], r.gene): r.z for r in markers.rank_sum(expr, obs).collect()}
    for k, c in enumerate("TBM"):
        inside = kind == k
        for j in range(30):
            assert abs(diff[c, f"g{j:02d}"] - (x[inside, j].mean() - x[~inside, j].mean())) < 1e-9
        best = sorted((g for d, g in z if d == c), key=lambda g, c=c: -z[c, g])[:10]
        assert best == sorted(best, key=lambda g, c=c: -z[c, g]) and {int(g[1:]) // 10 for g in best} == {k}


def test_precision_drops_excluded_first(spark):
    ranked = spark.createDataFrame([("A", f"g{i}", float(-i)) for i in range(12)], "class string, gene string, score double")
    ref = spark.createDataFrame([("A", f"g{i}") for i in (0, 1, 10, 11)], "class string, gene string")
    out = spark.createDataFrame([("A", "g0")], "class string, gene string")
    r = markers.precision_at_k(ranked, ref, 10, out).first()
    assert (r.precision, r.ceiling, r.evaluable) == (0.2, 0.3, True)


def test_spearman_guards(spark):
    rows = spark.createDataFrame([("a", float(i), float(-i)) for i in range(5)] + [("b", 1.0, float(i)) for i in range(5)] + [("c", 1.0, 2.0), ("a", None, 1.0)], "k string, x double, y double")
    got = {r.k: (r.rho, r.n) for r in stats.spearman(rows, "x", "y", "k").collect()}
    assert abs(got["a"][0] + 1) < 1e-12 and got["a"][1] == 5 and got["b"] == (None, 5) and got["c"] == (None, 1)


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", 0.001), ("b", 0.01), ("c", 0.04), ("d", 0.5), ("e", None)], "id string, p double")
    q = {r.id: r.q for r in stats.benjamini_hochberg(rows, "p").collect()}
    assert q["e"] is None and np.allclose([q[k] for k in "abcd"], [0.004, 0.02, 0.04 * 4 / 3, 0.5])


def test_ridge_matches_closed_form_and_units(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4))
    y = x[:, 0] - x[:, 1] + rng.normal(size=20) * 0.1
    names = [f"x{k}" for k in range(4)]

    def run(scale):
        rows = [(f"d{i}", bool(i >= 14), float(y[i]), *(float(v) for v in x[i] * scale)) for i in range(20)]
        df = spark.createDataFrame(rows, "donor_id string, is_test boolean, y double, " + ", ".join(f"{n} double" for n in names))
        return df, {r.donor_id: r.predicted for r in readout.ridge_predictions(df, names, "y", 2.0).collect()}

    df, got = run(np.ones(4))
    _, scaled = run(np.array([1e3, 1e-3, 5, 1]))
    tr = x[:14]
    z = (tr - tr.mean(0)) / tr.std(0)
    w = np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (y[:14] - y[:14].mean()))
    want = (x[14:] - tr.mean(0)) / tr.std(0) @ w + y[:14].mean()
    assert np.allclose([got[f"d{i}"] for i in range(14, 20)], want, atol=1e-9) and all(abs(got[k] - scaled[k]) < 1e-8 for k in got)
    assert readout.ridge_predictions(df.limit(6), names, "y").count() == 0
    fit = readout.pca_fit(df.where("not is_test"), names, 2)
    value = np.linalg.svd(tr - tr.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(np.array(fit["loadings"]) @ value.T), np.eye(2), atol=1e-8)
    line = df.withColumn("y", F.col("x0") * 3)
    assert readout.trajectory(line, ["x0"], "y").first().rho == pytest.approx(1.0)
    nulls = readout.readout_null(df, names, infer.permuted(df.where("not is_test").select("donor_id", "y"), "donor_id", "y", 3, 5).withColumnRenamed("y", "value"), "y").collect()
    assert len(nulls) == 3
    perm = {(r.rep, r.donor_id): r.y for r in infer.permuted(df.where("not is_test").select("donor_id", "y"), "donor_id", "y", 3, 5).collect()}
    yp = np.array([perm[0, f"d{i}"] for i in range(14)])
    wp = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (yp - yp.mean()))
    pp = (x[14:] - tr.mean(0)) / tr.std(0) @ wp + yp.mean()
    rank = lambda v: np.argsort(np.argsort(v))
    assert {r.rep: r.rho for r in nulls}[0] == pytest.approx(np.corrcoef(rank(pp), rank(y[14:]))[0, 1])


def test_strict_transfer_ignores_target_outcomes(spark):
    rows = [(f"s{i}", i >= 8, float(i), float(i % 3)) for i in range(12)]
    source = spark.createDataFrame(rows, "donor_id string, is_test boolean, y double, a double").withColumn("b", F.col("y") / 2)
    target = spark.createDataFrame([(f"t{i}", i >= 6, float(-i), float(i % 3)) for i in range(10)], "donor_id string, is_test boolean, y double, a double")
    other = target.withColumn("y", F.col("y") * 9)
    strict = [{r.donor_id: r.predicted for r in readout.transfer(source, t, ["a", "b"], "y").where("mode = 'strict'").collect()} for t in (target, other)]
    assert strict[0] == strict[1] and len(strict[0]) == 10
    assert readout.vocabulary_coverage(source.select(F.lit("A").alias("v")), target.select(F.when(F.col("a") > 0, "A").otherwise("C").alias("v")), "v").first().coverage == 0.5


def test_permutation_keeps_marginals(spark):
    labels = spark.createDataFrame([(f"d{i}", float(i)) for i in range(8)], "donor_id string, y double")
    got = infer.permuted(labels, "donor_id", "y", 4, 1).collect()
    for rep in range(4):
        assert sorted(r.y for r in got if r.rep == rep) == [float(i) for i in range(8)]


def test_bootstrap_of_opposites(spark):
    rows = [(0, f"d{i}", float(i), float(i), float(-i)) for i in range(12)]
    pairs = spark.createDataFrame(rows, "seed int, donor_id string, observed_a double, predicted_a double, predicted_b double")
    r = infer.clustered_bootstrap(pairs, 30, 1).first()
    assert r.delta_rho == pytest.approx(2) and r.ci_low == pytest.approx(2) and r.n_donors == 12 and r.p_emp == pytest.approx(1 / 31)
    same = infer.clustered_bootstrap(pairs.withColumn("predicted_b", F.col("predicted_a")), 30, 1).first()
    assert same.delta_rho == pytest.approx(0) and same.p_emp == 1.0
    none = infer.clustered_bootstrap(pairs.limit(0), 30, 1).first()
    assert none.delta_rho is None and none.n_donors == 0 and none.ci_low is None


def test_exact_gate(spark):
    rows = [(0.604, 0.558, 0.1, True), (0.65, 0.6, 0.1, True), (0.65, None, 0.1, True), (0.65, float("nan"), 0.1, True), (0.9, 0.1, 0.0, True), (0.9, 0.1, 0.1, None)]
    got = infer.improvement_gate(spark.createDataFrame(rows, "c double, r double, l double, n boolean"), "c", "r", "l", "n")
    assert [r.gate for r in got.collect()] == ["FAIL", "PASS", "NOT_EVALUABLE", "NOT_EVALUABLE", "FAIL", "NOT_EVALUABLE"]


def test_joins_reject(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0)], "donor_id string, observed double, predicted double")
    with pytest.raises(ValueError):
        joins.paired(a, a.withColumn("observed", F.col("observed") + 1), ["donor_id"])
    with pytest.raises(ValueError):
        joins.complete_donor_join(spark.createDataFrame([("y",)], "donor_id string"), a, "observed")
    with pytest.raises(ValueError):
        joins.aligned(spark.createDataFrame([("y", 1)], "donor_id string, o int"), a, "donor_id", "o")
    with pytest.raises(ValueError):
        prep.donor_constant(spark.createDataFrame([("x", 1), ("x", 2)], "donor_id string, v int"), "v")
    assert joins.zero_cells(spark.createDataFrame([(1,), (2,)], "cell_id long"), spark.createDataFrame([(1, "g", 1.0)], "cell_id long, gene string, value double")).first().cell_id == 2


def test_composition_vocabulary(spark):
    _, obs, *_ = cells(spark)
    full = features.composition(obs).groupBy("donor_id").agg(F.sum("fraction").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in full)
    cut = features.composition(obs, spark.createDataFrame([("T",)], "type string"))
    assert cut.where("type <> 'T'").count() == 0
    assert features.composition_region(obs.where("region = 'r0'")).count() == 0


def test_prototypes_are_units(spark):
    _, obs, *_ = cells(spark)
    for r in features.random_prototypes(obs, "cell_type", 16, 3).collect():
        assert abs(np.linalg.norm(r.vector) - 1) < 1e-9


def test_retrieval(spark):
    rows = [(1, "alpha beta gamma", "gene alpha and beta in cells", "x"), (2, "delta", "alias of alpha: alfa1 in neurons", "x"), (3, "off topic", "nothing here", "x"), (4, "beta", "beta cells", "x")]
    art = spark.createDataFrame(rows, "doc_id long, title string, abstract string, mesh string")
    index = retrieve.postings(art)
    m = spark.createDataFrame([("T", 1, "alpha", ["alfa1"], "neuron"), ("T", 2, "beta", [], "neuron")], "type string, pos int, marker string, aliases array<string>, context string")
    queries = retrieve.marker_queries(m)
    assert {r.query_id for r in queries.select("query_id").distinct().collect()} == {"L1", "L3-1", "L3-2", "L4-1"}  # the pair repeats level 1
    found = retrieve.search(index, retrieve.doc_lengths(art), queries, 4, 7.0, ["type", "query_id"])
    hits = {q: {r.doc_id for r in found.where(F.col("query_id") == q).collect()} for q in ("L1", "L3-2", "L4-1")}
    assert hits == {"L1": {1}, "L3-2": {1, 4}, "L4-1": {1, 2}}
    text = spark.createDataFrame([("The T cells grow. It is late! A T cell dies. Done.",)], "t string")
    assert text.select(retrieve.without_sentences(F.col("t"), "T cell").alias("x")).first().x == "It is late! Done."
    docs = spark.createDataFrame([(1, "aaaa"), (2, ""), (3, None), (4, "bbbb"), (5, "cc")], "i int, t string").withColumn("k", F.lit(1))
    assert retrieve.caption_budget(docs, "t", ["i"], 6, "k").first().caption == "aaaa bb"


def test_captions(spark):
    expr, obs, *_ = cells(spark)
    with pytest.raises(ValueError):
        captions.build_captions("own_genes", obs)
    with pytest.raises(ValueError):
        captions.build_captions("type_text", obs)
    with pytest.raises(ValueError):
        captions.build_captions("else", obs)
    text = captions.class_captions(markers.top_n(markers.mean_difference(expr, obs), "diff", 3, "class"), 3)
    genes = text.select("class", captions.caption_genes(F.col("caption")).alias("g")).collect()
    assert all(len(r.g) == 3 for r in genes)
    with pytest.raises(ValueError):
        captions.copied_captions(spark.createDataFrame([("Z",)], "class string"), text)
    assert captions.copied_captions(spark.createDataFrame([("Z",)], "class string"), text, "name").first().caption == "Z"
    no = captions.own_gene_captions(expr.limit(0), obs, 3, False).first().caption
    assert no == "A cell from human blood. Highly expressed genes: none detected."


def test_secret_scan(spark):
    rows = [(1, "token = abcdefghijklmnop1234"), (2, "sha256: " + "a" * 40), (12, "sha256 " + "a" * 40), (3, "x " + "0" * 40), (4, "hf_" + "A1" * 12), (5, "plain"), (6, None), (7, "api_key: '0123456789ab'"), (8, "mytoken = abcdefghijklmnop1234"), (9, "password: short"), (10, "github_pat_" + "b2" * 15), (11, "Client-Secret => " + "z9" * 8)]
    got = {(r.i, r.kind) for r in captions.secret_scan(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert got == {(1, "assignment"), (3, "bare_hex"), (12, "bare_hex"), (4, "hub_token"), (7, "assignment"), (10, "git_token"), (11, "assignment")}


def test_rank_tokens(spark):
    expr = spark.createDataFrame([(1, "a", 4.0), (1, "b", 1.0), (1, "c", 5.0), (1, "zz", 10.0), (2, "zz", 3.0)], "cell_id long, gene string, value double")
    mapping = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C")], "gene string, target string")
    words = spark.createDataFrame([("A", 11, 1.0), ("C", 12, 0.5)], "target string, token long, median double")
    assert [(r.cell_id, r.tokens) for r in tokens.rank_tokens(expr, mapping, words, 3, cls=1, eos=2).collect()] == [(1, [1, 12, 2])]
    sets = tokens.cell_sets(expr, spark.createDataFrame([("a", 5)], "gene string, id int"), 0).where("cell_id = 1").first()
    assert sets.genes[0] == 0 and sets.genes.count(-1) == 3 and 5 in sets.genes


def test_report_helpers(spark):
    levels = report.level_order(spark.createDataFrame([("b 10",), ("b 2",), ("first",), (None,), ("none",)], "l string"), "l", ["first"])
    assert [r.l for r in levels.orderBy("place").collect()] == ["first", "b 2", "b 10", "none"]
    donors = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", None)], "donor_id string, v double")
    assert {r.donor_id: r.bin for r in report.quantile_bins(donors, "v", F.lit(True), [0.5]).collect()} == {"a": "v_q0", "b": "v_q1", "c": "v_q1", "d": "v_q1"}
    assert spark.range(1).select(scalar.phrase(F.lit("a-b (c)")).alias("p")).first().p == '"a b c"'


def test_blocks_and_states(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", i >= 12, float(i), float(i) / 2, float(rng.normal())) for i in range(18)]
    donors = spark.createDataFrame(rows, "donor_id string, is_test boolean, y double, a double, b double")
    got = readout.block_combinations(donors, {"A": ["a"], "B": ["b"]}, [("A",), ("A", "B")], "y")
    assert {r.blocks: r["count"] for r in got.groupBy("blocks").count().collect()} == {"A": 6, "A+B": 6}
    cells_of = spark.createDataFrame([(f"d{i}", "T", [float(i), 1.0]) for i in range(18) for _ in range(3)], "donor_id string, cell_type string, embedding array<double>")
    assert readout.state_rho(cells_of, donors, "y", 2, least_cells=3).first().rho == pytest.approx(1)
    assert readout.state_rho(cells_of, donors, "y", 2, least_cells=30).count() == 0
    halves = infer.orientation_halves(donors, 1)
    assert halves.where("orients").count() == 9
    names = spark.createDataFrame([("g", 1, "x"), ("g", 2, "g"), ("g", 3, "x"), ("g", 4, "a"), ("g", 5, "l" * 50)], "gene string, pos int, alias string")
    assert retrieve.clean_aliases(names).first().aliases == ["x", "a"]
    runs = spark.createDataFrame([(0, "h"), (1, "h")], "seed int, sha256 string")
    assert {r.seed: r.ok for r in infer.run_integrity(runs, runs.where("seed = 0").union(spark.createDataFrame([(2, "z")], runs.schema)), "seed").collect()} == {0: True, 1: False, 2: False}
    made = report.typed_config(spark.createDataFrame([('{"lr": 0.1, "epochs": 3}',)], "c string"), "c", "lr double, epochs int").first().c
    assert (made.lr, made.epochs) == (0.1, 3) and report.environment(spark).first().spark == spark.version


def test_fold_reads_its_tables_once(spark):
    expr, obs, *_ = cells(spark)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    n = expr.count()
    fold = prep.build_fold(expr.mapInArrow(counted, expr.schema), obs, 1, min_genes=2, min_cells=3, n_hvg=8)
    assert fold["expr"].count() and reads.value == n
    for bad in (-1.0, 0.5, float("nan"), None):
        first = expr.where("cell_id = 7").agg(F.min("gene")).first()[0]
        odd = expr.withColumn("value", F.when((F.col("cell_id") == 7) & (F.col("gene") == first), F.lit(bad).cast("double")).otherwise(F.col("value")))
        with pytest.raises(ValueError, match="finite"):
            prep.build_fold(odd, obs, 1, min_genes=2)


def test_hex_context(spark):
    h, g = "0123456789" * 4, "abcdef0123" * 4
    rows = {
        1: f"see {h}", 2: f"commit: {h}", 3: f"git_sha = '{h}' and then {g}", 4: f"commit: {'x' * 80} {h}", 5: f"models--a/{h}",
        6: f"revision={'y' * 60} {h}", 7: f"{h} sha: 1", 8: f"hash: {h} {g} {h}", 9: h + "0", 10: f"the commit {h}", 11: "", 12: None, 13: f"sha:{h}\n{g}\n{h}\n{g}",
    }
    got = {r.i for r in captions.secret_scan(spark.createDataFrame(list(rows.items()), "i int, t string"), "i", "t").where("kind = 'bare_hex'").collect()}

    def brute(t):
        import re

        for m in re.finditer(r"\b[a-f0-9]{40}\b", t or ""):
            before = t[max(0, m.start() - 80) : m.start()]
            if not any(p in before for p in captions.SAFE_PATHS) and not re.search(captions.SAFE_FIELD, before):
                return True
        return False

    assert got == {i for i, t in rows.items() if brute(t)} and {1, 4, 7, 10} <= got and not {2, 5, 6, 9} & got


def test_caption_set(spark):
    classes = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "class string")
    source = spark.createDataFrame([("a", "first"), ("c", "other"), ("b", None)], "class string, caption string")
    with pytest.raises(ValueError):
        captions.caption_set("copy", classes, source=source)
    with pytest.raises(ValueError):
        captions.caption_set("copy", classes)
    got, told = captions.caption_set("copy", classes, source=source, missing="name")
    row = told.first()
    assert {tuple(r) for r in got.collect()} == {("a", "first"), ("b", "b")} and (row.n_classes, row.n_missing, row.missing, row.fit_scope) == (2, 1, ["b"], "source")
    again = captions.caption_set("copy", classes.repartition(3), source=source.orderBy(F.desc("class")), missing="name")[1].first()
    assert again == row and captions.caption_set("name", classes)[1].first().source_sha256 is None
    assert captions.cell_caption(F.lit(None).cast("string"), F.lit("B"), "brain") is not None
    one = spark.range(1).select(captions.cell_caption(F.lit(None).cast("string"), F.lit("B"), "brain").alias("a"), captions.cell_caption(F.lit("x, y"), None).alias("b")).first()
    assert one.a == "A B cell from human brain. Highly expressed genes: none detected." and one.b == "A cell from human blood. Highly expressed genes: x, y."


def test_grouped_ridge(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, f"d{i}", i % 4 == 0, float(rng.normal()), [float(v) for v in rng.normal(size=3)]) for k in ("a", "b") for i in range(20)]
    rows += [("few", f"d{i}", i % 2 == 0, 1.0, [1.0, 2.0, 3.0]) for i in range(6)] + [("a", "gap", True, 1.0, [None, 1.0, 1.0]), ("a", "none", False, None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "type string, donor_id string, is_test boolean, target double, x array<double>")
    got = {(r.type, r.donor_id): r.predicted for r in readout.grouped_ridge(frame, "type").collect()}
    assert {k for k, _ in got} == {"a", "b"} and len(got) == 10
    for kind in ("a", "b"):
        mine = [r for r in rows if r[0] == kind and r[1] not in ("gap", "none")]
        flat = spark.createDataFrame([(r[1], r[2], r[3], *r[4]) for r in mine], "donor_id string, is_test boolean, y double, a double, b double, c double")
        for r in readout.ridge_predictions(flat, ["a", "b", "c"], "y").collect():
            assert got[kind, r.donor_id] == pytest.approx(r.predicted)
    monkeypatch.setattr(readout, "MOST_DONORS", 19)
    with pytest.raises(Exception, match="more than 19 donors"):
        readout.grouped_ridge(frame, "type").collect()


def test_moments_of_many_columns(spark):
    x = np.random.default_rng(1).normal(size=(30, 400))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(400)))
    n, s, m = readout._moments(frame, frame.columns)
    assert n == 30 and np.allclose(s, x.sum(axis=0)) and np.allclose(m, x.T @ x)
    n, s, m = readout._moments(frame.limit(0), frame.columns)
    assert n == 0 and not s.any() and not m.any()


def test_heldout_figures_and_donor_checks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 2))
    names = [f"d{i:02d}" for i in range(24)]
    made = spark.createDataFrame([("g", n, [float(a), float(b)]) for n, (a, b) in zip(names, x)] + [("flat", n, [1.0, 1.0]) for n in names] + [("few", n, [1.0, 2.0]) for n in names[:4]], "kind string, donor_id string, x array<double>")
    targets = spark.createDataFrame([(n, None if i == 3 else float("nan") if i == 5 else float(x[i, 0])) for i, n in enumerate(names)], "donor_id string, target double")
    split = spark.createDataFrame([(n, i % 3 == 0) for i, n in enumerate(names)] + [("absent", True)], "donor_id string, is_test boolean")
    rows = readout.evaluation_donors(made, targets, split, "kind")
    got = {r.kind: r for r in readout.regress_heldout(rows, "kind").collect()}
    assert (got["g"].n_train, got["g"].n_test) == (15, 7) and got["g"].rho == pytest.approx(1) and got["g"].r2 > 0.9
    assert got["flat"].rho is None and got["flat"].mae > 0 and got["few"].rho is None and got["few"].mae is None and got["few"].n_test == 1
    one = split.limit(1)
    for f, t, s, message in (
        (made.union(made.limit(1)), targets, split, "unique"),
        (made, targets.union(targets.limit(1)), split, "unique"),
        (made, targets, split.union(one), "twice"),
        (made, targets, split.union(one.selectExpr("donor_id", "not is_test")), "train and test"),
    ):
        with pytest.raises(ValueError, match=message):
            readout.evaluation_donors(f, t, s, "kind")


def test_pick_key(spark):
    rows = spark.createDataFrame([("A", "x1", "g1"), ("b", "x2", "g2"), ("C", "x3", "zz")], "a string, b string, c string")
    known = spark.createDataFrame([("a",), ("B",), ("c",), ("G1",), ("G2",), ("ZZ",)], "id string")
    assert joins.pick_key(rows, ["none", "b", "c", "a"], known, "id")[1:] == ("c", 1.0)  # over the limit: "a" isn't looked at
    assert joins.pick_key(rows, ["b"], known, "id")[1:] == ("b", 0.0)
    got, name, rate = joins.pick_key(rows, ["none"], known, "id")
    assert name is None and rate == 0.0 and {r.id for r in got.collect()} == {None}
    assert joins.pick_key(rows.limit(0), ["a"], known, "id")[1] is None


def test_train_vocabulary_and_pseudo_donors(spark):
    _, obs, *_ = cells(spark)
    split = spark.createDataFrame([(f"d{i}", i > 2) for i in range(6)], "donor_id string, is_test boolean")
    odd = obs.withColumn("cell_type", F.when(F.col("cell_id") == 5, "NEW").when(F.col("cell_id") == 0, None).otherwise(F.col("cell_type")))
    types = features.train_types(odd, split)
    assert "NEW" not in types and set(types) <= set("TBM") and features.train_types(obs.limit(0), split) == []
    dealt = prep.pseudo_donors(obs, ["p", "q"], 1)
    assert {r.donor_id for r in dealt.collect()} == {"p", "q"} and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, prep.pseudo_donors(obs.orderBy(F.desc("cell_id")), ["p", "q"], 1).collect()))


def test_grouped_ridge_of_many_donors(spark, monkeypatch):
    """More donors than one task gathers; groups without train rows in some tasks, a null group, constant features."""
    monkeypatch.setattr(readout, "MOST_HELD", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6_003, 3)) * [1, 1e4, 1] + [0, 4e4, 0]
    x[:, 2] = 38000.3
    y, test = x[:, 0] + rng.normal(size=len(x)), np.arange(len(x)) % 4 == 0
    rows = [(k, f"d{i}", bool(test[i]), float(y[i]), x[i].tolist()) for k in ("a", None) for i in range(len(x) if k else 40)]
    rows += [("test only", f"d{i}", True, 1.0, [1.0, 2.0]) for i in range(9)]
    frame = spark.createDataFrame(rows, "type string, donor_id string, is_test boolean, target double, x array<double>").repartition(70)
    got = {(r.type, r.donor_id): r.predicted for r in readout.grouped_ridge(frame, "type").collect()}
    assert {k for k, _ in got} == {"a", None}
    for kind, n in (("a", len(x)), (None, 40)):
        a, b, t = x[:n], y[:n], test[:n]
        sd = a[~t].std(axis=0)
        sd[2] = 1.0
        z = (a - a[~t].mean(axis=0)) / sd
        z[:, 2] = 0
        w = np.linalg.solve(z[~t].T @ z[~t] + np.eye(3), z[~t].T @ (b[~t] - b[~t].mean()))
        assert np.allclose([got[kind, f"d{i}"] for i in np.flatnonzero(t)], z[t] @ w + b[~t].mean(), rtol=0, atol=1e-9)
