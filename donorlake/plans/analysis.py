"""Queries: features, markers, correlations, inference, readouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import keyed, r6
from ..operators import features, infer, joins, markers, prep, readout, report, stats
from ..sources import cohort
from ..sources.readers import table
from .preparation import _SPLIT
from .registry import corr, query, u

_OBS = cohort.sql("obs")
_FRACTIONS = "counts AS (SELECT donor_id, cell_type AS type, count(*) AS n FROM obs GROUP BY ALL), fractions AS (SELECT donor_id, type, n / sum(n) OVER (PARTITION BY donor_id) AS fraction FROM counts)"


def _avg_rank(v: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"


@query(f"""{cohort.sql('obs', 'donors')}, {_SPLIT}, {_FRACTIONS},
j AS (SELECT type, {_avg_rank('fraction', 'type')} AS a, {_avg_rank('target', 'type')} AS b FROM fractions JOIN donors USING (donor_id) JOIN split USING (donor_id) WHERE NOT is_test AND fraction > 0)
SELECT type, round({corr('a', 'b')}, 6) AS rho, count(*) AS n FROM j GROUP BY type HAVING count(*) >= 10""")
def abundance_vs_target(spark, root):
    """Over train donors: does a type's share of a donor's cells go with the donor's target?"""
    obs = cohort.obs(spark, root)
    train = prep.donor_split(obs, 7).where("not is_test")
    rows = features.composition(obs).join(train, "donor_id", "left_semi").join(cohort.donors(spark, root), "donor_id").where("fraction > 0")
    return stats.spearman(rows, "fraction", "target", "type").where("n >= 10").select("type", r6("rho").alias("rho"), "n")


@query(f"{_OBS}, {_FRACTIONS} SELECT donor_id, type, round(fraction, 6) AS fraction FROM fractions")
def composition(spark, root):
    return features.composition(cohort.obs(spark, root)).withColumn("fraction", r6("fraction"))


@query(f"{_OBS}, {_FRACTIONS}, {_SPLIT} SELECT donor_id, type, round(fraction, 6) AS fraction FROM fractions WHERE type IN (SELECT cell_type FROM obs JOIN split USING (donor_id) WHERE NOT is_test AND cell_type <> '5-LOW')")
def composition_train_vocabulary(spark, root):
    obs = cohort.obs(spark, root)
    train = obs.join(prep.donor_split(obs, 7).where("not is_test"), "donor_id", "left_semi")
    vocabulary = train.where("cell_type <> '5-LOW'").select(F.col("cell_type").alias("type")).distinct()
    return features.composition(obs, vocabulary).withColumn("fraction", r6("fraction"))


@query(f"{_OBS}, c AS (SELECT donor_id, cell_type || '@' || region AS type, count(*) AS n FROM obs GROUP BY ALL) SELECT donor_id, type, round(n / sum(n) OVER (PARTITION BY donor_id), 6) AS fraction FROM c")
def composition_region(spark, root):
    return features.composition_region(cohort.obs(spark, root)).withColumn("fraction", r6("fraction"))


@query(f"""{_OBS} SELECT donor_id, round(avg((cell_type = '1-URGENT')::INT), 6) AS "1-URGENT", round(avg((cell_type = '5-LOW')::INT), 6) AS "5-LOW" FROM obs GROUP BY donor_id""")
def onehot_composition(spark, root):
    wide = features.composition_wide(cohort.obs(spark, root), ["1-URGENT", "5-LOW"])
    return wide.select("donor_id", r6(F.col("`1-URGENT`")).alias("1-URGENT"), r6(F.col("`5-LOW`")).alias("5-LOW"))


@query(f"{cohort.sql('obs', 'expr')}, n AS (SELECT donor_id, count(*) AS n FROM obs GROUP BY ALL) SELECT donor_id, gene, round(sum(value) / max(n), 6) AS mean FROM expr JOIN obs USING (cell_id) JOIN n USING (donor_id) GROUP BY ALL")
def pseudobulk_mean(spark, root):
    return features.pseudobulk(cohort.expr(spark, root), cohort.obs(spark, root)).withColumn("mean", r6("mean"))


_FLAT = f"{cohort.sql('emb')}, f AS (SELECT cell_id, donor_id, cell_type, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS x FROM emb)"


@query(f"{_FLAT} SELECT donor_id, dim, round(avg(x), 6) AS value FROM f GROUP BY ALL")
def donor_mean_pool(spark, root):
    return features.pooled(cohort.emb(spark, root)).withColumn("value", r6("value"))


@query(f"{_FLAT} SELECT donor_id, dim, round(quantile_cont(x, 0.9), 6) AS value FROM f GROUP BY ALL")
def donor_quantile_pool(spark, root):
    return features.pooled(cohort.emb(spark, root), q=0.9).withColumn("value", r6("value"))


@query(f"""{_FLAT}, s AS (SELECT cell_id, exp(1.5 * tanh(sum(x * CASE WHEN dim % 2 = 0 THEN 1.0 ELSE -1.0 END)) - 0.5 * tanh(sum(x * 0.25))) AS a FROM f GROUP BY cell_id)
SELECT donor_id, dim, round(sum(a * x) / sum(a), 6) AS value FROM f JOIN s USING (cell_id) GROUP BY ALL""")
def attention_pool(spark, root):
    emb = cohort.emb(spark, root)
    v = [[1.0 if d % 2 == 0 else -1.0 for d in range(64)], [0.25] * 64]
    return features.attention_pooled(emb, v, [1.5, -0.5]).withColumn("value", r6("value"))


_BANK = "bank AS (SELECT cell_type AS class, dim, avg(x) AS x FROM f WHERE CAST(donor_id AS INTEGER) < 15 GROUP BY ALL)"
_SHOT = f"""{_FLAT}, {_BANK}, v AS (SELECT cell_id, list(x ORDER BY dim) AS e FROM f GROUP BY ALL), w AS (SELECT class, list(x ORDER BY dim) AS e FROM bank GROUP BY ALL),
c AS (SELECT cell_id, class, round(list_cosine_similarity(v.e, w.e), 9) AS s FROM v, w),
shot AS (SELECT cell_id, class AS predicted, s FROM c QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, class) = 1)"""


def _zero_shot(spark, root):
    emb = cohort.emb(spark, root)
    bank = features.as_vectors(features.pooled(emb.where(F.col("donor_id").cast("int") < 15), ["cell_type"]), "cell_type")
    return emb, features.zero_shot(emb, bank.select(F.col("cell_type").alias("class"), F.col("embedding").alias("vector")))


@query(f"{_SHOT} SELECT cell_id, predicted, round(s, 5) AS similarity FROM shot")
def zero_shot_nearest(spark, root):
    return _zero_shot(spark, root)[1].withColumn("similarity", F.round("similarity", 5) + 0.0)


@query(f"""{_SHOT}, p AS (SELECT cell_type AS t, predicted AS p FROM shot JOIN emb USING (cell_id)), k AS (SELECT t AS k FROM p UNION SELECT p FROM p),
m AS (SELECT k, (SELECT count(*) FROM p WHERE t = k) AS nt, (SELECT count(*) FROM p WHERE p = k) AS np, (SELECT count(*) FROM p WHERE t = k AND p = k) AS tp FROM k)
SELECT round(avg(2.0 * tp / (nt + np)), 6) AS macro_f1, round(avg(CASE WHEN nt > 0 THEN tp / nt END), 6) AS balanced_accuracy FROM m""")
def classification_metrics(spark, root):
    emb, shot = _zero_shot(spark, root)
    got = stats.classification(shot.join(emb, "cell_id"), "cell_type", "predicted")
    return got.select(r6("macro_f1").alias("macro_f1"), r6("balanced_accuracy").alias("balanced_accuracy"))


@query(f"{_OBS}, k AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS code FROM (SELECT DISTINCT cell_type FROM obs)) SELECT cell_type, code, list_transform(range(0, 8), lambda i: CASE WHEN i = code THEN 1.0 ELSE 0.0 END)::DOUBLE[]::VARCHAR AS vector FROM k")
def onehot_prototypes(spark, root):
    obs = cohort.obs(spark, root)
    vectors = features.onehot_prototypes(obs, "cell_type", 8).join(features.encode_labels(obs, "cell_type"), "cell_type")
    return vectors.select("cell_type", F.col("code").cast("bigint").alias("code"), F.concat(F.lit("["), F.array_join(F.col("vector").cast("array<string>"), ", "), F.lit("]")).alias("vector"))


@query("WITH l AS (SELECT DISTINCT n_regionkey AS level FROM nation) SELECT a.level AS a, b.level AS b, round(exp(-abs(a.level - b.level) / 0.5) / sum(exp(-abs(a.level - b.level) / 0.5)) OVER (PARTITION BY a.level), 6) AS weight FROM l a, l b")
def soft_ordinal_weights(spark, root):
    return features.soft_ordinal(table(spark, root, "nation").select(F.col("n_regionkey").alias("level")), 0.5).withColumn("weight", r6("weight"))


@query(f"""{cohort.sql('emb')}, b AS (SELECT cell_id // 64 AS batch, cell_id AS i, embedding AS x, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1] + 0.5 * p[2]) AS y FROM emb),
s AS (SELECT batch, a.i, c.i AS j, list_cosine_similarity(a.x, c.y) / 0.07 AS s FROM b a JOIN b c USING (batch)),
r AS (SELECT batch, i AS k, ln(sum(exp(s))) AS r FROM s GROUP BY ALL), c AS (SELECT batch, j AS k, ln(sum(exp(s))) AS c FROM s GROUP BY ALL)
SELECT s.batch, round(avg((r + c) / 2 - s), 6) AS loss FROM s JOIN r ON r.batch = s.batch AND r.k = i JOIN c ON c.batch = s.batch AND c.k = j WHERE i = j GROUP BY ALL""")
def infonce_loss(spark, root):
    """The loss of each batch of 64 cells, over all cells."""
    rows = cohort.emb(spark, root).select(F.floor(F.col("cell_id") / 64).alias("batch"), F.col("cell_id").alias("i"), F.col("embedding").alias("x"), F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a + 0.5 * b).alias("y"))
    return features.infonce(rows, 0.07, "batch").withColumn("loss", r6("loss"))


_DIFF = f"""{cohort.sql('obs', 'expr')}, k AS (SELECT cell_type AS class, count(*) AS n_in FROM obs GROUP BY ALL), n AS (SELECT count(*) AS n_all FROM obs),
i AS (SELECT cell_type AS class, gene, sum(value) AS s FROM expr JOIN obs USING (cell_id) GROUP BY ALL), t AS (SELECT gene, sum(s) AS s FROM i GROUP BY gene),
diff AS (SELECT k.class, t.gene, coalesce(i.s, 0) / n_in - (t.s - coalesce(i.s, 0)) / (n_all - n_in) AS diff FROM t, k, n LEFT JOIN i ON i.class = k.class AND i.gene = t.gene),
top AS (SELECT class, gene, diff, CAST(row_number() OVER (PARTITION BY class ORDER BY diff DESC, gene) AS INTEGER) AS rank FROM diff)""".replace("FROM t, k, n LEFT JOIN", "FROM t CROSS JOIN k CROSS JOIN n LEFT JOIN")


@query(f"{_DIFF} SELECT class, gene, round(diff, 6) AS diff, rank FROM top WHERE rank <= 5")
def marker_mean_diff(spark, root):
    diff = markers.mean_difference(cohort.expr(spark, root), cohort.obs(spark, root))
    return markers.top_n(diff, "diff", 5, "class").withColumn("diff", r6("diff"))


@query(f"""{cohort.sql('obs', 'expr')}, k AS (SELECT cell_type AS class, count(*) AS n1 FROM obs GROUP BY ALL), n AS (SELECT count(*) AS n FROM obs),
g AS (SELECT DISTINCT gene FROM expr), full_ AS (SELECT gene, cell_id, cell_type AS class, coalesce(value, 0) AS v FROM (SELECT * FROM g, obs) LEFT JOIN expr USING (gene, cell_id)),
r AS (SELECT gene, class, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r FROM full_)
SELECT class, gene, round((sum(r) - max(n1) * (max(n) + 1) / 2.0) / sqrt(max(n1)::DOUBLE * (max(n) - max(n1)) * (max(n) + 1) / 12), 5) AS z FROM r JOIN k USING (class), n GROUP BY class, gene""")
def marker_ranksum(spark, root):
    z = markers.rank_sum(cohort.expr(spark, root), cohort.obs(spark, root))
    return z.withColumn("z", F.round("z", 5) + 0.0)


@query(f"{cohort.sql('expr')} SELECT cell_id, gene, value, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) AS INTEGER) AS rank FROM expr QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) <= 3")
def top_genes_per_cell(spark, root):
    return markers.top_expressed(cohort.expr(spark, root), 3)


_PRECISION = f"""{_DIFF}, ref AS (SELECT class, gene FROM top WHERE rank <= 6 AND substr(gene, 7, 1)::INT % 2 = 1), ex AS (SELECT class, gene FROM top WHERE rank = 1),
l AS (SELECT class, gene, row_number() OVER (PARTITION BY class ORDER BY diff DESC, gene) AS r, gene IN (SELECT gene FROM ref WHERE ref.class = top.class) AS hit FROM top WHERE rank > 1)"""


def _precision(spark, root):
    diff = markers.mean_difference(cohort.expr(spark, root), cohort.obs(spark, root))
    top = markers.top_n(diff, "diff", 10**6, "class").withColumnRenamed("diff", "score")
    ref = top.where((F.col("rank") <= 6) & (F.substring("gene", 7, 1).cast("int") % 2 == 1))
    return markers.precision_at_k(top.select("class", "gene", "score"), ref, 10, top.where("rank = 1").select("class", "gene"))


@query(f"""{_PRECISION}
SELECT class, round(count(*) FILTER (hit AND r <= 10) / 10, 6) AS precision, round(least(10, count(*) FILTER (hit)) / 10, 6) AS ceiling, count(*) FILTER (hit) > 0 AS evaluable FROM l GROUP BY class""")
def precision_at_k(spark, root):
    return _precision(spark, root).select("class", r6("precision").alias("precision"), r6("ceiling").alias("ceiling"), "evaluable")


@query(f"""{_PRECISION}, p AS (SELECT class, count(*) FILTER (hit AND r <= 10) / 10 AS precision, count(*) FILTER (hit) > 0 AS evaluable FROM l GROUP BY class)
SELECT CASE WHEN class < '3' THEN 'first' ELSE 'rest' END AS part, round(avg(precision) FILTER (evaluable), 6) AS mean, count(*) FILTER (evaluable) AS n_evaluable, count(*) AS n_classes FROM p GROUP BY ALL""")
def macro_precision(spark, root):
    """Mean precision over the classes that can be judged, by part."""
    part = F.when(F.col("class") < "3", "first").otherwise("rest")
    got = stats.macro_mean(_precision(spark, root).withColumn("part", part), "precision", "evaluable", "part")
    return got.select("part", r6("mean").alias("mean"), "n_evaluable", "n_classes")


@query("""WITH b AS (SELECT p_type AS type, p_brand AS gene, max(p_retailprice) AS sensitivity FROM part GROUP BY ALL)
SELECT type, gene, sensitivity, CAST(row_number() OVER (PARTITION BY type ORDER BY sensitivity DESC, gene) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY type ORDER BY sensitivity DESC, gene) <= 3""")
def best_markers(spark, root):
    return markers.best_markers(table(spark, root, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("gene"), F.col("p_retailprice").alias("sensitivity")), 3)


_RUNS = cohort.sql("preds", "runs")
_RHO = f"""r AS (SELECT seed, arm, {_avg_rank('observed', 'seed, arm')} AS o, {_avg_rank('predicted', 'seed, arm')} AS p FROM runs), rho AS (SELECT seed, arm, {corr('o', 'p')} AS rho, count(*) AS n FROM r GROUP BY ALL)"""


@query(f"{_RUNS}, {_RHO} SELECT seed, arm, round(CASE WHEN n >= 3 THEN rho END, 6) AS rho, n FROM rho")
def spearman_by_arm(spark, root):
    return stats.spearman(cohort.runs(spark, root), "observed", "predicted", "seed", "arm").withColumn("rho", r6("rho"))


@query(f"{_RUNS} SELECT seed, arm, round((1 - sum((observed - predicted) ** 2) / nullif(var_pop(observed) * count(*), 0)) / 1e6, 5) AS r2_millions, round(avg(abs(observed - predicted)), 5) AS mae, count(*) AS n FROM runs GROUP BY ALL")
def regression_metrics(spark, root):
    got = stats.regression(cohort.runs(spark, root), "observed", "predicted", "seed", "arm")
    return got.select("seed", "arm", (F.round(F.col("r2") / 1e6, 5) + 0.0).alias("r2_millions"), (F.round("mae", 5) + 0.0).alias("mae"), "n")


@query(f"{_RUNS}, {_RHO} SELECT arm, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS std, count(rho) AS n FROM rho GROUP BY arm")
def run_mean_std(spark, root):
    rho = stats.spearman(cohort.runs(spark, root), "observed", "predicted", "seed", "arm")
    return stats.mean_std(rho, "rho", "arm").select("arm", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(f"""{_RUNS}, {_RHO} SELECT seed, round(max(rho) FILTER (arm = 'A'), 6) AS "A", round(max(rho) FILTER (arm = 'B'), 6) AS "B" FROM rho GROUP BY seed""")
def run_pivot(spark, root):
    rho = stats.spearman(cohort.runs(spark, root), "observed", "predicted", "seed", "arm")
    return report.pivot(rho, ["seed"], "arm", ["A", "B"], "rho", "max").select("seed", r6("A").alias("A"), r6("B").alias("B"))


@query(f"""{cohort.sql('donors')}, r AS (SELECT range AS rep FROM range(5)), o AS (SELECT rep, donor_id, target, row_number() OVER (PARTITION BY rep ORDER BY donor_id) AS a,
  row_number() OVER (PARTITION BY rep ORDER BY {u('donor_id', 'CAST(rep + 11 AS VARCHAR)')}, donor_id) AS b FROM donors, r)
SELECT CAST(x.rep AS INTEGER) AS rep, x.donor_id, round(y.target, 6) AS target FROM o x JOIN o y ON x.rep = y.rep AND x.a = y.b""")
def label_permutation(spark, root):
    return infer.permuted(cohort.donors(spark, root), "donor_id", "target", 5, 11).withColumn("target", r6("target"))


@query(f"""{cohort.sql('donors')}, r AS (SELECT range AS rep FROM range(60)), o AS (SELECT rep, donor_id, target, row_number() OVER (PARTITION BY rep ORDER BY donor_id) AS a,
  row_number() OVER (PARTITION BY rep ORDER BY {u('donor_id', 'CAST(rep + 11 AS VARCHAR)')}, donor_id) AS b FROM donors, r),
p AS (SELECT x.rep, x.target AS t, y.target AS q FROM o x JOIN o y ON x.rep = y.rep AND x.a = y.b),
k AS (SELECT rep, {_avg_rank('t', 'rep')} AS a, {_avg_rank('q', 'rep')} AS b FROM p), rho AS (SELECT rep, {corr('a', 'b')} AS rho FROM k GROUP BY rep)
SELECT round(quantile_cont(rho, 0.95), 6) AS quantile, count(rho) AS n FROM rho""")
def null_quantile(spark, root):
    donors = cohort.donors(spark, root)
    dealt = infer.permuted(donors, "donor_id", "target", 60, 11).withColumnRenamed("target", "q").join(donors, "donor_id")
    return stats.null_quantile(stats.spearman(dealt, "target", "q", "rep"), "rho", 0.95).withColumn("quantile", r6("quantile"))


_PAIRS = "pairs AS (SELECT a.seed, donor_id, a.observed, a.predicted AS pa, b.predicted AS pb FROM runs a JOIN runs b USING (seed, donor_id) WHERE a.arm = 'A' AND b.arm = 'B')"
_DELTA = "SELECT {by}, CASE WHEN count(*) >= 3 THEN " + corr("o", "a") + " - " + corr("o", "b") + " END AS d FROM (SELECT {by}, {ro} AS o, {ra} AS a, {rb} AS b FROM {rows}) GROUP BY {by}"


def _delta(rows: str, by: str) -> str:
    return _DELTA.format(by=by, rows=rows, ro=_avg_rank("observed", by), ra=_avg_rank("pa", by), rb=_avg_rank("pb", by))


@query(f"""{_RUNS}, {_PAIRS}, d AS (SELECT donor_id, row_number() OVER (ORDER BY donor_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT donor_id FROM pairs)),
s AS (SELECT rep, slot, {u("rep || '#' || slot", "'17'")} % (SELECT max(n) FROM d) AS i FROM (SELECT range AS rep FROM range(50)), (SELECT unnest(range(0, (SELECT max(n) FROM d))) AS slot)),
b AS (SELECT rep, seed, observed, pa, pb FROM s JOIN d USING (i) JOIN pairs USING (donor_id)),
reps AS (SELECT rep, round(avg(d), 12) AS d FROM ({_delta('b', 'rep, seed')}) GROUP BY rep HAVING avg(d) IS NOT NULL), point AS (SELECT avg(d) AS delta FROM ({_delta('pairs', 'seed')}))
SELECT (SELECT round(delta, 6) FROM point) AS delta_rho, count(*) AS n_valid, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high,
round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)) + 1.0 / (count(*) + 1)), 6) AS p_emp, (SELECT max(n) FROM d) AS n_donors FROM reps""")
def clustered_bootstrap(spark, root):
    runs = cohort.runs(spark, root)
    pairs = joins.paired(runs.where("arm = 'A'"), runs.where("arm = 'B'"), ["seed", "donor_id"])
    got = infer.clustered_bootstrap(pairs, 50, 17)
    return got.select(*(r6(c).alias(c) for c in ("delta_rho", "ci_low", "ci_high", "p_emp")), "n_valid", "n_donors")


@query(f"""{_RUNS}, one AS (SELECT donor_id, observed, predicted FROM runs WHERE seed = 0 AND arm = 'A'), d AS (SELECT donor_id, row_number() OVER (ORDER BY donor_id) - 1 AS i, count(*) OVER () AS n FROM one),
s AS (SELECT rep, {u("rep || '#' || slot", "'23'")} % (SELECT max(n) FROM d) AS i FROM (SELECT range AS rep FROM range(40)), (SELECT unnest(range(0, (SELECT max(n) FROM d))) AS slot)),
b AS (SELECT rep, {_avg_rank('observed', 'rep')} AS o, {_avg_rank('predicted', 'rep')} AS p FROM s JOIN d USING (i) JOIN one USING (donor_id)), r AS (SELECT rep, {corr('o', 'p')} AS rho FROM b GROUP BY rep),
q AS (SELECT rank() OVER (ORDER BY observed) + 0.0 AS o, rank() OVER (ORDER BY predicted) + 0.0 AS p FROM one)
SELECT round((SELECT {corr('o', 'p')} FROM q), 6) AS rho, round(quantile_cont(rho, 0.025), 6) AS ci_low, round(quantile_cont(rho, 0.975), 6) AS ci_high, round(avg(rho), 6) AS mean_rho, count(rho) AS n_valid FROM r""")
def bootstrap_rho(spark, root):
    one = cohort.runs(spark, root).where("seed = 0 and arm = 'A'").select("donor_id", "observed", "predicted")
    got = infer.bootstrap_rho(one, "observed", "predicted", 40, 23)
    return got.select(*(r6(c).alias(c) for c in ("rho", "ci_low", "ci_high", "mean_rho")), "n_valid")


_P = "p AS (SELECT seed, donor_id, CASE WHEN donor_id LIKE '%3' THEN NULL ELSE (" + u("donor_id", "'p'") + " % 1000) / 5000.0 + 0.0001 END AS p FROM runs WHERE arm = 'A')"


@query(f"""{_RUNS}, {_P}, k AS (SELECT *, count(p) OVER (PARTITION BY seed) AS m, row_number() OVER (PARTITION BY seed, p IS NULL ORDER BY p) AS r FROM p)
SELECT seed, donor_id, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (PARTITION BY seed, p IS NULL ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q FROM k""")
def bh_fdr(spark, root):
    from ..functions.scalar import keyed

    rows = cohort.runs(spark, root).where("arm = 'A'").select("seed", "donor_id", F.when(F.col("donor_id").endswith("3"), None).otherwise(keyed("donor_id", "p") % 1000 / 5000.0 + 0.0001).alias("p"))
    return stats.benjamini_hochberg(rows, "p", "seed").select("seed", "donor_id", r6("q").alias("q"))


@query("""WITH g AS (SELECT p_brand AS id, round(avg(p_size) FILTER (p_partkey % 2 = 0) / 50, 3) AS c, CASE WHEN count(*) % 7 > 0 THEN round(avg(p_size) FILTER (p_partkey % 2 = 1) / 50, 3) END AS r, min(p_size) / 50.0 - 0.02 AS l, count(*) % 5 > 0 AS n FROM part GROUP BY ALL)
SELECT id, CASE WHEN c IS NULL OR r IS NULL THEN 'NOT_EVALUABLE' WHEN c::DECIMAL(18, 6) - r::DECIMAL(18, 6) >= 0.05 AND l > 0 AND n THEN 'PASS' ELSE 'FAIL' END AS gate FROM g""")
def improvement_gate(spark, root):
    """The gate of each brand: mean sizes of even parts against odd ones."""
    even = F.col("p_partkey") % 2 == 0
    sizes = table(spark, root, "part").groupBy(F.col("p_brand").alias("id")).agg(F.round(F.avg(F.when(even, F.col("p_size"))) / 50, 3).alias("c"), F.round(F.avg(F.when(~even, F.col("p_size"))) / 50, 3).alias("r"), (F.min("p_size") / 50.0 - 0.02).alias("l"), F.count(F.lit(1)).alias("k"))
    rows = sizes.withColumn("r", F.when(F.col("k") % 7 > 0, F.col("r"))).withColumn("n", F.col("k") % 5 > 0)
    return infer.improvement_gate(rows, "c", "r", "l", "n").select("id", "gate")


@query(f"""{_RUNS}, {_RHO}, m AS (SELECT max(rho) FILTER (arm = 'A') AS a, min(rho) FILTER (arm = 'B') AS b FROM rho)
SELECT unnest(['integrity', 'improvement', 'semantics_random', 'semantics_text_null', 'absolute', 'transfer', 'composition', 'negative_result_valid']) AS gate,
unnest(['PASS', CASE WHEN a > b AND a - b >= 0.05 AND a > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN a > b AND a >= 0.05 AND b > 0 THEN 'PASS' ELSE 'FAIL' END, 'NOT_EVALUABLE', CASE WHEN a >= 0.5 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN b >= 0.35 THEN 'PASS' ELSE 'FAIL' END,
CASE WHEN a >= 0.05 AND b > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN NOT (a > b AND a - b >= 0.05 AND a > 0) THEN 'PASS' ELSE 'FAIL' END]) AS status FROM m""")
def gate_table(spark, root):
    rho = stats.spearman(cohort.runs(spark, root), "observed", "predicted", "seed", "arm")
    m = rho.agg(F.max(F.when(F.col("arm") == "A", F.col("rho"))).alias("a"), F.min(F.when(F.col("arm") == "B", F.col("rho"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    row = m.select(F.lit(0).alias("integrity_errors"), a.alias("candidate_rho"), b.alias("null_q95"), (a - b).alias("delta_b2"), a.alias("ci_b2"), a.alias("delta_t1"), b.alias("ci_t1"), F.lit(None).cast("double").alias("delta_n2"), a.alias("ci_n2"), b.alias("transfer_min"), a.alias("delta_b0"), b.alias("ci_b0"))
    return infer.gates(row)


@query(f"{_RUNS}, {_RHO} SELECT arm, round(avg(rho), 6) AS mean, CASE WHEN avg(rho) >= 0.0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM rho GROUP BY arm")
def mean_gate(spark, root):
    rho = stats.spearman(cohort.runs(spark, root), "observed", "predicted", "seed", "arm")
    return infer.mean_gate(rho, "rho", 0.0, "arm").withColumn("mean", r6("mean"))


@query(f"""{cohort.sql('obs', 'donors')}, {_FRACTIONS}, j AS (SELECT type, {_avg_rank('fraction', 'type')} AS a, {_avg_rank('target', 'type')} AS b FROM fractions JOIN donors USING (donor_id)),
r AS (SELECT type, {corr('a', 'b')} AS rho, CASE substr(type, 1, 1) WHEN '1' THEN 1 WHEN '5' THEN -1 ELSE 0 END AS e FROM j GROUP BY type),
k AS (SELECT *, {_avg_rank('rho', '1=1')} AS x, {_avg_rank('e', '1=1')} AS y FROM r)
SELECT round({corr('x', 'y')}, 6) AS rho, round(avg(CASE WHEN e <> 0 THEN (sign(rho) = e)::INT END), 6) AS concordance FROM k""")
def direction_agreement(spark, root):
    rows = features.composition(cohort.obs(spark, root)).join(cohort.donors(spark, root), "donor_id")
    rho = stats.spearman(rows, "fraction", "target", "type")
    first = F.substring("type", 1, 1)
    e = rho.withColumn("e", F.when(first == "1", 1).when(first == "5", -1).otherwise(0)).withColumn("one", F.lit(1))
    agree = e.agg(F.avg(F.when(F.col("e") != 0, (F.signum("rho") == F.col("e")).cast("int"))).alias("concordance"))
    return stats.spearman(e, "rho", "e", "one").select(r6("rho").alias("rho")).join(agree.withColumn("concordance", r6("concordance")))


@query("""WITH l AS (SELECT n_name AS label FROM nation), o AS (SELECT label, CASE label WHEN 'FRANCE' THEN 1 WHEN 'BRAZIL' THEN 2 ELSE 10000000 + coalesce(try_cast(regexp_extract(label, '(\\d+)$', 1) AS INTEGER), 1000000) END AS k FROM l)
SELECT DISTINCT label, row_number() OVER (ORDER BY k, label) - 1 AS place FROM o""".replace("SELECT DISTINCT label", "SELECT label"))
def ordinal_levels(spark, root):
    return report.level_order(table(spark, root, "nation").select(F.col("n_name").alias("label")), "label", ["FRANCE", "BRAZIL"]).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH d AS (SELECT CAST(c_nationkey AS VARCHAR) AS donor_id, avg(c_acctbal) AS target FROM customer GROUP BY ALL), e AS (SELECT quantile_cont(target, [0.25, 0.5, 0.75]) AS e FROM d WHERE donor_id < '5')
SELECT donor_id, 'target_q' || len(list_filter(e, lambda x: target >= x)) AS bin FROM d, e""")
def quantile_bins(spark, root):
    return report.quantile_bins(cohort.donors(spark, root), "target", F.col("donor_id") < "5", [0.25, 0.5, 0.75])


@query("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS n, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS seg, CAST(length(regexp_replace(CAST(c_custkey AS VARCHAR), '[^4]', '', 'g')) AS DOUBLE) AS fours FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def covariate_coding(spark, root):
    from ..functions.scalar import covariate

    rows = table(spark, root, "customer").where("c_mktsegment in ('BUILDING', 'AUTOMOBILE')").select("c_custkey", F.col("c_nationkey").cast("string").alias("nk"), "c_mktsegment")
    number = report.binary_covariate(rows, "nk").withColumnRenamed("coded", "n")
    return report.binary_covariate(number, "c_mktsegment").select("c_custkey", "n", F.col("coded").alias("seg"), covariate(F.col("c_custkey").cast("string"), "e4").alias("fours"))


_DONORF = "df AS (SELECT CAST(l_suppkey AS VARCHAR) AS donor_id, avg(l_quantity) AS y, avg(l_discount) AS x FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_DONORF}, s AS (SELECT *, {u('donor_id', "'9'")} % 4 = 0 AS is_test FROM df), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c, count(*) AS n FROM s WHERE NOT is_test)
SELECT donor_id, round(y, 6) AS observed, round(my + (x - mx) / sx * (c / sx * n) / (n + 1.0), 6) AS predicted FROM s, m WHERE is_test AND n >= 5 AND (SELECT count(*) FROM s WHERE is_test) >= 3""")
def ridge_readout(spark, root):
    from ..functions.scalar import keyed

    donors = table(spark, root, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("donor_id")).agg(F.avg("l_quantity").alias("y"), F.avg("l_discount").alias("x"))
    donors = donors.withColumn("is_test", keyed("donor_id", 9) % 4 == 0)
    got = readout.ridge_predictions(donors, ["x"], "y", 1.0)
    return got.select("donor_id", r6("observed").alias("observed"), r6("predicted").alias("predicted"))


def _donor_features(spark, root):
    from ..functions.scalar import keyed

    cols = ["l_discount", "l_tax", "l_extendedprice", "l_linenumber"]
    rows = table(spark, root, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("donor_id")).agg(F.avg("l_quantity").alias("y"), *(F.avg(c).alias(c) for c in cols))
    return rows.withColumn("is_test", keyed("donor_id", 9) % 4 == 0), cols


@query()
def pca_trajectory(spark, root):
    donors, cols = _donor_features(spark, root)
    return readout.trajectory(donors, cols, "y").withColumn("rho", r6("rho"))


@query()
def residual_readout(spark, root):
    donors, cols = _donor_features(spark, root)
    got = readout.residual_readout(donors, cols[:1], cols[1:], "y")
    return got.select("donor_id", r6("observed").alias("observed"), r6("predicted").alias("predicted"))


@query()
def readout_null(spark, root):
    donors, cols = _donor_features(spark, root)
    train = donors.where("not is_test").select("donor_id", "y")
    targets = infer.permuted(train, "donor_id", "y", 20, 3).withColumnRenamed("y", "value")
    return readout.readout_null(donors, cols, targets, "y").withColumn("rho", r6("rho"))


@query()
def strict_transfer(spark, root):
    donors, cols = _donor_features(spark, root)
    odd = keyed("donor_id", "half") % 2 == 1
    got = readout.transfer(donors.where(odd), donors.where(~odd).drop("l_tax"), cols, "y")
    return got.select("mode", "donor_id", r6("observed").alias("observed"), r6("predicted").alias("predicted"))


@query(f"{_OBS} SELECT count(DISTINCT cell_type) FILTER (cell_type IN (SELECT cell_type FROM obs WHERE cell_type < '3')) / count(DISTINCT cell_type) AS coverage FROM obs")
def vocabulary_coverage(spark, root):
    obs = cohort.obs(spark, root)
    return readout.vocabulary_coverage(obs.where("cell_type < '3'"), obs, "cell_type")


@query(f"{_RUNS}, b AS (SELECT donor_id, a.predicted AS x, c.predicted AS y FROM runs a JOIN runs c USING (donor_id) WHERE a.arm = 'A' AND c.arm = 'A' AND a.seed = 0 AND c.seed = 1) SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(max(abs(x - y)), 6) END AS max_gap FROM b")
def prediction_gap(spark, root):
    a = cohort.runs(spark, root).where("arm = 'A'")
    return joins.prediction_gap(a.where("seed = 0"), a.where("seed = 1")).withColumn("max_gap", r6("max_gap"))
