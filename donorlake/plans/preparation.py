"""Queries: validation, filters, splits, samples, normalisation, joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import keyed, r6
from ..operators import features, joins, prep, report
from ..sources import cohort, readers
from ..sources.readers import table
from .registry import query, u

_SPLIT = f"""split AS (SELECT donor_id, row_number() OVER (ORDER BY {u('donor_id', "'7'")}, donor_id)
  <= least(count(*) OVER () - 1, greatest(1, round_even(count(*) OVER () * 0.25, 0))) AS is_test
  FROM (SELECT DISTINCT donor_id FROM obs))"""


@query(f"{cohort.sql('obs')}, {_SPLIT} SELECT donor_id, is_test FROM split")
def donor_split(spark, root):
    return prep.donor_split(cohort.obs(spark, root), 7)


@query(f"{cohort.sql('obs')}, {_SPLIT} SELECT donor_id, bool_or(is_test) AS is_test FROM obs JOIN split USING (donor_id) GROUP BY donor_id")
def mask_donors(spark, root):
    obs = cohort.obs(spark, root)
    return prep.donors_from_mask(obs.join(prep.donor_split(obs, 7), "donor_id"))


@query(f"""{cohort.sql('obs')}, r AS (SELECT cell_id, donor_id, cell_type, row_number() OVER (PARTITION BY donor_id, cell_type ORDER BY {u('cell_id', "'3'")}, cell_id) AS k,
  greatest(1, round_even(count(*) OVER (PARTITION BY donor_id, cell_type) * 0.1, 0)) AS n FROM obs) SELECT cell_id, donor_id, cell_type FROM r WHERE k <= n""")
def stratified_sample(spark, root):
    return prep.stratified_sample(cohort.obs(spark, root), 3, "cell_id", ["donor_id", "cell_type"], 0.1).drop("region")


@query(f"""{cohort.sql('obs')} SELECT cell_id, donor_id, region FROM obs QUALIFY row_number() OVER (PARTITION BY donor_id, region ORDER BY {u('cell_id', "'5'")}, cell_id) <= 20""")
def cap_per_donor(spark, root):
    return prep.stratified_sample(cohort.obs(spark, root), 5, "cell_id", ["donor_id", "region"], most=20).select("cell_id", "donor_id", "region")


@query(f"""{cohort.sql('expr')} SELECT count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS n_not_finite, count(*) FILTER (value < 0) AS n_negative,
  count(*) FILTER (abs(value - round(value)) > 1e-6) AS n_not_integer, count(*) AS n_values FROM expr""")
def count_validation(spark, root):
    return prep.count_validation(prep.validate_counts(cohort.expr(spark, root)))


@query(f"{cohort.sql('expr')} SELECT cell_id, count(*) FILTER (value > 0) AS n_genes, sum(value) AS total FROM expr GROUP BY cell_id HAVING count(*) FILTER (value > 0) >= 4")
def cell_qc(spark, root):
    return prep.cell_totals(prep.filter_cells(cohort.expr(spark, root), 4))


@query(f"{cohort.sql('obs', 'expr')}, {_SPLIT} SELECT gene, count(*) AS n_cells FROM expr JOIN obs USING (cell_id) JOIN split USING (donor_id) WHERE NOT is_test AND value > 0 GROUP BY gene HAVING count(*) >= 3")
def train_gene_filter(spark, root):
    obs = cohort.obs(spark, root)
    train = obs.join(prep.donor_split(obs, 7).where("not is_test"), "donor_id", "left_semi")
    return prep.train_gene_filter(cohort.expr(spark, root), train, 3)


@query(f"{cohort.sql('expr')} SELECT cell_id, gene, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM expr")
def normalize_log1p(spark, root):
    return prep.normalize_log1p(cohort.expr(spark, root)).withColumn("value", r6("value"))


_HVG = f"""{cohort.sql('obs', 'expr')}, {_SPLIT}, train AS (SELECT cell_id FROM obs JOIN split USING (donor_id) WHERE NOT is_test),
l AS (SELECT cell_id, gene, value * 10000 / sum(value) OVER (PARTITION BY cell_id) AS x FROM expr),
s AS (SELECT gene, sum(x) / (SELECT count(*) FROM train) AS mu, sum(x * x) AS ss FROM l SEMI JOIN train USING (cell_id) GROUP BY gene),
d AS (SELECT gene, ln(1 + mu) AS m, ln(((ss - (SELECT count(*) FROM train) * mu * mu) / ((SELECT count(*) FROM train) - 1)) / mu) AS d FROM s),
b AS (SELECT *, least(19, coalesce(CAST(floor((m - min(m) OVER ()) / nullif((max(m) OVER () - min(m) OVER ()) / 20, 0)) AS INTEGER), 0)) AS bin FROM d),
z AS (SELECT gene, bin, m, d, CASE WHEN count(d) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE coalesce((d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0), 0) END AS z FROM b)
SELECT gene, round(m, 6) AS mean, round(d, 6) AS dispersion, round(z, 5) AS z FROM z ORDER BY round(z.z, 9) DESC, gene LIMIT 10"""


@query(_HVG)
def hvg_dispersion(spark, root):
    obs = cohort.obs(spark, root)
    train = obs.join(prep.donor_split(obs, 7).where("not is_test"), "donor_id", "left_semi")
    logged = prep.cells_of(prep.normalize_log1p(cohort.expr(spark, root)), train)
    top = prep.variable_genes(logged, train.count(), 10)
    return top.select("gene", r6("mean").alias("mean"), r6("dispersion").alias("dispersion"), (F.round("z", 5) + 0.0).alias("z"))


@query(f"""{cohort.sql('expr')}, n AS (SELECT count(DISTINCT cell_id) AS n FROM expr) SELECT gene, round(sum(value * value) / max(n) - (sum(value) / max(n)) ** 2, 6) AS variance
  FROM expr, n GROUP BY gene ORDER BY variance DESC, gene LIMIT 5""")
def top_variance(spark, root):
    expr = cohort.expr(spark, root)
    return prep.top_variance(expr, expr.select("cell_id").distinct().count(), 5).withColumn("variance", r6("variance"))


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN p_brand ELSE p_brand || '-' || k END AS symbol FROM r""")
def gene_symbol_unique(spark, root):
    return prep.unique_symbols(table(spark, root, "part"), "p_brand", "p_partkey").select("p_partkey", "symbol")


@query(f"{cohort.sql('obs')} SELECT cell_type, count(*) AS n FROM obs GROUP BY cell_type HAVING count(*) >= 100")
def type_support(spark, root):
    return prep.support(cohort.obs(spark, root), 100, "cell_type")


@query(f"{cohort.sql('obs')} SELECT donor_id, cell_type, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) >= 30")
def donor_type_support(spark, root):
    return prep.support(cohort.obs(spark, root), 30, "donor_id", "cell_type")


@query(f"{cohort.sql('obs')}, r AS (SELECT region FROM obs GROUP BY region HAVING count(*) >= 500) SELECT region, donor_id, count(*) AS n FROM obs SEMI JOIN r USING (region) GROUP BY ALL")
def region_filter(spark, root):
    return prep.supported(cohort.obs(spark, root), 500, "region").groupBy("region", "donor_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{cohort.sql('obs')} SELECT donor_id, count(DISTINCT region) AS n_values FROM obs GROUP BY donor_id HAVING count(DISTINCT cell_type) > 1")
def donor_constant_check(spark, root):
    obs = cohort.obs(spark, root)
    const = prep.donor_constant(obs, "region")
    mixed = prep.mixed_labels(obs, "cell_type")
    return const.join(mixed, "donor_id").groupBy("donor_id").agg(F.count_distinct("region").alias("n_values"))


@query("""WITH m AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, l_quantity) AS r FROM (SELECT l_suppkey, l_quantity, count(*) AS c FROM lineitem GROUP BY ALL))
SELECT l.l_suppkey AS donor_id, count(*) AS n, count(DISTINCT l_returnflag) AS n_flags, any_value(m.l_quantity) AS common, median(l.l_quantity) AS middle,
 arg_min(l_linestatus, l_orderkey * 1000000 + l_partkey) AS first_status FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey AND m.r = 1 GROUP BY ALL""")
def mixed_aggregates(spark, root):
    rows = table(spark, root, "lineitem").withColumn("ord", F.col("l_orderkey") * 1000000 + F.col("l_partkey")).withColumn("donor_id", F.col("l_suppkey"))
    first = prep.donor_first(rows, "ord", "l_linestatus").withColumnRenamed("l_linestatus", "first_status")
    some = rows.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("n_flags"), F.mode("l_quantity", deterministic=True).alias("common"), F.median("l_quantity").alias("middle"))
    return some.join(first, "donor_id")


@query(f"""{cohort.sql('obs', 'expr')}, {_SPLIT}, q AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS ng FROM expr), k AS (SELECT cell_id, gene, value FROM q WHERE ng >= 2),
train AS (SELECT DISTINCT cell_id FROM k JOIN obs USING (cell_id) JOIN split USING (donor_id) WHERE NOT is_test), nt AS (SELECT count(*) AS nt FROM train),
g AS (SELECT gene FROM k SEMI JOIN train USING (cell_id) GROUP BY gene HAVING count(*) >= 3),
l AS (SELECT cell_id, gene, value * 10000 / sum(value) OVER (PARTITION BY cell_id) AS x FROM k),
s AS (SELECT gene, sum(x) / max(nt) AS mu, sum(x * x) AS ss, max(nt) AS nt FROM l SEMI JOIN g USING (gene) SEMI JOIN train USING (cell_id), nt GROUP BY gene),
d AS (SELECT gene, ln(1 + mu) AS m, ln(((ss - nt * mu * mu) / (nt - 1)) / mu) AS d FROM s),
b AS (SELECT *, least(19, coalesce(CAST(floor((m - min(m) OVER ()) / nullif((max(m) OVER () - min(m) OVER ()) / 20, 0)) AS INTEGER), 0)) AS bin FROM d),
z AS (SELECT gene, CASE WHEN count(d) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE coalesce((d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0), 0) END AS z FROM b),
v AS (SELECT gene FROM z ORDER BY round(z, 9) DESC, gene LIMIT 15)
SELECT donor_id, is_test, count(*) AS n_values, count(DISTINCT gene) AS n_genes, round(sum(ln(1 + x)), 4) AS total FROM l SEMI JOIN v USING (gene) JOIN obs USING (cell_id) JOIN split USING (donor_id) GROUP BY ALL""".replace("FROM l SEMI JOIN g USING (gene) SEMI JOIN train USING (cell_id), nt GROUP BY", "FROM l SEMI JOIN g USING (gene) SEMI JOIN train USING (cell_id) CROSS JOIN nt GROUP BY"))
def donor_fold(spark, root):
    """Values of the fifteen most variable genes of a fold, by donor."""
    fold = prep.build_fold(cohort.expr(spark, root), cohort.obs(spark, root), 7, min_genes=2, min_cells=3, n_hvg=15)
    rows = fold["expr"].join(fold["obs"], "cell_id")
    return rows.groupBy("donor_id", "is_test").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("gene").alias("n_genes"), F.round(F.sum("value"), 4).alias("total"))


@query(f"{cohort.sql('obs', 'donors')} SELECT cell_id, donor_id, round(target, 6) AS target FROM obs LEFT JOIN (SELECT * FROM donors WHERE target > 4000) USING (donor_id)")
def left_cps_join(spark, root):
    return joins.left_donor_join(cohort.obs(spark, root), cohort.donors(spark, root).where("target > 4000")).select("cell_id", "donor_id", r6("target").alias("target"))


@query("""WITH f AS (SELECT c_nationkey, c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)
SELECT s_suppkey, c_custkey, c_mktsegment FROM supplier JOIN f ON s_nationkey = c_nationkey""")
def keep_first_join(spark, root):
    cells = table(spark, root, "supplier").select("s_suppkey", F.col("s_nationkey").alias("donor_id"))
    donors = table(spark, root, "customer").select(F.col("c_nationkey").alias("donor_id"), "c_custkey", "c_mktsegment")
    return joins.complete_donor_join(cells, donors, "c_custkey").drop("donor_id")


@query("SELECT c_custkey, c_nationkey AS donor_id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 5)")
def anti_join_missing(spark, root):
    cells = table(spark, root, "customer").select("c_custkey", F.col("c_nationkey").alias("donor_id"))
    return joins.unmatched(cells, table(spark, root, "supplier").where("s_suppkey <= 5").select(F.col("s_nationkey").alias("donor_id")))


@query(f"{cohort.sql('preds', 'runs')} SELECT a.seed, donor_id, round(a.predicted - b.predicted, 6) AS gap FROM runs a JOIN runs b USING (seed, donor_id) WHERE a.arm = 'A' AND b.arm = 'B'")
def paired_predictions(spark, root):
    runs = cohort.runs(spark, root)
    both = joins.paired(runs.where("arm = 'A'"), runs.where("arm = 'B'"), ["seed", "donor_id"])
    return both.select("seed", "donor_id", r6(F.col("predicted_a") - F.col("predicted_b")).alias("gap"))


@query("""WITH a AS (SELECT c_nationkey AS donor_id, round(avg(c_acctbal), 6) AS x FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL),
b AS (SELECT s_nationkey AS donor_id, round(avg(s_acctbal), 6) AS x FROM supplier GROUP BY ALL)
SELECT donor_id, coalesce(a.x, 0) AS x, coalesce(b.x, 0) AS x_r FROM a FULL JOIN b USING (donor_id)""")
def outer_block_join(spark, root):
    a = table(spark, root, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("donor_id")).agg(r6(F.avg("c_acctbal")).alias("x"))
    b = table(spark, root, "supplier").groupBy(F.col("s_nationkey").alias("donor_id")).agg(r6(F.avg("s_acctbal")).alias("x"))
    return joins.feature_blocks(a, b)


@query("SELECT s_suppkey AS ord, n_nationkey AS donor_id, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def alignment_join(spark, root):
    driving = table(spark, root, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").alias("donor_id"))
    return joins.aligned(driving, table(spark, root, "nation").select(F.col("n_nationkey").alias("donor_id"), "n_name"), "donor_id", "ord")


@query(f"""{cohort.sql('expr')}, src AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size <= 25 UNION SELECT 'ABSENT'),
l AS (SELECT cell_id, gene, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell_id)) AS v FROM expr WHERE gene <> 'Brand#11')
SELECT gene, count(*) AS n, round(sum(v), 4) AS total, (SELECT count(*) FROM src) AS n_source, (SELECT count(*) FROM src WHERE gene IN (SELECT gene FROM l)) AS n_found FROM l SEMI JOIN src USING (gene) GROUP BY gene""")
def gene_space_projection(spark, root):
    names = table(spark, root, "part").where("p_size <= 25").select(F.col("p_brand").alias("gene")).union(spark.sql("select 'ABSENT'")).distinct()
    on, cover = joins.gene_space(cohort.expr(spark, root).where("gene <> 'Brand#11'"), names.withColumn("ord", F.col("gene")))
    sums = on.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.join(F.broadcast(cover.select("n_source", "n_found")))


@query(f"""{cohort.sql('expr')}, a AS (SELECT * FROM expr WHERE cell_id % 2 = 0 AND gene < 'Brand#4'), b AS (SELECT * FROM expr WHERE cell_id % 2 = 1 AND gene > 'Brand#2'),
s AS (SELECT gene FROM a INTERSECT SELECT gene FROM b) SELECT gene, count(*) AS n, sum(value) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) SEMI JOIN s USING (gene) GROUP BY gene""")
def shared_genes(spark, root):
    e = cohort.expr(spark, root)
    both = joins.shared_genes(e.where("cell_id % 2 = 0 and gene < 'Brand#4'"), e.where("cell_id % 2 = 1 and gene > 'Brand#2'"))
    return both.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT c_custkey, coalesce(n_name, 'No description.') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def lookup_default(spark, root):
    names = table(spark, root, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(table(spark, root, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name", "No description.").select("c_custkey", "n_name")


@query(f"{cohort.sql('obs')}, {_SPLIT} SELECT DISTINCT donor_id FROM obs EXCEPT SELECT donor_id FROM split WHERE is_test")
def donor_difference(spark, root):
    obs = cohort.obs(spark, root)
    return joins.donor_difference(obs, prep.donor_split(obs, 7).where("is_test"))


@query("""WITH s AS (SELECT * FROM part ORDER BY p_partkey LIMIT 2000), k AS (SELECT DISTINCT upper(p_brand) AS k FROM part WHERE p_size < 30 UNION SELECT DISTINCT upper(p_type) FROM part WHERE p_size < 3),
l AS (SELECT 'p_brand' AS candidate, upper(p_brand) AS v FROM s UNION ALL SELECT 'p_type', upper(p_type) FROM s UNION ALL SELECT 'p_name', upper(p_name) FROM s)
SELECT candidate, round(avg(CASE WHEN v IN (SELECT k FROM k) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM l GROUP BY candidate""")
def best_key_selection(spark, root):
    part = table(spark, root, "part")
    known = part.where("p_size < 30").select(F.col("p_brand").alias("id")).union(part.where("p_size < 3").select("p_type"))
    return joins.key_hit_rates(part, ["p_brand", "p_type", "p_name"], known, "id", order="p_partkey").withColumn("rate", r6("rate"))


@query("""WITH s AS (SELECT * FROM part ORDER BY p_partkey LIMIT 2000), k AS (SELECT DISTINCT upper(p_brand) AS k FROM part WHERE p_size < 30 UNION SELECT DISTINCT upper(p_type) FROM part WHERE p_size < 3),
l AS (SELECT 2 AS i, 'p_type' AS c, upper(p_type) AS v FROM s UNION ALL SELECT 1, 'p_name', upper(p_name) FROM s UNION ALL SELECT 3, 'p_brand', upper(p_brand) FROM s),
r AS (SELECT i, c, avg(CASE WHEN v IN (SELECT k FROM k) THEN 1.0 ELSE 0.0 END) AS rate FROM l GROUP BY ALL),
b AS (SELECT c, rate FROM r ORDER BY rate > 0.8 DESC, CASE WHEN rate > 0.8 THEN i ELSE -rate END, i LIMIT 1)
SELECT p_partkey, CASE c WHEN 'p_type' THEN p_type WHEN 'p_brand' THEN p_brand ELSE p_name END AS id, c AS picked, round(rate, 6) AS rate FROM part, b""")
def picked_key(spark, root):
    """All rows with the values of the best of three key columns."""
    part = table(spark, root, "part")
    known = part.where("p_size < 30").select(F.col("p_brand").alias("id")).union(part.where("p_size < 3").select("p_type"))
    rows, name, rate = joins.pick_key(part, ["absent", "p_name", "p_type", "p_brand"], known, "id", order="p_partkey")
    return rows.select("p_partkey", "id", F.lit(name).alias("picked"), F.round(F.lit(rate), 6).alias("rate"))


@query(f"""{cohort.sql('obs')}, {_SPLIT} SELECT donor_id, {', '.join(f"round(avg((cell_type = '{t}')::INT), 6) AS \"{t}\"" for t in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))} FROM obs WHERE cell_type <> '5-LOW' OR donor_id IN (SELECT donor_id FROM split WHERE is_test) GROUP BY donor_id""")
def onehot_train_vocabulary(spark, root):
    """A column for each type that train donors have; a type that only test donors have counts in their totals alone."""
    obs = cohort.obs(spark, root)
    split = prep.donor_split(obs, 7)
    cells = obs.join(split, "donor_id").where("cell_type <> '5-LOW' or is_test")
    types = features.train_types(cells, split)
    return features.composition_wide(cells, types).select("donor_id", *(F.round(F.col(f"`{t}`"), 6).alias(t) for t in types))


@query(f"""{cohort.sql('obs', 'expr')}, l AS (SELECT cell_id, gene, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell_id)) AS v FROM expr), n AS (SELECT count(*) AS n FROM obs),
t AS (SELECT gene FROM l CROSS JOIN n GROUP BY gene ORDER BY round(sum(v * v) / max(n) - (sum(v) / max(n)) ** 2, 9) DESC, gene LIMIT 6)
SELECT 'd' || CAST({u('CAST(cell_id AS VARCHAR)', "'5'")} % 3 AS VARCHAR) AS donor_id, gene, count(*) AS n, round(sum(v), 4) AS total FROM l SEMI JOIN t USING (gene) JOIN obs USING (cell_id) GROUP BY ALL""")
def sample_dataset(spark, root):
    """A data set's most variable genes over pseudo-donors."""
    obs, values = prep.load_sample(cohort.obs(spark, root), prep.normalize_log1p(cohort.expr(spark, root)), 6, seed=5)
    return values.join(obs, "cell_id").groupBy("donor_id", "gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT 'donor' AS kind, donor_id AS name, count(*) AS n FROM obs GROUP BY donor_id UNION ALL SELECT 'type', cell_type, count(*) FROM obs GROUP BY cell_type UNION ALL SELECT 'all', 'all', count(*) FROM obs".replace("SELECT 'donor'", f"{cohort.sql('obs')} SELECT 'donor'", 1))
def dataset_manifest(spark, root):
    return report.dataset_manifest(cohort.obs(spark, root))


@query("""WITH l AS (SELECT unnest([{'c': 'c_mktsegment', 'v': c_mktsegment}, {'c': 'c_nationkey', 'v': CAST(c_nationkey AS VARCHAR)}, {'c': 'c_name', 'v': c_name}]) AS x FROM customer),
g AS (SELECT x.c AS "column", x.v AS value, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY "column") AS k FROM g)
SELECT "column", value, n FROM k WHERE k <= 30 UNION ALL SELECT "column", NULL, max(k) FROM k WHERE k > 30 GROUP BY 1""")
def column_profile(spark, root):
    return report.profile(table(spark, root, "customer"), ["c_mktsegment", "c_nationkey", "c_name"])


@query(f"""{cohort.sql('obs')} SELECT cell_id, cell_type, r_name AS title FROM obs JOIN region ON region = CAST(r_regionkey AS VARCHAR) WHERE contains(lower(r_name), 'a') AND cell_type LIKE '%URGENT' AND cell_id % 3 <> 0""")
def source_cells(spark, root):
    """Primary cells of one kind from the data sets whose title has a text."""
    names = table(spark, root, "region").select(F.col("r_regionkey").cast("string").alias("dataset_id"), F.col("r_name").alias("title"))
    cells = cohort.obs(spark, root).select("cell_id", "cell_type", F.col("region").alias("dataset_id"), F.substring_index("cell_type", "-", -1).alias("tissue_general"), (F.col("cell_id") % 3 != 0).alias("is_primary_data"))
    return readers.source_scan(cells, names, "A", "URGENT").join(names, "dataset_id").select("cell_id", "cell_type", "title")


@query(f"""{cohort.sql('obs', 'expr')}, w AS (SELECT cell_id, row_number() OVER (PARTITION BY donor_id ORDER BY {u('cell_id', "'5'")}, cell_id) AS ord FROM obs WHERE region = '2') SELECT cell_id, ord, gene, value FROM w JOIN expr USING (cell_id)""")
def cells_in_order(spark, root):
    """Counts of one region's cells beside the place that was asked for."""
    w = Window.partitionBy("donor_id").orderBy(keyed("cell_id", 5), "cell_id")
    wanted = cohort.obs(spark, root).where("region = '2'").select("cell_id", F.row_number().over(w).alias("ord"))
    return prep.cells_in_order(cohort.expr(spark, root), wanted).select("cell_id", "ord", "gene", "value")


_HISTORICAL = f"""{cohort.sql('obs', 'expr')}, kc AS (SELECT cell_id FROM expr WHERE value > 0 GROUP BY ALL HAVING count(*) >= 2), ke AS (SELECT * FROM expr SEMI JOIN kc USING (cell_id)),
kg AS (SELECT gene FROM ke WHERE value > 0 GROUP BY ALL HAVING count(*) >= 3), n AS (SELECT count(*)::DOUBLE AS n FROM obs),
l AS (SELECT cell_id, gene, value * 10000 / sum(value) OVER (PARTITION BY cell_id) AS x FROM ke SEMI JOIN kg USING (gene)),
s AS (SELECT gene, sum(x) / (SELECT n FROM n) AS mu, sum(x * x) AS ss FROM l GROUP BY gene),
d AS (SELECT gene, ln(1 + mu) AS m, ln(((ss - n * mu * mu) / (n - 1)) / mu) AS d FROM s, n),
b AS (SELECT *, least(19, coalesce(CAST(floor((m - min(m) OVER ()) / nullif((max(m) OVER () - min(m) OVER ()) / 20, 0)) AS INTEGER), 0)) AS bin FROM d),
z AS (SELECT gene, CASE WHEN count(d) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE coalesce((d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0), 0) END AS z FROM b),
top AS (SELECT gene FROM z ORDER BY round(z, 9) DESC, gene LIMIT 15)
SELECT gene, count(*) AS n_cells, round(sum(ln(1 + x)), 3) AS total FROM l SEMI JOIN top USING (gene) GROUP BY gene"""


@query(_HISTORICAL)
def historical_preprocess(spark, root):
    """Filters and variable genes over all cells, as runs before the donor folds had them."""
    got = prep.preprocess_all(cohort.expr(spark, root), cohort.obs(spark, root).count(), 2, 3, 15)
    return got.groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells"), (F.round(F.sum("value"), 3) + 0.0).alias("total"))
