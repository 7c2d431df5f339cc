"""Queries: text vectors, the text arms of a fold, differences over state blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import arms, captions, contrast, features, infer, markers, retrieve, vectors
from ..sources import cohort, shared
from ..sources.readers import table
from .analysis import _avg_rank
from .cohorts import _fold
from .registry import corr, query, u

DIM = 32
_caches: dict[str, vectors.Cache] = {}


def text_cache(spark) -> vectors.Cache:
    """One cache in an application: what is projected once isn't again."""
    app = spark.sparkContext.applicationId
    if app not in _caches:
        _caches[app] = vectors.Cache(spark, shared.folder(spark, "vectors"), DIM)
    return _caches[app]


_VECTORS = f"""w AS (SELECT doc_id, source, term, count(*) AS n FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
h AS (SELECT *, {u('term', "'0'")} AS h FROM w), p AS (SELECT doc_id, source, h % {DIM} AS dim, CAST(sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN n ELSE -n END) AS DOUBLE) AS x FROM h GROUP BY ALL),
v AS (SELECT doc_id, source, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM p)"""


@query(f"WITH {_VECTORS} SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS value FROM v WHERE x <> 0")
def text_vectors(spark, root):
    """The vectors of all documents' texts, by way of the cache."""
    got = text_cache(spark).vectors(table(spark, root, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.posexplode("vector").alias("dim", "value")).where("value <> 0").select("doc_id", "dim", r6("value").alias("value"))


@query(f"WITH {_VECTORS} SELECT d.source, CAST(k AS INTEGER) AS dim, round(sum(coalesce(x, 0)) / count(*), 6) + 0.0 AS value FROM documents d CROSS JOIN range({DIM}) r(k) LEFT JOIN v ON v.doc_id = d.doc_id AND v.dim = k GROUP BY ALL")
def mean_text_vectors(spark, root):
    """The mean vector of each source's texts."""
    got = text_cache(spark).vectors(table(spark, root, "documents").select("source", "text"))
    return vectors.mean_vectors(got, "source").select("source", F.posexplode("vector").alias("dim", "value")).select("source", "dim", r6("value").alias("value"))


def text_banks(spark, root, obs, expr) -> dict[str, dict[str, np.ndarray]]:
    """Class vectors of the text arms: one-hot (T0), random (T1), marker captions (T2), retrieved texts (T3, a source for each class), and T2's dealt anew (N2)."""
    kinds = shared.written(obs.select("cell_type").distinct(), "kinds")
    as_bank = lambda rows, key: {r[key]: np.nan_to_num(np.array(r["vector"], float)) for r in rows}  # noqa: E731  a row for each class; a text without a direction is zeros here
    top = markers.top_n(markers.mean_difference(expr, obs), "diff", 4, "class")
    listed = shared.written(captions.class_captions(top, 4).select("class", "caption"), "captions")
    sources = retrieve.excerpts(cohort.articles(spark, root), ["doc_id"], "mesh")
    number = F.row_number().over(_by("mesh")).alias("k")
    places = kinds.select("cell_type", F.row_number().over(_by("cell_type")).alias("k"))  # a row for each class
    told = places.join(sources.select("excerpt", number), "k").select(F.col("cell_type").alias("class"), F.col("excerpt").alias("caption"))
    texts = {"T2": listed, "T3": told, "N2": infer.permuted(listed, "class", "caption", 1, 888)}
    named = [t.select(F.lit(arm).alias("arm"), "class", F.col("caption").alias("text")) for arm, t in texts.items()]
    every = shared.written(named[0].unionByName(named[1]).unionByName(named[2]), "texts")
    seen = text_cache(spark).vectors(every).collect()  # a row for each class and arm
    return {
        "T0": as_bank(features.onehot_prototypes(kinds, "cell_type").collect(), "cell_type"),
        "T1": as_bank(features.random_prototypes(kinds, "cell_type", DIM, 3).collect(), "cell_type"),
        **{arm: as_bank([r for r in seen if r["arm"] == arm], "class") for arm in texts},
    }


def _by(name: str):
    from pyspark.sql import Window

    return Window.orderBy(name)


@query()
def text_arms(spark, root):
    """Text arms of a fold beside composition, by the linear stand-in; training has no SQL, it is held against numpy in the tests."""
    # cells and counts are made once; all that follows reads them
    obs, expr = shared.written(cohort.obs(spark, root), "obs"), shared.written(cohort.expr(spark, root), "expr")
    donors, shares, _ = _fold(spark, root, obs, expr)
    donors = shared.written(donors, "fold")
    train = obs.join(donors.where("not is_test").select("donor_id"), "donor_id", "left_semi")
    known = expr.join(train.select("cell_id"), "cell_id", "left_semi")
    banks = text_banks(spark, root, train, known)
    logged = expr.withColumn("value", F.log1p("value"))
    genes = [r[0] for r in known.select("gene").distinct().orderBy("gene").limit(contrast.MOST_FEATURES + 1).collect()]
    blocks, _ = contrast.donor_block(logged, obs.select("cell_id", "donor_id", "cell_type"), donors, genes, banks, seed=3, rounds=4)
    got = arms.run_fold(donors, {"B0": shares, **blocks}, ["B0", *blocks], captioned=list(banks))
    return got.select("arm", "donor_id", (F.round("observed", 4) + 0.0).alias("observed"), (F.round("predicted", 4) + 0.0).alias("predicted"))


_BLOCKS = f"""{cohort.sql('preds')}, pairs AS (SELECT 'b' || CAST(donor_id AS INTEGER) % 3 AS block, donor_id, observed AS o, pa, pb FROM preds),
d AS (SELECT block, donor_id, row_number() OVER (PARTITION BY block ORDER BY donor_id) - 1 AS i, count(*) OVER (PARTITION BY block) AS n FROM pairs),
slots AS (SELECT DISTINCT block, n, rep, unnest(range(0, n)) AS slot FROM (SELECT DISTINCT block, n FROM d), range(30) r(rep)),
b AS (SELECT s.block, rep, o, pa, pb FROM (SELECT block, rep, {u("rep || '#' || slot", "'31'")} % n AS i FROM slots) s JOIN d USING (block, i) JOIN pairs USING (block, donor_id)),
rr AS (SELECT block, rep, {_avg_rank('o', 'block, rep')} AS o, {_avg_rank('pa', 'block, rep')} AS a, {_avg_rank('pb', 'block, rep')} AS b FROM b),
reps AS (SELECT * FROM (SELECT block, rep, {corr('o', 'a')} - {corr('o', 'b')} AS d FROM rr GROUP BY ALL HAVING count(*) >= 3) WHERE d IS NOT NULL),
pr AS (SELECT block, {_avg_rank('o', 'block')} AS o, {_avg_rank('pa', 'block')} AS a, {_avg_rank('pb', 'block')} AS b FROM pairs),
point AS (SELECT block, CASE WHEN count(*) >= 3 THEN {corr('o', 'a')} - {corr('o', 'b')} END AS d, count(*) AS n FROM pr GROUP BY block),
every AS (SELECT block, rep, d FROM reps UNION ALL SELECT 'all', rep, avg(d) FROM reps GROUP BY rep),
points AS (SELECT * FROM point UNION ALL SELECT 'all', avg(d), CAST(sum(n) AS BIGINT) FROM point),
ends AS (SELECT block, avg(d) AS mean_delta, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, count(*) AS n_valid FROM every GROUP BY block)"""


@query(f"{_BLOCKS} SELECT block, round(d, 6) + 0.0 AS delta_rho, n, round(mean_delta, 6) + 0.0 AS mean_delta, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, coalesce(n_valid, 0) AS n_valid FROM points LEFT JOIN ends USING (block)")
def state_block_differences(spark, root):
    """Two readouts compared within three blocks of donors, and over the blocks."""
    p = cohort.preds(spark, root)
    pairs = p.select(F.concat(F.lit("b"), F.col("donor_id").cast("int") % 3).alias("block"), "donor_id", F.col("observed").alias("observed_a"), F.col("pa").alias("predicted_a"), F.col("pb").alias("predicted_b"))
    got = infer.block_differences(pairs, 30, 31)
    return got.select("block", *(r6(c).alias(c) for c in ("delta_rho", "mean_delta", "ci_low", "ci_high")), "n", "n_valid")
