"""Queries that go through files: run stores, releases, line and table files, manifests and their digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import features, report
from ..sources import cohort, readers, results, sinks
from ..sources.readers import table
from ..sources.shared import folder
from .registry import query

_KEYS = ["arm", "seed"]
_IDS = "sha256(unhex(string_agg(printf('%016x', strlen(donor_id)) || hex(donor_id), '' ORDER BY donor_id)))"


def _stored(spark, root):
    runs = cohort.runs(spark, root)
    config = F.to_json(F.struct((F.lit(1.0) / (F.col("seed") + 1)).alias("rate"), (F.col("seed") * 10).alias("rounds")))
    settings = runs.select(*_KEYS).distinct().where("not (arm = 'B' and seed = 2)").withColumn("settings", config)
    return runs, results.write_runs(runs, folder(spark, "run-store"), _KEYS, settings)


@query(f"""{cohort.sql('runs')}, b AS (SELECT arm, seed, substr(sha256(donor_id), 1, 3) AS b, {_IDS} AS s FROM runs GROUP BY ALL), d AS (SELECT arm, seed, sha256(string_agg(b || s, '' ORDER BY b)) AS ids_sha256 FROM b GROUP BY ALL)
SELECT arm, CAST(seed AS VARCHAR) AS seed, count(*) AS n_rows, any_value(ids_sha256) AS ids_sha256, round(avg(abs(observed - predicted)), 6) AS mae,
CASE WHEN arm = 'B' AND seed = 2 THEN NULL ELSE 1.0::DOUBLE / (seed + 1) END AS rate, CASE WHEN arm = 'B' AND seed = 2 THEN NULL ELSE seed * 10 END AS rounds, 'complete' AS status FROM runs JOIN d USING (arm, seed) GROUP BY arm, seed""")
def stored_runs(spark, root):
    """Runs written and read back: errors, settings with their types from the manifests, and whether each run is whole."""
    runs, path = _stored(spark, root)
    found, manifests = results.read_runs(spark, path, _KEYS), results.read_manifests(spark, path, _KEYS)
    status = results.run_status(runs.select(*_KEYS).distinct(), manifests, found, _KEYS)
    typed = report.typed_config(manifests, "settings", "rate double, rounds int")
    mae = found.groupBy(*_KEYS).agg(r6(F.avg(F.abs(F.col("observed") - F.col("predicted")))).alias("mae"))
    rows = mae.join(typed, _KEYS).join(status, _KEYS)
    return rows.select(*_KEYS, "n_rows", "ids_sha256", "mae", "settings.rate", "settings.rounds", "status")


@query(f"""{cohort.sql('runs')}, f AS (SELECT arm, seed, count(*) AS n FROM runs GROUP BY ALL), want AS (SELECT arm, s AS seed FROM (VALUES ('A'), ('B')) a(arm), range(4) t(s) WHERE NOT (arm = 'A' AND s = 0))
SELECT arm, CAST(seed AS VARCHAR) AS seed, CASE WHEN arm = 'A' AND seed = 0 THEN 'not expected' WHEN n IS NULL OR (arm = 'A' AND seed = 1) THEN 'no manifest' WHEN arm = 'B' AND seed = 0 THEN 'no results'
WHEN arm = 'B' AND seed = 1 THEN 'rows differ' WHEN arm = 'B' AND seed = 2 THEN 'ids differ' ELSE 'complete' END AS status FROM want FULL JOIN f USING (arm, seed)""")
def stored_run_status(spark, root):
    """What the check of a store says of runs that are lost, damaged or weren't asked for."""
    runs, path = _stored(spark, root)
    a, b, seed = F.col("arm") == "A", F.col("arm") == "B", F.col("seed")
    expected = spark.range(4).select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm"), F.col("id").alias("seed")).where(~(a & (seed == 0)))
    manifests = results.read_manifests(spark, path, _KEYS).where(~(a & (seed == "1")))
    found = results.read_runs(spark, path, _KEYS).where(~(b & (seed == "0")))
    once = found.where(b & (seed == "1"))
    damaged = found.unionByName(once).withColumn("donor_id", F.when(b & (seed == "2"), F.concat("donor_id", F.lit("x"))).otherwise(F.col("donor_id")))
    return results.run_status(expected, manifests, damaged, _KEYS)


@query("SELECT doc_id, coalesce(length(text), 0) AS n FROM (SELECT doc_id, text, row_number() OVER w - 1 AS i, coalesce(sum(length(text)) OVER w, 0) - coalesce(length(text), 0) AS b FROM documents WINDOW w AS (ORDER BY source NULLS FIRST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE i < 1100 AND b < 400000")
def line_file_budget(spark, root):
    """Documents written as lines in files by source, then read file by file until 1,100 of them or 400,000 characters."""
    path = folder(spark, "lines")
    docs = table(spark, root, "documents").repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    sinks.json_lines(docs, path, ["source", "doc_id", "text"])
    rows = readers.json_lines_within(spark, [f"{path}/*.json"], "source string, doc_id long, text string", "text", 1100, 400_000)
    return rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))


@query("SELECT o_orderpriority AS cell_type, o_orderstatus AS state, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def packed_table_file(spark, root):
    """Orders through compressed files of tab-separated values."""
    path = folder(spark, "tsv")
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    sinks.csv(orders, path, sep="\t", compression="gzip")
    rows = readers.csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", sep="\t")
    return rows.groupBy(F.col("o_orderpriority").alias("cell_type"), F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""{cohort.sql('obs')}, t AS (SELECT cell_type, count(*) AS n, count(DISTINCT donor_id) AS d FROM obs GROUP BY ALL),
f AS (SELECT sha256('{{' || string_agg('"' || cell_type || '": [' || n || ', ' || d || ']', ', ' ORDER BY cell_type) || '}}') AS sha256 FROM t)
SELECT cell_type, n AS n_cells, d AS n_donors, sha256 FROM t, f""")
def manifest_file(spark, root):
    """Cells and donors of each type as one JSON file, read back beside the file's digest."""
    path = sinks.reserve_output(spark, folder(spark, "manifest")) + "/types.json"
    types = cohort.obs(spark, root).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("donor_id").alias("d"))
    sinks.manifest(spark, path, {r.cell_type: [r.n, r.d] for r in types.collect()}, None)  # a row for each type
    rows = readers.json_map(spark, path, "array<long>")
    digest = readers.file_hashes(spark, path).select("sha256")
    return rows.join(F.broadcast(digest)).select(F.col("key").alias("cell_type"), F.col("value")[0].alias("n_cells"), F.col("value")[1].alias("n_donors"), "sha256")


@query(f"""{cohort.sql('obs', 'donors')}, c AS (SELECT donor_id, cell_type, count(*) AS n FROM obs GROUP BY ALL), s AS (SELECT donor_id, cell_type, n / sum(n) OVER (PARTITION BY donor_id) AS f FROM c),
h AS (SELECT donor_id, max(f) AS top_share FROM s GROUP BY donor_id) SELECT donor_id, round(target, 6) AS target, round(top_share, 6) AS top_share FROM donors LEFT JOIN h USING (donor_id)""")
def released_tables(spark, root):
    """Donors and their composition released together, then joined from the release."""
    path = folder(spark, "release")
    sinks.release(spark, path, {"donors": cohort.donors(spark, root), "composition": features.composition(cohort.obs(spark, root))}, ("donors", "composition"))
    top = readers.released(spark, path, "composition").groupBy("donor_id").agg(F.max("fraction").alias("top_share"))
    return readers.released(spark, path, "donors").join(top, "donor_id", "left").select("donor_id", r6("target").alias("target"), r6("top_share").alias("top_share"))


@query(f"""{cohort.sql('obs')}, d AS (SELECT DISTINCT cell_type, donor_id FROM obs) SELECT cell_type, count(*) AS n, {_IDS} AS sha256 FROM d GROUP BY cell_type""")
def donor_id_digests(spark, root):
    """Digest of each cell type's donors in order, told beside their number."""
    donors = cohort.obs(spark, root).select("cell_type", "donor_id").distinct()
    n = donors.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(sinks.ordered_ids_sha256(donors, "donor_id", "donor_id", "cell_type"), "cell_type")
