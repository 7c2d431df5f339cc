"""Queries: the composite region loader and running budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import prep
from ..sources import cohort, readers
from ..sources.readers import table
from .registry import query, u

_REGION = f"""{cohort.sql('obs', 'expr')}, here AS (SELECT * FROM obs WHERE region = '1'), kinds AS (SELECT cell_type FROM here GROUP BY ALL HAVING count(*) >= 40), rest AS (SELECT * FROM here SEMI JOIN kinds USING (cell_type)),
total AS (SELECT count(*) AS total FROM rest), k AS (SELECT *, row_number() OVER (PARTITION BY donor_id, cell_type ORDER BY {u('cell_id', "'11'")}, cell_id) AS k, count(*) OVER (PARTITION BY donor_id, cell_type) AS n FROM rest),
kept AS (SELECT cell_id, donor_id, cell_type FROM k, total WHERE total <= 150 OR k <= greatest(1, round_even(n * (150.0::DOUBLE / total), 0))),
scores AS (SELECT CAST(n_nationkey AS VARCHAR) AS donor_id, avg(c_acctbal) AS cps FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 7 <> 0 GROUP BY ALL),
firsts AS (SELECT donor_id, arg_min(cell_type, cell_id) AS braak FROM kept GROUP BY donor_id)"""


@query(f"{_REGION} SELECT cell_id, donor_id, cell_type, round(cps, 6) AS score, braak, count(gene) AS n_values, round(coalesce(sum(value), 0), 4) AS total FROM kept LEFT JOIN scores USING (donor_id) JOIN firsts USING (donor_id) LEFT JOIN expr USING (cell_id) GROUP BY ALL")
def region_load(spark, root):
    """One region's cells, sampled by donor and type, with scores, counts and donor table."""
    cells = cohort.obs(spark, root).withColumn("braak", F.col("cell_type"))
    nation = table(spark, root, "nation").where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("region"))
    scores = table(spark, root, "customer").join(nation, "c_nationkey").groupBy(F.col("c_nationkey").cast("string").alias("donor_id"), "region").agg(F.avg("c_acctbal").alias("CPS_Global"))
    kept, counts, donors = prep.load_region(cells, cohort.expr(spark, root), "1", scores, 150, 40, 11)
    sums = counts.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_values"), F.sum("value").alias("total"))
    rows = kept.select("cell_id", "donor_id", "cell_type", r6("CPS_Global").alias("score")).join(donors.select("donor_id", "braak"), "donor_id").join(sums, "cell_id", "left").na.fill(0, ["n_values", "total"])
    return rows.select("cell_id", "donor_id", "cell_type", "score", "braak", "n_values", (F.round("total", 4) + 0.0).alias("total"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER w - 1 AS i, sum(length(text)) OVER w - length(text) AS b FROM documents WINDOW w AS (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE i < 900 AND b < 300000")
def running_budget(spark, root):
    """Documents by source until 900 of them or 300,000 characters are read."""
    return readers.within_budget(table(spark, root, "documents").select("source", "doc_id", "text"), ["source", "doc_id"], "text", 900, 300_000).select("doc_id")
