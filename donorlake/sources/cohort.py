"""The cohort as views over the star-schema tables.

A cell is an order, its donor the customer's nation, its type the priority; a
gene is a part's brand and its count the ordered quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import keyed
from .readers import table

#: Common table expressions of the same views for an SQL engine.
SQL = {
    "obs": "obs AS (SELECT DISTINCT l_orderkey AS cell_id, CAST(c_nationkey AS VARCHAR) AS donor_id, o_orderpriority AS cell_type, CAST(n_regionkey AS VARCHAR) AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "expr": "expr AS (SELECT l_orderkey AS cell_id, p_brand AS gene, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "donors": "donors AS (SELECT CAST(c_nationkey AS VARCHAR) AS donor_id, avg(c_acctbal) AS target FROM customer GROUP BY ALL)",
    "emb": "emb AS (SELECT vec_id AS cell_id, CAST(vec_id % 20 AS VARCHAR) AS donor_id, label AS cell_type, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)",
    "articles": "articles AS (SELECT doc_id, split_part(text, '.', 1) AS title, text AS abstract, source AS mesh, lang FROM documents)",
    "preds": "preds AS (SELECT CAST(l_suppkey AS VARCHAR) AS donor_id, avg(l_quantity) AS observed, avg(l_extendedprice) AS pa, avg(l_discount) AS pb FROM lineitem GROUP BY ALL)",
    "runs": "runs AS (SELECT CAST(s AS INTEGER) AS seed, arm, donor_id, observed, CASE arm WHEN 'A' THEN pa ELSE pb END AS predicted FROM preds, range(3) t(s), (VALUES ('A'), ('B')) a(arm) WHERE ('0x' || substr(md5(donor_id || '|' || CAST(s AS VARCHAR)), 1, 8))::UBIGINT % 4 = 0)",
}


def sql(*names: str) -> str:
    """WITH clause of some views (those they need first)."""
    wanted = [n for n in SQL if n in names or n == "preds" and "runs" in names]
    return "WITH " + ",\n".join(SQL[n] for n in wanted)


def obs(spark: SparkSession, root: str) -> DataFrame:
    cells = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("cell_id")).distinct()
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("cell_id"), "o_custkey", F.col("o_orderpriority").alias("cell_type"))
    customer = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("region"))
    named = orders.join(cells, "cell_id", "left_semi").join(customer, "o_custkey").join(nation, "c_nationkey")
    return named.select("cell_id", F.col("c_nationkey").cast("string").alias("donor_id"), "cell_type", "region").distinct()


def expr(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("cell_id"), "l_partkey", "l_quantity")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    return lines.join(part, "l_partkey").groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("value"))


def donors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").groupBy(F.col("c_nationkey").cast("string").alias("donor_id")).agg(F.avg("c_acctbal").alias("target"))


def emb(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 20).cast("string").alias("donor_id"), F.col("label").alias("cell_type"), F.col("embedding").cast("array<double>").alias("embedding"))


def articles(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("mesh"), "lang")


def preds(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("donor_id")).agg(F.avg("l_quantity").alias("observed"), F.avg("l_extendedprice").alias("pa"), F.avg("l_discount").alias("pb"))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of two arms over three seeds, each with about a quarter of the donors."""
    seeds = F.explode(F.array(*[F.lit(s) for s in range(3)]))
    arms = F.explode(F.array(F.struct(F.lit("A").alias("arm"), F.col("pa").alias("predicted")), F.struct(F.lit("B").alias("arm"), F.col("pb").alias("predicted"))))
    p = preds(spark, root).select("donor_id", "observed", "pa", "pb", seeds.alias("seed"))
    p = p.where(keyed("donor_id", F.col("seed")) % 4 == 0).select("seed", "donor_id", "observed", arms.alias("x"))
    return p.select("seed", "x.arm", "donor_id", "observed", "x.predicted")
