"""Rank tokens of cells and cell sets for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapsed(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cell_id, target, value): counts of ids that share a target are summed; ids without one go."""
    return expr.join(mapping, "gene").groupBy("cell_id", "target").agg(F.sum("value").alias("value"))


def rank_tokens(expr: DataFrame, mapping: DataFrame, dictionary: DataFrame, max_len: int, cls: int | None = None, eos: int | None = None, per: float = 1e4) -> DataFrame:
    """(cell_id, tokens): tokens by count / library size · ``per`` / the target's median, largest first, ties by token.

    ``mapping(gene, target)``, ``dictionary(target, token, median)``.  The library
    size is over all genes, mapped or not; none counts as 1.  Only non-zero
    values; cells without tokens are left out; with cls and eos the sequence is
    cut to leave room for them.
    """
    size = expr.groupBy("cell_id").agg(F.sum("value").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    values = collapsed(expr, mapping).where("value > 0").join(dictionary, "target").join(size, "cell_id")
    scored = values.select("cell_id", "token", F.round(F.col("value") / F.col("s") * per / F.col("median"), 9).alias("v"))
    room = max_len - (cls is not None) - (eos is not None)
    k = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("v"), "token"))
    listed = scored.withColumn("k", k).where(F.col("k") <= room).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("l"))
    tokens = F.transform("l", lambda x: x["token"])
    if cls is not None:
        tokens = F.concat(F.array(F.lit(cls).cast("long")), tokens)
    if eos is not None:
        tokens = F.concat(tokens, F.array(F.lit(eos).cast("long")))
    return listed.select("cell_id", tokens.alias("tokens"))


def cell_sets(expr: DataFrame, vocabulary: DataFrame, cls: int) -> DataFrame:
    """(cell_id, genes, values): non-zero genes as vocabulary ids behind a class token (value 0); unknown genes are -1."""
    known = expr.where("value > 0").join(vocabulary, "gene", "left").select("cell_id", F.coalesce("id", F.lit(-1)).alias("id"), "value")
    listed = known.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("l"))
    return listed.select("cell_id", F.concat(F.array(F.lit(cls)), F.transform("l", lambda x: x["id"])).alias("genes"), F.concat(F.array(F.lit(0.0)), F.transform("l", lambda x: x["value"])).alias("values"))
