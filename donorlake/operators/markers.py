"""Marker features: mean differences, rank sums, precision at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _class_sizes(obs: DataFrame, label: str) -> DataFrame:
    return obs.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n_in"))


def mean_difference(expr: DataFrame, obs: DataFrame, label: str = "cell_type", least_cells: int = 2) -> DataFrame:
    """(class, gene, diff): mean inside minus mean outside, zeros included; classes below ``least_cells`` have none.

    Genes that no cell of the class has still have a row (its mean is 0).
    """
    n = obs.agg(F.count(F.lit(1)).alias("n_all"))
    sizes = _class_sizes(obs, label).where(F.col("n_in") >= least_cells).join(F.broadcast(n)).where("n_all > n_in")
    inside = expr.join(obs.select("cell_id", F.col(label).alias("class")), "cell_id").groupBy("class", "gene").agg(F.sum("value").alias("s_in"))
    total = inside.groupBy("gene").agg(F.sum("s_in").alias("s_all"))
    grid = total.join(F.broadcast(sizes))  # genes x classes, the size of the result
    full = grid.join(inside, ["class", "gene"], "left").na.fill(0.0, ["s_in"])
    return full.select("class", "gene", (F.col("s_in") / F.col("n_in") - (F.col("s_all") - F.col("s_in")) / (F.col("n_all") - F.col("n_in"))).alias("diff"))


def rank_sum(expr: DataFrame, obs: DataFrame, label: str = "cell_type") -> DataFrame:
    """(class, gene, z): one class against the rest by the normal approximation of the rank sum, without tie correction.

    Ranks are over all cells.  Zeros aren't stored: they share one block of
    ties of mean rank (n0 + 1) / 2, and non-zero ranks are shifted by n0.
    """
    cells = obs.select("cell_id", F.col(label).alias("class"))
    n = obs.agg(F.count(F.lit(1)).alias("n_all"))
    rows = expr.where("value > 0").join(cells, "cell_id")
    # a gene's values are counted before they are ranked, so a gene that all cells have is no longer than its distinct values
    values = rows.groupBy("gene", "value", "class").agg(F.count(F.lit(1)).alias("k"))
    each = values.groupBy("gene", "value").agg(F.sum("k").alias("ties"))
    below = F.coalesce(F.sum("ties").over(Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = each.select("gene", "value", (below + (F.col("ties") + 1) / 2).alias("rank"), F.sum("ties").over(Window.partitionBy("gene")).alias("nnz"))
    sums = values.join(ranks, ["gene", "value"]).groupBy("class", "gene").agg(F.sum(F.col("rank") * F.col("k")).alias("r"), F.sum("k").alias("k"), F.first("nnz").alias("nnz_c"))
    nnz = each.groupBy("gene").agg(F.sum("ties").alias("nnz"))
    grid = nnz.join(F.broadcast(_class_sizes(obs, label).join(F.broadcast(n))))
    full = grid.join(sums.drop("nnz_c"), ["class", "gene"], "left").na.fill(0, ["r", "k"])
    n0 = F.col("n_all") - F.col("nnz")
    n1, n2 = F.col("n_in"), F.col("n_all") - F.col("n_in")
    r = F.col("r") + F.col("k") * n0 + (n1 - F.col("k")) * (n0 + 1) / 2
    sd = F.sqrt(n1.cast("double") * n2 * (F.col("n_all") + 1) / 12)
    return full.select("class", "gene", ((r - n1 * (F.col("n_all") + 1) / 2) / F.nullif(sd, F.lit(0.0))).alias("z"))


def top_n(df: DataFrame, value: str, n: int, *by: str, tie: str = "gene") -> DataFrame:
    """The ``n`` largest rows of each group with their rank, ties by name."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    return df.withColumn("rank", k).where(F.col("rank") <= n)


def top_expressed(expr: DataFrame, n: int) -> DataFrame:
    """The largest positive values of each cell."""
    return top_n(expr.where("value > 0"), "value", n, "cell_id")


def precision_at_k(ranked: DataFrame, reference: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """(class, precision, ceiling, evaluable): of ``ranked(class, gene, score)`` against ``reference(class, gene)``.

    Excluded (class, gene) rows go before the first k are taken; the divisor is
    k even where fewer are left.  The ceiling is what the reference's genes
    among the ranked allow; without any the class isn't evaluable.
    """
    left = ranked.join(excluded, ["class", "gene"], "left_anti") if excluded is not None else ranked
    marked = left.join(reference.select("class", "gene", F.lit(1).alias("hit")), ["class", "gene"], "left")
    w = Window.partitionBy("class").orderBy(F.desc("score"), "gene")
    rows = marked.withColumn("_r", F.row_number().over(w))
    got = rows.groupBy("class").agg((F.count(F.when(F.col("_r") <= k, F.col("hit"))) / k).alias("precision"), (F.least(F.lit(k), F.count("hit")) / k).alias("ceiling"), F.count("hit").alias("_n"))
    return got.select("class", "precision", "ceiling", (F.col("_n") > 0).alias("evaluable"))


def best_markers(names: DataFrame, n: int) -> DataFrame:
    """(type, gene, sensitivity): a gene's best sensitivity over all source names mapped to a type, the ``n`` best of each."""
    best = names.groupBy("type", "gene").agg(F.max("sensitivity").alias("sensitivity"))
    return top_n(best, "sensitivity", n, "type")
