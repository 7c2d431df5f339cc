"""Rank correlation, regression and classification metrics, quantiles, false discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 within groups; ties share their mean rank."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1
    return F.rank().over(w.orderBy(value)) + ties / 2


def pearson(a: Column | str, b: Column | str) -> Column:
    """Null where a side is constant (no division by zero under ANSI rules)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str, *by: str, least: int = 3) -> DataFrame:
    """(by..., rho, n): Pearson of average ranks over rows where both are known; null below ``least`` rows or if constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.select(*by, average_rank(a, *by).alias("_ra"), average_rank(b, *by).alias("_rb"))
    out = ranked.groupBy(*by).agg(pearson("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def regression(df: DataFrame, observed: str, predicted: str, *by: str) -> DataFrame:
    """R² against the mean (null if constant) and mean absolute error."""
    o, p = F.col(observed), F.col(predicted)
    rows = df.where(o.isNotNull() & p.isNotNull())
    total = F.nullif(F.var_pop(o) * F.count(F.lit(1)), F.lit(0.0))
    return rows.groupBy(*by).agg((1 - F.sum((o - p) * (o - p)) / total).alias("r2"), F.avg(F.abs(o - p)).alias("mae"), F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Macro-F1 over the labels in truth or prediction (0 where undefined) and mean recall over the labels in truth."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).count()
    hit = F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0)
    of_truth = pairs.groupBy(F.col("t").alias("k")).agg(F.sum("count").alias("nt"), F.sum(hit).alias("tp"))
    of_pred = pairs.groupBy(F.col("p").alias("k")).agg(F.sum("count").alias("np"))
    both = of_truth.join(of_pred, "k", "full_outer").na.fill(0, ["nt", "np", "tp"])
    f1 = 2.0 * F.col("tp") / (F.col("nt") + F.col("np"))
    return both.agg(F.avg(f1).alias("macro_f1"), F.avg(F.when(F.col("nt") > 0, F.col("tp") / F.col("nt"))).alias("balanced_accuracy"))


def benjamini_hochberg(df: DataFrame, p: str, *by: str, out: str = "q") -> DataFrame:
    """Step-up q-values within groups; null p stay null and don't count."""
    known = F.col(p).isNotNull()
    group = [*by, known]
    m = F.count(p).over(Window.partitionBy(*group))
    r = F.row_number().over(Window.partitionBy(*group).orderBy(p))
    scaled = df.withColumn("_s", F.when(known, F.col(p) * m / r))
    up = Window.partitionBy(*group).orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    return scaled.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("_s").over(up)))).drop("_s")


def null_quantile(df: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("quantile"), F.count(value).alias("n"))


def mean_std(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and sample deviation (null for one row)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def macro_mean(df: DataFrame, value: str, evaluable: str, *by: str) -> DataFrame:
    """Mean over evaluable rows; null where none is."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col(evaluable), F.col(value))).alias("mean"), F.count(F.when(F.col(evaluable), 1)).alias("n_evaluable"), F.count(F.lit(1)).alias("n_classes"))


def conditional_mean(df: DataFrame, value: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"))
