"""Joins with the checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require


def left_donor_join(cells: DataFrame, donors: DataFrame, key: str = "donor_id") -> DataFrame:
    """Left join, many cells to one donor; Spark broadcasts the donors where their size allows."""
    return cells.join(donors, key, "left")


def keep_first(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """One row per key, the first by order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def complete_donor_join(cells: DataFrame, donors: DataFrame, order: str, key: str = "donor_id") -> DataFrame:
    """Donor rows de-duplicated keep-first and joined; cells without a donor row are an error with their number."""
    first = keep_first(donors, order, key)
    n = cells.join(first, key, "left_anti").count()
    if n:
        raise ValueError(f"{n} cells have no donor row")
    return cells.join(first, key)


def unmatched(cells: DataFrame, donors: DataFrame, key: str = "donor_id") -> DataFrame:
    return cells.join(donors, key, "left_anti")


def paired(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-8, check: bool = True) -> DataFrame:
    """Inner join of two prediction tables; rows with a null go, observed values must agree."""
    both = a.select(*keys, F.col("observed").alias("observed_a"), F.col("predicted").alias("predicted_a")).join(b.select(*keys, F.col("observed").alias("observed_b"), F.col("predicted").alias("predicted_b")), keys).dropna()
    if check:
        require(both, F.abs(F.col("observed_a") - F.col("observed_b")) > tolerance + 1e-5 * F.abs(F.col("observed_b")), "observed targets differ")
    return both


def feature_blocks(left: DataFrame, right: DataFrame, key: str = "donor_id") -> DataFrame:
    """Full outer join of donor features; names that clash get ``_r``, nulls become 0."""
    clash = [c for c in right.columns if c in left.columns and c != key]
    for c in clash:
        right = right.withColumnRenamed(c, f"{c}_r")
    both = left.join(right, key, "full_outer")
    return both.na.fill(0.0, [c for c in both.columns if c != key])


def aligned(driving: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """Other's rows in the driving list's order; a key that is missing is an error."""
    if not driving.join(other, key, "left_anti").isEmpty():
        raise ValueError(f"{key}: not all are covered")
    return driving.join(other, key).orderBy(order)


def shared_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables on genes that both have."""
    genes = a.select("gene").intersect(b.select("gene"))
    return a.unionByName(b).join(genes, "gene", "left_semi")


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left look-up with a default for keys that are missing."""
    return df.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def donor_difference(everyone: DataFrame, test: DataFrame) -> DataFrame:
    return everyone.select("donor_id").distinct().join(test.select("donor_id"), "donor_id", "left_anti")


def prediction_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, max_gap) over common donors; null below three."""
    both = a.select("donor_id", F.col("predicted").alias("x")).join(b.select("donor_id", F.col("predicted").alias("y")), "donor_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_gap")).withColumn("max_gap", F.when(F.col("n") >= 3, F.col("max_gap")))


def key_hit_rates(df: DataFrame, candidates: list[str], known: DataFrame, key: str, sample: int = 2000, order: str | None = None) -> DataFrame:
    """(candidate, rate): share of the first ``sample`` rows (the reference's own rule) whose upper-cased key is known.

    One pass over the sample; take the row with the largest rate.
    """
    rows = (df.orderBy(order) if order else df).limit(sample)
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.upper(F.col(c).cast("string")).alias("k")) for c in candidates))).alias("x")).select("x.*")
    marked = long.join(known.select(F.upper(key).alias("k"), F.lit(1).alias("hit")).distinct(), "k", "left")
    return marked.groupBy("candidate").agg((F.count("hit") / F.count(F.lit(1))).alias("rate"))


#: A key with a larger share of known values is taken without a look at those behind it (fixed value).
GOOD_RATE = 0.8


def pick_key(df: DataFrame, candidates: list[str], known: DataFrame, key: str, sample: int = 2000, order: str | None = None) -> tuple[DataFrame, str | None, float]:
    """The rows with ``id``, the best key's values, that key's name and its rate.

    The first candidate with a rate over ``GOOD_RATE``, else the one with the
    largest, the earlier of equal ones; candidates that aren't columns are
    passed over; without rows or columns there is no key and ids are null.
    """
    there = [c for c in candidates if c in df.columns]
    rates = dict(key_hit_rates(df, there, known, key, sample, order).collect()) if there else {}  # a row for each candidate
    best = None
    for c in there if rates else []:
        if best is None or rates[c] > rates[best]:
            best = c
        if rates[c] > GOOD_RATE:
            break
    return df.withColumn("id", F.col(best).cast("string") if best else F.lit(None).cast("string")), best, rates.get(best, 0.0)


def run_manifest(runs: DataFrame, manifests: DataFrame, *keys: str) -> DataFrame:
    return runs.join(manifests, list(keys), "left")


def logged(expr: DataFrame) -> DataFrame:
    """log1p of counts per 10,000 of the cell's full library; null where that is 0."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(F.col("value") * 1e4 / F.nullif(total, F.lit(0.0))))


def on_genes(rows: DataFrame, source_genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the source's genes with their place (ord), and the coverage (n_source, n_found, coverage) of these by the rows' genes."""
    on = rows.join(source_genes.select("gene", "ord"), "gene")
    have = rows.select("gene").distinct().withColumn("hit", F.lit(1))
    cover = source_genes.join(have, "gene", "left").agg(F.count(F.lit(1)).alias("n_source"), F.count("hit").alias("n_found"))
    return on, cover.withColumn("coverage", F.col("n_found") / F.col("n_source"))


def gene_space(expr: DataFrame, source_genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts on the source's gene space, normalised by each cell's full library, and the coverage.

    Source genes that the target lacks are zeros, which a sparse table doesn't
    store.  Coverage: (n_source, n_found, coverage).  A cell without any count
    has no row and so can't be projected; see ``zero_cells``.
    """
    on, cover = on_genes(logged(expr), source_genes)
    return on.select("cell_id", "gene", "ord", "value"), cover


def zero_cells(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Cells whose total is zero."""
    return cells.select("cell_id").join(expr.where("value > 0").select("cell_id").distinct(), "cell_id", "left_anti")
