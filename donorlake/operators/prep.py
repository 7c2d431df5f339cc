"""Cohort preparation: validation, quality filters, splits by whole donors, normalisation, variable genes.

Counts are long and sparse, ``(cell_id, gene, value)`` with non-zero rows only;
means over cells divide by the number of cells, never by stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import keyed
from ..schema import require, require_unique
from ..sources.shared import written


def count_validation(expr: DataFrame) -> DataFrame:
    """One row: how many values are not finite, negative, not integer, or repeat a (cell, gene)."""
    v = F.col("value")
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull()
    odd = F.abs(v - F.rint(v)) > 1e-6
    sums = expr.agg(F.count(F.when(bad, 1)).alias("n_not_finite"), F.count(F.when(v < 0, 1)).alias("n_negative"), F.count(F.when(odd, 1)).alias("n_not_integer"), F.count(F.lit(1)).alias("n_values"))
    return sums


def validate_counts(expr: DataFrame, data_state: str = "counts") -> DataFrame:
    """Counts as they are, or ValueError: processed state, non-finite, negative or fractional values."""
    if data_state != "counts":
        raise ValueError(f"counts are wanted, the data are {data_state}")
    v = F.col("value")
    return require(expr, v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0) | (F.abs(v - F.rint(v)) > 1e-6), "counts must be finite, non-negative integers")


def cell_totals(expr: DataFrame) -> DataFrame:
    """Detected genes and total count of each cell."""
    return expr.groupBy("cell_id").agg(F.count(F.when(F.col("value") > 0, 1)).alias("n_genes"), F.sum("value").alias("total"))


def filter_cells(expr: DataFrame, min_genes: int) -> DataFrame:
    """Cells with that many detected genes; a window over the cell keeps one shuffle."""
    n = F.count(F.when(F.col("value") > 0, 1)).over(Window.partitionBy("cell_id"))
    return expr.withColumn("_n", n).where(F.col("_n") >= min_genes).drop("_n")


def cells_of(expr: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of chosen cells."""
    return expr.join(keep.select("cell_id"), "cell_id", "left_semi")


def cells_in_order(expr: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of cells listed as (cell_id, ord), in that order; a cell that is missing is an error."""
    missing = wanted.join(expr.select("cell_id").distinct(), "cell_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("cells are missing")
    return expr.join(wanted, "cell_id").orderBy("ord", "gene")


def train_gene_filter(expr: DataFrame, train_cells: DataFrame, min_cells: int) -> DataFrame:
    """(gene, n_cells): genes detected in that many train cells."""
    seen = expr.where("value > 0").join(train_cells.select("cell_id"), "cell_id", "left_semi")
    return seen.groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)


def normalize_log1p(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p of counts per ``target`` of the cell's full total (before any gene is dropped)."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(F.col("value") * target / total))


def dispersion(logged: DataFrame, n_cells: int, bins: int = 20) -> DataFrame:
    """(gene, mean, dispersion, z) of log1p values of ``n_cells`` cells.

    Counts are put back by expm1; mean and sample variance have all cells'
    zeros; log mean is cut into equal-width bins; z is against the bin's mean
    and sample deviation, 1 in a bin of one gene, and 0 where a bin is constant.
    """
    x = F.expm1("value")
    sums = logged.groupBy("gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    mean = F.col("s") / n_cells
    var = (F.col("ss") - n_cells * mean * mean) / (n_cells - 1)
    ratio = var / F.nullif(mean, F.lit(0.0))
    g = sums.select("gene", F.log1p(mean).alias("m"), F.when(ratio > 0, F.log(ratio)).alias("d"))
    every = Window.partitionBy()
    lo, hi = F.min("m").over(every), F.max("m").over(every)  # a row per gene
    width = F.nullif((hi - lo) / bins, F.lit(0.0))
    g = g.withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("m") - lo) / width), F.lit(0)).cast("int")))
    w = Window.partitionBy("bin")
    n, sd = F.count("d").over(w), F.stddev_samp("d").over(w)
    z = F.when(n == 1, F.lit(1.0)).otherwise(F.coalesce((F.col("d") - F.avg("d").over(w)) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)))
    return g.select("gene", F.col("m").alias("mean"), F.col("d").alias("dispersion"), "bin", F.when(F.col("d").isNotNull(), z).alias("z"))


def variable_genes(logged: DataFrame, n_cells: int, n_top: int, bins: int = 20) -> DataFrame:
    """The ``n_top`` genes with the largest z to nine digits (genes of a bin of two are equal but for rounding), ties by gene."""
    return dispersion(logged, n_cells, bins).where("z is not null").orderBy(F.desc(F.round("z", 9)), "gene").limit(n_top)


def top_variance(expr: DataFrame, n_cells: int, n_top: int) -> DataFrame:
    """Genes with the largest variance over all cells."""
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    return s.select("gene", (F.col("ss") / n_cells - F.pow(F.col("s") / n_cells, 2)).alias("variance")).orderBy(F.desc("variance"), "gene").limit(n_top)


def unique_symbols(var: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique by -1, -2, ... behind the second and later ones."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return var.withColumn("symbol", F.when(k == 0, F.col(name)).otherwise(F.concat_ws("-", F.col(name), k.cast("string"))))


def support(df: DataFrame, least: int, *by: str) -> DataFrame:
    """Groups with at least so many rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def supported(df: DataFrame, least: int, *by: str) -> DataFrame:
    """Rows of those groups."""
    return df.join(support(df, least, *by), list(by), "left_semi")


def donor_split(donors: DataFrame, seed: int, test_fraction: float = 0.25) -> DataFrame:
    """(donor_id, is_test): test donors are the first by keyed hash, half-even rounded, at least 1 and not all.

    Donor ids are strings; a null id, fewer than two donors or a fraction
    outside (0, 1) is an error.  The order of rows has no influence.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    require(donors, F.col("donor_id").isNull(), "donor_id is null")
    ids = donors.select("donor_id").distinct()
    if ids.limit(2).count() < 2:
        raise ValueError("two donors are needed")
    n = F.count(F.lit(1)).over(Window.partitionBy())  # a row per donor
    k = F.row_number().over(Window.orderBy(keyed("donor_id", seed), "donor_id"))
    n_test = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * test_fraction)))
    return ids.select("donor_id", (k <= n_test).alias("is_test"))


def donors_from_mask(cells: DataFrame) -> DataFrame:
    """(donor_id, is_test) of a saved mask; ValueError if a donor is on both sides or a side is empty."""
    require(cells, F.col("is_test").isNull(), "is_test must be 0 or 1")
    sides = cells.groupBy("donor_id").agg(F.count_distinct("is_test").alias("n"), F.max("is_test").alias("is_test"))
    require(sides, F.col("n") > 1, "a donor is in train and test")
    if sides.select("is_test").distinct().count() < 2:
        raise ValueError("train or test is empty")
    return sides.select("donor_id", "is_test")


def stratified_sample(df: DataFrame, seed: int, key: str, by: list[str], fraction: float | None = None, most: int | None = None) -> DataFrame:
    """Rows by keyed hash: a half-even rounded fraction of each group (at least 1), or at most ``most`` of it."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(keyed(key, seed), key))
    n = F.lit(most) if most is not None else F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * fraction))
    return df.withColumn("_k", k).withColumn("_n", n).where(F.col("_k") <= F.col("_n")).drop("_k", "_n")


def donor_quota(total: int, n_donors: int) -> int:
    return max(1, total // n_donors)


def donor_constant(cells: DataFrame, value: str) -> DataFrame:
    """(donor_id, value): ValueError if a donor has two values."""
    got = cells.groupBy("donor_id").agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    return require(got, F.col("_n") > 1, f"{value} varies within a donor").drop("_n")


def mixed_labels(cells: DataFrame, value: str) -> DataFrame:
    """Donors with more than one value."""
    return cells.groupBy("donor_id").agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def donor_first(cells: DataFrame, order: str, *columns: str) -> DataFrame:
    """First non-null value of each column by donor."""
    return cells.groupBy("donor_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def build_fold(expr: DataFrame, obs: DataFrame, seed: int, min_genes: int = 200, min_cells: int = 3, n_hvg: int = 2000, test_fraction: float = 0.25) -> dict[str, DataFrame]:
    """A donor fold: ``expr`` (log1p of chosen genes), ``obs`` (with is_test) and ``genes``.

    Every rule but the per-cell filter looks at train donors only, so test
    values never change what is learned.  A donor without cells after the filter
    is an error, not a loss.  ``expr`` and ``obs`` are read once: counts are
    dealt by cell, given their cell's figures and written, and all checks and
    rules read what they need of that.
    """
    v, cell = F.col("value"), Window.partitionBy("cell_id")
    figures = {"_n_genes": F.count(F.when(v > 0, 1)).over(cell), "_total": F.sum("value").over(cell)}
    told = expr.select("cell_id", "gene", "value").withColumns(figures).withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("cell_id", "gene")))
    counts, obs = written(told, "fold-counts"), written(obs, "fold-obs")
    require_unique(obs, "cell_id")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0) | (F.abs(v - F.rint(v)) > 1e-6)
    seen = counts.agg(F.max("_copies").alias("copies"), F.count(F.when(bad, 1)).alias("bad")).first()
    if (seen.copies or 0) > 1:
        raise ValueError("cell_id, gene must be unique")
    if seen.bad:
        raise ValueError("counts must be finite, non-negative integers")
    split = written(donor_split(written(obs.select("donor_id").distinct(), "fold-donors"), seed, test_fraction), "fold-split")
    kept = counts.where(F.col("_n_genes") >= min_genes)
    cells = written(obs.join(kept.select("cell_id").distinct(), "cell_id", "left_semi").join(split, "donor_id"), "fold-cells")
    if not split.join(cells.select("donor_id").distinct(), "donor_id", "left_anti").isEmpty():
        raise ValueError("the cell filter removes a donor")
    train = cells.where("not is_test")
    genes = written(train_gene_filter(kept, train, min_cells).select("gene"), "fold-genes")
    n_genes = genes.count()
    if n_genes < 2:
        raise ValueError("fewer than two genes are left")
    logged = kept.select("cell_id", "gene", F.log1p(v * 1e4 / F.col("_total")).alias("value")).join(genes, "gene", "left_semi")
    if n_genes > n_hvg:
        genes = written(variable_genes(cells_of(logged, train), train.count(), n_hvg).select("gene"), "fold-variable")
    return {"expr": logged.join(genes, "gene", "left_semi"), "obs": cells, "genes": genes}


def preprocess_all(expr: DataFrame, n_cells: int, min_genes: int, min_cells: int, n_hvg: int) -> DataFrame:
    """The historical path: genes are filtered first and variable genes are fitted on all cells."""
    kept = filter_cells(expr, min_genes)
    genes = kept.where("value > 0").groupBy("gene").count().where(F.col("count") >= min_cells)
    logged = normalize_log1p(kept.join(genes, "gene", "left_semi"))
    return logged.join(variable_genes(logged, n_cells, max(1, min(n_hvg, genes.count() - 1))).select("gene"), "gene", "left_semi")


def pseudo_donors(obs: DataFrame, donors: list[str], seed: int) -> DataFrame:
    """Cells of a data set without donors dealt to these by keyed hash: a rehearsal of held-out work, not an evaluation."""
    at = keyed("cell_id", seed) % len(donors) + 1
    return obs.withColumn("donor_id", F.element_at(F.array(*map(F.lit, donors)), at.cast("int")))


def load_sample(obs: DataFrame, logged: DataFrame, n_genes: int, seed: int = 0, donors: tuple[str, ...] = ("d0", "d1", "d2")) -> tuple[DataFrame, DataFrame]:
    """Cells with pseudo-donors, and normalised values of the genes that vary most over all cells of ``obs``."""
    top = top_variance(logged, obs.count(), n_genes)
    return pseudo_donors(obs, list(donors), seed), logged.join(top.select("gene"), "gene", "left_semi")


def bags(cells: DataFrame, seed: int, most: int) -> DataFrame:
    """(donor_id, slot, cell_id): at most ``most`` cells of each donor by keyed hash, padded with null to ``most`` slots."""
    k = F.row_number().over(Window.partitionBy("donor_id").orderBy(keyed("cell_id", seed), "cell_id")) - 1
    chosen = cells.select("donor_id", "cell_id", k.alias("slot")).where(F.col("slot") < most)
    slots = cells.select("donor_id").distinct().select("donor_id", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("slot"))
    return slots.join(chosen, ["donor_id", "slot"], "left")


#: Cells that a loader keeps at most, but for one of each small group: their ids (8 bytes each) are broadcast.
MOST_CELLS = 2_000_000
#: Columns that a donor table takes from its cells (fixed values).
DONOR_COLUMNS = ("braak", "cerad", "thal", "adnc", "cognitive_status", "casi", "apoe", "age_at_death", "sex")
SCORES = ("CPS_Global", "CPS_Global_ABeta", "CPS_Global_pTau", "CPS_Local", "CPS_Local_ABeta", "CPS_Local_pTau")


def load_region(cells: DataFrame, counts: DataFrame, region: str, scores: DataFrame | None = None, max_cells: int = 150_000, min_cells_per_type: int = 500, seed: int = 0, order: str = "cell_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, their counts and a donor table of one region of a large count table.

    ``cells(cell_id, donor_id, cell_type, region, ...)``; ``scores(donor_id,
    region, ...)`` are joined by donor and region.  Types below
    ``min_cells_per_type`` cells go; where more than ``max_cells`` are left, a
    share of each (donor, type) by keyed hash stays, one at least.  The kept ids
    are at most ``max_cells`` and half a cell more for each group, and go to the
    scan of ``counts`` as a broadcast semi join: the count table is read once
    and never shuffled.  The donor table has the first value of each known
    column, by ``order``.
    """
    if max_cells > MOST_CELLS:
        raise ValueError(f"max_cells must not exceed {MOST_CELLS}")
    here = cells.where(F.col("region") == region)
    if scores is not None:
        own = scores.where(F.col("region") == region).drop("region")
        clash = [c for c in own.columns if c in here.columns and c != "donor_id"]
        for c in clash:
            own = own.withColumnRenamed(c, f"{c}_cps")
        here = here.join(require_unique(own, "donor_id"), "donor_id", "left")
    here = supported(here, min_cells_per_type, "cell_type")
    total = here.count()
    if total > max_cells:
        here = stratified_sample(here, seed, "cell_id", ["donor_id", "cell_type"], fraction=max_cells / total)
    kept = written(here, "region-cells")
    ids = kept.select("cell_id")
    n = kept.count()
    sub = counts.join(F.broadcast(ids) if n <= 2 * MOST_CELLS else ids, "cell_id", "left_semi")
    return kept, sub, donor_first(kept, order, *(c for c in (*DONOR_COLUMNS, *SCORES) if c in kept.columns))
