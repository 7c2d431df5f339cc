"""Permutations, bootstraps and gates, with replicates as rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import keyed
from ..sources.shared import ship
from .stats import average_rank, pearson

#: Arms and what they are made of (fixed values).
ARMS = ("B0", "B1", "B2", "T0", "T1", "T2", "T3", "N1", "N2")
#: Decimals of a resample's difference: what is 0 but for the order of its summands counts as 0 on both sides.
TIES = 12
#: Replicates whose weights stand side by side in a row, and draws that one row of a table is spread to.
REPLICATES, DRAWS = 32, 4_096
_SIDES = ("observed_a", "predicted_a", "predicted_b")


def permuted(labels: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(rep, key, value): values dealt anew among the keys, one map per replicate.

    Only rows given take part: pass train donors to leave test donors alone.
    The n-th key by name gets the value of the n-th key by keyed hash; the table
    has a row per donor or class.
    """
    reps = labels.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"), key, value)
    place = F.row_number().over(Window.partitionBy("rep").orderBy(key))
    draw = F.row_number().over(Window.partitionBy("rep").orderBy(keyed(key, F.col("rep") + seed), key))
    to = reps.select("rep", key, place.alias("_n"))
    source = reps.select("rep", value, draw.alias("_n"))
    return to.join(source, ["rep", "_n"]).select("rep", key, value)


def _picks(donors: DataFrame, replicates: int, seed: int | Column, *by: str) -> tuple[DataFrame, DataFrame]:
    """(by..., rep, slot, _i): the number of the donor that each draw takes; and (by..., donor_id, _i), the donors with their numbers."""
    ranked = donors.select(*by, "donor_id", (F.row_number().over(Window.partitionBy(*by).orderBy("donor_id")) - 1).alias("_i"))
    sizes = donors.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(donors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(DRAWS).cast("long")))
    dealt = sizes.where("_n > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("*", first.alias("_from")).repartition(parts, *by, "rep", "_from")
    slots = dealt.select(*by, "_n", "rep", F.explode(F.sequence("_from", F.least(F.col("_from") + DRAWS, "_n") - 1)).alias("slot"))
    return slots.select(*by, "rep", "slot", (keyed(F.concat_ws("#", F.col("rep").cast("string"), F.col("slot").cast("string")), seed) % F.col("_n")).cast("int").alias("_i")), ranked


def draws(donors: DataFrame, replicates: int, seed: int, *by: str) -> DataFrame:
    """(by..., rep, slot, donor_id): as many draws with replacement as a group has donors, for each replicate."""
    pick, ranked = _picks(donors, replicates, seed, *by)
    return pick.join(ranked, [*by, "_i"]).select(*by, "rep", "slot", "donor_id")


def _weighted_ranks(value: np.ndarray, missing: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Less their mean, the average ranks (rows x replicates) where row i stands ``w[i]`` times; nulls first, NaN last."""
    order = np.lexsort((value, ~missing))
    v, m = value[order], missing[order]
    new = np.ones(len(v), bool)
    new[1:] = (m[1:] != m[:-1]) | ~m[1:] & (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    tied = np.add.reduceat(w[order], np.flatnonzero(new), axis=0)
    up = np.cumsum(tied, axis=0)
    ranks = np.empty(w.shape)
    ranks[order] = (up - tied / 2 - up[-1] / 2)[np.cumsum(new) - 1]
    return ranks


def _deltas(part, least: int):
    """(k, delta) of a group's rows with a column ``w<k>`` of weights for each replicate; those without a difference are left out."""
    import pandas as pd

    w = part[[c for c in part.columns if c.startswith("_w")]].to_numpy(np.float64)
    o, a, b = (_weighted_ranks(part[c].to_numpy(np.float64), part[f"_no_{c}"].to_numpy(bool), w) for c in _SIDES)
    oo, aa, bb = ((w * x * x).sum(axis=0) for x in (o, a, b))
    k = np.flatnonzero((w.sum(axis=0) >= least) & (oo > 0) & (aa > 0) & (bb > 0))
    oa, ob = (w * o * a).sum(axis=0)[k], (w * o * b).sum(axis=0)[k]
    return pd.DataFrame({"k": k.astype("int32"), "delta": oa / np.sqrt(oo[k] * aa[k]) - ob / np.sqrt(oo[k] * bb[k])})


def resampled(pairs: DataFrame, replicates: int, seed: int | Column, by: tuple[str, ...] = (), within: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """(by..., within..., rep, delta): ``delta_rho`` of each resample of a group's donors; those of fewer than ``least`` rows or with a constant side are left out.

    ``pairs(by..., within..., donor_id, observed_a, predicted_a, predicted_b)``;
    donors are drawn in each group of ``by``, ranks are taken in each of
    ``within`` too.  How often a donor is drawn is a weight: rows aren't repeated,
    a row has the weights of ``REPLICATES`` replicates, and ranks with repeats
    follow from sums of weights in the order of values.  A task has the donors of
    one group, some 100 numbers each.  Joins are by merge: sizes are told before
    arms and seeds are exploded, so tables far above the limit were broadcast.
    """
    ship(pairs.sparkSession)
    pick, ranked = _picks(pairs.select(*by, "donor_id").distinct(), replicates, seed, *by)
    width = min(REPLICATES, replicates)
    counted = [F.count(F.when(F.col("rep") % REPLICATES == k, 1)).cast("int").alias(f"_w{k}") for k in range(width)]
    weights = pick.select(*by, "_i", "rep").repartition(*by, "_i").groupBy(*by, "_i", F.floor(F.col("rep") / REPLICATES).cast("int").alias("_block")).agg(*counted)
    rows = pairs.select(*by, *within, "donor_id", *(F.col(c).cast("double").alias(c) for c in _SIDES), *(F.col(c).isNull().alias(f"_no_{c}") for c in _SIDES))
    rows = rows.join(ranked.hint("merge"), [*by, "donor_id"]).drop("donor_id").join(weights.hint("merge"), [*by, "_i"]).drop("_i")
    keys = [*by, *within, "_block"]

    def deltas(part):
        got = _deltas(part, least)
        for c in keys:
            got[c] = part[c].iloc[0]
        return got[[*keys, "k", "delta"]]

    kinds = dict(rows.dtypes)
    got = rows.groupBy(*keys).applyInPandas(deltas, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", k int, delta double")
    return got.select(*by, *within, (F.col("_block") * REPLICATES + F.col("k")).alias("rep"), "delta")


def delta_rho(pairs: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """(by..., rho_a, rho_b, delta, n) of paired rows; a group below ``least`` rows or with a constant side has null."""
    ranked = pairs.select(*by, average_rank("observed_a", *by).alias("o"), average_rank("predicted_a", *by).alias("a"), average_rank("predicted_b", *by).alias("b"))
    got = ranked.groupBy(*by).agg(pearson("o", "a").alias("rho_a"), pearson("o", "b").alias("rho_b"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("delta", F.when(F.col("n") >= least, F.col("rho_a") - F.col("rho_b")))


def clustered_bootstrap(pairs: DataFrame, replicates: int, seed: int, least_valid: int = 20) -> DataFrame:
    """One row: mean over seeds of the difference of rank correlations, its interval and sign-mass p, donors drawn as clusters.

    ``pairs(seed, donor_id, observed_a, predicted_a, predicted_b)``.  All seeds
    of a drawn donor move together; ranks are taken anew in each resample with
    its repeats.  The interval needs ``least_valid`` replicates.
    """
    point = delta_rho(pairs, "seed").agg(F.avg("delta").alias("delta_rho"))
    reps = resampled(pairs, replicates, seed, within=("seed",)).groupBy("rep").agg(F.round(F.avg("delta"), TIES).alias("d")).where("d is not null")
    n = F.count(F.lit(1))
    ends = reps.agg(
        n.alias("n_valid"),
        F.when(n >= least_valid, F.percentile("d", F.lit(0.025))).alias("ci_low"),
        F.when(n >= least_valid, F.percentile("d", F.lit(0.975))).alias("ci_high"),
        F.when(n > 0, F.least(F.lit(1.0), 2 * F.least(F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("d") >= 0, 1.0).otherwise(0.0))) + 1.0 / (n + 1))).alias("p_emp"),
    )
    donors = pairs.agg(F.count_distinct("donor_id").alias("n_donors"))
    return point.join(ends).join(donors)  # three tables of one row


def bootstrap_rho(rows: DataFrame, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """(rho, ci_low, ci_high): rank correlation over donors with percentile interval."""
    from .stats import spearman

    chosen = draws(rows.select("donor_id").distinct(), replicates, seed).join(rows, "donor_id")
    reps = spearman(chosen, a, b, "rep").agg(F.percentile("rho", F.lit(0.025)).alias("ci_low"), F.percentile("rho", F.lit(0.975)).alias("ci_high"), F.avg("rho").alias("mean_rho"), F.count("rho").alias("n_valid"))
    return spearman(rows.withColumn("_one", F.lit(1)), a, b, "_one").select("rho").join(reps)


def improvement_gate(df: DataFrame, candidate: str, reference: str, ci_low: str, null_ok: str, threshold: str = "0.05") -> DataFrame:
    """``gate``: PASS, FAIL or NOT_EVALUABLE by exact decimal difference (0.604 - 0.558 is below 0.05 and 0.650 - 0.600 isn't)."""

    def exact(c: str) -> Column:
        return F.col(c).cast("string").cast("decimal(38,18)")

    missing = F.col(candidate).isNull() | F.isnan(candidate) | F.col(reference).isNull() | F.isnan(reference) | F.col(ci_low).isNull() | F.isnan(ci_low) | F.col(null_ok).isNull()
    good = (exact(candidate) - exact(reference) >= F.lit(threshold).cast("decimal(38,18)")) & (F.col(ci_low) > 0) & F.col(null_ok)
    return df.withColumn("gate", F.when(missing, "NOT_EVALUABLE").when(good, "PASS").otherwise("FAIL"))


def gates(summary: DataFrame) -> DataFrame:
    """(gate, status) of one row of run figures; a missing figure makes its gate NOT_EVALUABLE, binary floats as they are.

    Columns: integrity_errors, candidate_rho, null_q95, delta_b2, ci_b2,
    delta_t1, ci_t1, delta_n2, ci_n2, transfer_min, delta_b0, ci_b0.
    """

    def status(needed: list[str], good: Column) -> Column:
        missing = F.lit(False)
        for c in needed:
            missing = missing | F.col(c).isNull()
        return F.when(missing, "NOT_EVALUABLE").when(good, "PASS").otherwise("FAIL")

    above_null = F.col("candidate_rho") > F.col("null_q95")

    def better(delta: str, ci: str) -> Column:
        return status(["candidate_rho", "null_q95", delta, ci], above_null & (F.col(delta) >= 0.05) & (F.col(ci) > 0))

    rules = {
        "integrity": F.when(F.col("integrity_errors") == 0, "PASS").otherwise("FAIL"),
        "improvement": better("delta_b2", "ci_b2"),
        "semantics_random": better("delta_t1", "ci_t1"),
        "semantics_text_null": better("delta_n2", "ci_n2"),
        "absolute": status(["candidate_rho"], F.col("candidate_rho") >= 0.5),
        "transfer": status(["transfer_min"], F.col("transfer_min") >= 0.35),
        "composition": status(["delta_b0", "ci_b0"], (F.col("delta_b0") >= 0.05) & (F.col("ci_b0") > 0)),
    }
    rules["negative_result_valid"] = F.when((F.col("integrity_errors") == 0) & (rules["improvement"] == "FAIL"), "PASS").when(rules["improvement"] == "NOT_EVALUABLE", "NOT_EVALUABLE").otherwise("FAIL")
    return summary.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), v.alias("status")) for k, v in rules.items()))).alias("g")).select("g.*")


def mean_gate(df: DataFrame, value: str, least: float, *by: str) -> DataFrame:
    """Mean over seeds against a bound."""
    got = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return got.withColumn("gate", F.when(F.col("mean").isNull(), "NOT_EVALUABLE").when(F.col("mean") >= least, "PASS").otherwise("FAIL"))


def orientation_halves(donors: DataFrame, seed: int) -> DataFrame:
    """(donor_id, orients): half of the donors by keyed hash tell the sign of a component, the others evaluate it."""
    ids = donors.select("donor_id").distinct()
    k = F.row_number().over(Window.orderBy(keyed("donor_id", seed), "donor_id"))  # a row per donor
    return ids.select("donor_id", (k <= F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 2)).alias("orients"))


def run_integrity(stored: DataFrame, recomputed: DataFrame, *keys: str) -> DataFrame:
    """(keys..., ok): is a run's stored fold hash the one that its fold gives? A run that is missing on a side isn't."""
    both = stored.select(*keys, F.col("sha256").alias("a")).join(recomputed.select(*keys, F.col("sha256").alias("b")), list(keys), "full_outer")
    return both.select(*keys, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))


#: Candidate and reference of each pooled comparison (fixed values).
PAIRS = [(c, r) for c in ("T0", "T2", "T3", "N1", "N2") for r in ("B2", "T1")] + [("B2", "B0"), ("B2", "B1"), ("T2", "T0"), ("T3", "T0"), ("N2", "T2"), ("T2", "N2"), ("T3", "N2")]
#: Those that the primary cohort is judged by (fixed values).
PRIMARY = [("T2", "B2"), ("T3", "B2"), ("T2", "T1"), ("T3", "T1")]
COMPARISON = ("cohort", "candidate", "reference")


def comparison_seed(base: int) -> Column:
    """A seed of a comparison's own, from the crc32 of its names."""
    return F.lit(base) + F.crc32(F.concat_ws(":", *COMPARISON)) % 99991


def pooled_comparisons(preds: DataFrame, primary: str, replicates: int, base_seed: int, least_valid: int = 20) -> DataFrame:
    """A row per cohort and pair of arms that both have predictions: difference of rank correlations, interval, p and q.

    ``preds(cohort, arm, seed, donor_id, observed, predicted)``.  Donors are
    drawn as clusters over all seeds; all comparisons and replicates are rows of
    one job.  q is over a cohort's secondary comparisons, null for primary ones.
    """
    named = preds.sparkSession.createDataFrame(PAIRS, "candidate string, reference string")
    a = preds.select("cohort", F.col("arm").alias("candidate"), "seed", "donor_id", F.col("observed").alias("observed_a"), F.col("predicted").alias("predicted_a"))
    b = preds.select("cohort", F.col("arm").alias("reference"), "seed", "donor_id", F.col("predicted").alias("predicted_b"))
    pairs = a.join(F.broadcast(named), "candidate").join(b.hint("merge"), ["cohort", "reference", "seed", "donor_id"]).dropna()
    point = delta_rho(pairs, *COMPARISON, "seed").groupBy(*COMPARISON).agg(F.avg("delta").alias("delta_rho"))
    sizes = pairs.groupBy(*COMPARISON).agg(F.count_distinct("donor_id").alias("n_donors"))
    reps = resampled(pairs, replicates, comparison_seed(base_seed), COMPARISON, ("seed",)).groupBy(*COMPARISON, "rep").agg(F.round(F.avg("delta"), TIES).alias("d"))
    n = F.count(F.lit(1))
    tail = F.least(F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("d") >= 0, 1.0).otherwise(0.0)))
    ends = reps.groupBy(*COMPARISON).agg(n.alias("n_valid"), F.when(n >= least_valid, F.percentile("d", F.lit(0.025))).alias("ci_low"), F.when(n >= least_valid, F.percentile("d", F.lit(0.975))).alias("ci_high"), F.least(F.lit(1.0), 2 * tail + 1.0 / (n + 1)).alias("p_emp"))
    from .stats import benjamini_hochberg, spearman

    rho = spearman(preds, "observed", "predicted", "cohort", "arm", "seed").groupBy("cohort", "arm").agg(F.avg("rho").alias("rho"))
    first = F.array_contains(F.array(*(F.lit(f"{c}-{r}") for c, r in PRIMARY)), F.concat_ws("-", "candidate", "reference"))
    rows = (
        point.join(sizes, list(COMPARISON)).join(ends, list(COMPARISON), "left")
        .join(rho.select("cohort", F.col("arm").alias("candidate"), F.col("rho").alias("candidate_rho")), ["cohort", "candidate"])
        .join(rho.select("cohort", F.col("arm").alias("reference"), F.col("rho").alias("reference_rho")), ["cohort", "reference"])
        .withColumn("role", F.when((F.col("cohort") == primary) & first, "primary").otherwise("secondary"))
        .withColumn("_p", F.when(F.col("role") == "secondary", F.col("p_emp")))
    )
    return benjamini_hochberg(rows, "_p", "cohort", out="q_fdr").drop("_p")


def pooled_summary(comparisons: DataFrame, cohort: str, candidate: str, null: DataFrame, transfer: DataFrame, composition: DataFrame, integrity: DataFrame) -> DataFrame:
    """The one row that ``gates`` judges: a candidate's comparisons in a cohort, ``null(quantile)``, ``transfer(rho)``, ``composition(delta_rho, ci_low)``, ``integrity(ok)``."""
    own = (F.col("cohort") == cohort) & (F.col("candidate") == candidate)
    got = [F.max(F.when(own, F.col("candidate_rho"))).alias("candidate_rho")]
    for reference in ("B2", "T1", "N2"):
        this = own & (F.col("reference") == reference)
        got += [F.max(F.when(this, F.col("delta_rho"))).alias(f"delta_{reference.lower()}"), F.max(F.when(this, F.col("ci_low"))).alias(f"ci_{reference.lower()}")]
    row = comparisons.agg(*got)
    parts = (integrity.agg(F.count(F.when(~F.col("ok"), 1)).alias("integrity_errors")), null.agg(F.max("quantile").alias("null_q95")), transfer.agg(F.min("rho").alias("transfer_min")), composition.agg(F.avg("delta_rho").alias("delta_b0"), F.min("ci_low").alias("ci_b0")))
    for part in parts:
        row = row.join(part)  # one row each
    return row


def paired_difference(a: DataFrame, b: DataFrame, replicates: int, seed: int) -> DataFrame:
    """One row (delta_rho, ci_low, ci_high, mean_delta, n, n_valid) of one run's two prediction tables, donors drawn.

    ValueError where the donors or observed values differ, repeat, are fewer
    than three, missing or constant.  A resample with a constant column is left
    out; ``mean_delta`` is the mean over resamples.
    """
    both = a.select("donor_id", F.col("observed").alias("observed_a"), F.col("predicted").alias("predicted_a")).join(b.select("donor_id", F.col("observed").alias("observed_b"), F.col("predicted").alias("predicted_b")), "donor_id", "full_outer")
    names = ("observed_a", "predicted_a", "observed_b", "predicted_b")
    broken = F.lit(False)
    for c in names:
        broken = broken | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    seen = both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("donor_id").alias("k"), F.count(F.when(broken | (F.col("observed_a") != F.col("observed_b")), 1)).alias("bad"), *(F.count_distinct(c).alias(c) for c in names)).first()
    if seen["n"] < 3 or seen["n"] != seen["k"] or seen["bad"] or min(seen[c] for c in names) < 2:
        raise ValueError("paired comparisons need the same donors, three or more, with equal observed and finite, varying predicted values")
    pairs = both.drop("observed_b")
    reps = resampled(pairs, replicates, seed)
    ends = reps.agg(F.percentile("delta", F.lit(0.025)).alias("ci_low"), F.percentile("delta", F.lit(0.975)).alias("ci_high"), F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("n_valid"))
    return delta_rho(pairs).select(F.col("delta").alias("delta_rho"), "n").join(ends)


def block_differences(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(block, delta_rho, n, mean_delta, ci_low, ci_high, n_valid): donors are drawn within each block, all blocks and replicates in one job.

    ``pairs(block, donor_id, observed_a, predicted_a, predicted_b)``, a row for
    each donor of a block.  Block ``all`` is the mean over blocks, of the points
    and in each replicate, of those blocks that have a difference; its n is of
    all donors.  Resamples with a constant side, or of fewer than three donors,
    have no difference and are left out.
    """
    point = delta_rho(pairs, "block").select("block", F.col("delta").alias("delta_rho"), "n")
    reps = resampled(pairs, replicates, seed, ("block",))
    whole = point.agg(F.lit("all").alias("block"), F.avg("delta_rho").alias("delta_rho"), F.sum("n").alias("n"))
    every = reps.unionByName(reps.groupBy("rep").agg(F.avg("delta").alias("delta")).withColumn("block", F.lit("all")))
    ends = every.groupBy("block").agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", F.lit(0.025)).alias("ci_low"), F.percentile("delta", F.lit(0.975)).alias("ci_high"), F.count(F.lit(1)).alias("n_valid"))
    return point.unionByName(whole).join(ends, "block", "left").na.fill(0, ["n_valid"])


def go_gate(figures: DataFrame) -> DataFrame:
    """(go) of ``figures(encoder, rho, gap, trajectory)``: on every encoder a correlation of 0.5, a gap of 0.15 and a positive trajectory."""
    by = figures.groupBy("encoder").agg((F.max("rho") >= 0.5).alias("a"), (F.max("gap") >= 0.15).alias("b"), (F.max("trajectory") > 0).alias("c"))
    return by.agg(F.when(F.bool_and(F.coalesce(F.col("a") & F.col("b") & F.col("c"), F.lit(False))), "GO").otherwise("NO_GO").alias("go"))
