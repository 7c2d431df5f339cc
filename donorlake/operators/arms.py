"""The arm matrix of a fold: a readout of each arm's donor features, its argument checks and its nulls.

Features come long, ``(donor_id, feature, value)`` with zeros left out, so their
number has no bound.  Readouts are solved over donors, from the products that
``gram`` sums; a cohort has hundreds of donors.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import gram, joins, stats
from .gram import FOLD, products
from .infer import ARMS, permuted
from .readout import LEAST_TEST, LEAST_TRAIN

#: Arms whose training looks at text (fixed values).
TEXT_ARMS = ("T2", "T3", "T4", "N2")
ALL_ARMS = (*ARMS, "T4")
PREDICTIONS = "donor_id string, observed double, predicted double"


def check_arms(arms: Collection[str], captioned: Collection[str] = (), has_target: bool = True) -> None:
    """ValueError for an arm that isn't known, a text arm without captions, or a label null without labels."""
    unknown = sorted(set(arms) - set(ALL_ARMS))
    if unknown:
        raise ValueError(f"unknown arms: {', '.join(unknown)}")
    bare = [a for a in arms if a in TEXT_ARMS and a not in captioned]
    if bare:
        raise ValueError(f"no captions for arms: {', '.join(bare)}")
    if "N1" in arms and not has_target:
        raise ValueError("N1 permutes donor labels and needs them")


def _predictions(donors: DataFrame, rows: list[tuple], values: np.ndarray) -> DataFrame:
    made = [(r[0], float(r[2]), float(v)) for r, v in zip(rows, values) if r[1]]
    return donors.sparkSession.createDataFrame(made, PREDICTIONS)


def _enough(rows: list[tuple]) -> bool:
    n = sum(not r[1] for r in rows)
    return n >= LEAST_TRAIN and len(rows) - n >= LEAST_TEST


def ridge_arm(features: DataFrame, donors: DataFrame, alpha: float = 1.0, trained_on: DataFrame | None = None, known: tuple[list[tuple], np.ndarray] | None = None) -> DataFrame:
    """(donor_id, observed, predicted) of test donors by ridge on standardised features; no rows below 5 train or 3 test donors.

    ``trained_on(donor_id, target)`` puts other values in the place of train
    donors' targets (a null), test targets stay.  ``known``: the features' products.
    """
    rows, k = known or products(features, donors)
    if not _enough(rows):
        return _predictions(donors, [], np.zeros(0))
    n = k.shape[1]
    other = dict(trained_on.select("donor_id", "target").collect()) if trained_on is not None else {}
    y = np.array([other.get(r[0], r[2]) for r in rows[:n]])
    dual = np.linalg.solve(k[:n] + alpha * np.eye(n), y - y.mean())
    return _predictions(donors, rows, y.mean() + k @ dual)


def pca_ridge_arm(features: DataFrame, donors: DataFrame, alpha: float = 1.0, most: int = 20) -> DataFrame:
    """The same on principal components fitted on train donors: at most ``most``, train donors less one, or features."""
    rows, k = products(features, donors, scale=False)
    if not _enough(rows):
        return _predictions(donors, [], np.zeros(0))
    n = k.shape[1]
    _, coefficients = gram.components(k, n, most)
    scores = k @ coefficients
    z = scores / np.sqrt((scores[:n] ** 2).mean(axis=0))
    y = np.array([r[2] for r in rows[:n]])
    w = np.linalg.solve(z[:n].T @ z[:n] + alpha * np.eye(z.shape[1]), z[:n].T @ (y - y.mean()))
    return _predictions(donors, rows, y.mean() + z @ w)


def run_fold(donors: DataFrame, blocks: Mapping[str, DataFrame], arms: Collection[str], seed: int = 0, captioned: Collection[str] = (), pca: Collection[str] = ("B1",), null_of: str = "B2", alpha: float = 1.0) -> DataFrame:
    """(arm, donor_id, observed, predicted) of a fold's test donors.

    ``donors(donor_id, is_test, target)``; ``blocks`` has each arm's features:
    composition for B0, pseudobulk for B1 (read out on its components), and for
    arms of trained encoders the donor means of what they give.  N1 reads
    ``null_of``'s features with targets permuted among train donors only.
    """
    check_arms(arms, captioned, "target" in donors.columns)
    fold = donors.select("donor_id", "is_test", "target").limit(gram.MOST_DONORS + 1).collect()
    if {r[1] for r in fold} != {True, False}:
        raise ValueError("the fold has no train or no test donors")
    donors = donors.sparkSession.createDataFrame(fold, FOLD)
    lacking = sorted(a for a in arms if (null_of if a == "N1" else a) not in blocks)
    if lacking:
        raise ValueError(f"no features for arms: {', '.join(lacking)}")
    out, seen = None, {}
    for arm in arms:
        block = null_of if arm == "N1" else arm
        if arm in pca:
            got = pca_ridge_arm(blocks[arm], donors, alpha)
        else:
            if block not in seen:
                seen[block] = products(blocks[block], donors)
            dealt = permuted(donors.where("not is_test").select("donor_id", "target"), "donor_id", "target", 1, seed).drop("rep") if arm == "N1" else None
            got = ridge_arm(blocks[block], donors, alpha, dealt, seen[block])
        got = got.select(F.lit(arm).alias("arm"), "*")
        out = got if out is None else out.unionByName(got)
    return out


METRICS = ("rho", "r2", "mae", "n")


def _scored(predictions: DataFrame, *by: str) -> DataFrame:
    """(by..., rho, r2, mae, n) of (by..., observed, predicted); figures are null below three donors."""
    rho = stats.spearman(predictions, "observed", "predicted", *by)
    fit = stats.regression(predictions, "observed", "predicted", *by).drop("n")
    enough = F.col("n") >= LEAST_TEST
    return rho.join(fit, list(by)).select(*by, *(F.when(enough, F.col(c)).alias(c) for c in ("rho", "r2", "mae")), "n")


def transfer(source: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], most: int | None = None, alpha: float = 1.0) -> tuple[DataFrame, gram.Model]:
    """Predictions (mode, eval_subset, donor_id, observed, predicted) for a target cohort by what a source cohort was fitted on, and the model.

    Both are pairs ``(features(donor_id, feature, value), donors(donor_id,
    is_test, target))``.  The source's train donors fix the features, their means
    and deviations, with ``most`` the principal components, and the readout.
    ``strict``: the source's readout on all target donors with a target, and on
    the test donors among them; the target's values are never looked at.
    ``refit``: a readout of the target's train donors (5 or more) on the source's
    features or components, for its test donors (3 or more).  Features that the
    source lacks go, those that the target lacks are 0.
    """
    train = source[1].where("not is_test")
    if train.where(F.col("target").isNotNull()).limit(LEAST_TRAIN).count() < LEAST_TRAIN:
        raise ValueError("the source has too few train donors")
    model = gram.fit_ridge(*source, alpha) if most is None else gram.fit_components(*source, most, alpha)
    model.table = written(model.table, "model")
    known = target[1].where(F.col("target").isNotNull() & ~F.isnan("target"))
    scored = written(gram.scores(model, target[0], known), "scores")
    named = known.select("donor_id", "is_test", F.col("target").alias("observed"))
    strict = gram.predicted(model, scored).join(named, "donor_id")
    subsets = F.explode(F.when(F.col("is_test"), F.array(F.lit("all_donors"), F.lit("test_donors"))).otherwise(F.array(F.lit("all_donors")))).alias("eval_subset")
    strict = strict.select(F.lit("strict").alias("mode"), subsets, "donor_id", "observed", "predicted")
    if most is None:
        fixed = target[0].join(model.table.select("feature").distinct(), "feature", "left_semi")
    else:
        fixed = scored.select("donor_id", F.col("component").cast("string").alias("feature"), F.col("score").alias("value"))
    refit = ridge_arm(fixed, known, alpha).select(F.lit("refit").alias("mode"), F.lit("test_donors").alias("eval_subset"), "donor_id", "observed", "predicted")
    return strict.unionByName(refit), model


def transfer_report(arm: str, predictions: DataFrame) -> DataFrame:
    """(arm, mode, eval_subset, rho, r2, mae, n) of ``transfer``'s predictions."""
    return _scored(predictions, "mode", "eval_subset").select(F.lit(arm).alias("arm"), "mode", "eval_subset", *METRICS)


def verification_gap(model: gram.Model, source: tuple[DataFrame, DataFrame], stored: DataFrame) -> DataFrame:
    """(n, max_gap): the model's predictions of the source's test donors against those that its run stored; null below three common donors."""
    test = source[1].where("is_test")
    return joins.prediction_gap(stored, gram.predicted(model, gram.scores(model, source[0], test)))


def cell_coverage(cells: DataFrame, known: DataFrame, kind: str = "cell_type") -> DataFrame:
    """(coverage, n_vocab): share of the target's cells whose label the source's train cells have, and how many labels these have."""
    vocabulary = known.select(kind).distinct().withColumn("_hit", F.lit(1))
    marked = cells.join(vocabulary, kind, "left").agg((F.count("_hit") / F.count(F.lit(1))).alias("coverage"))
    return marked.join(vocabulary.agg(F.count(F.lit(1)).alias("n_vocab")))  # a row each
