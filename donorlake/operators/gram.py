"""Products of donors over any number of features, and linear models as tables.

Features come long, ``(donor_id, feature, value)`` with zeros left out.  One
shuffle brings a feature's donors together; each partition makes dense blocks of
features x donors, sums its own donors x donors matrix and gives that away in
strips, which are added by a tree of shuffles.  No table of features x donors is
ever made, and what moves is a matrix per partition, whatever the features.

A fitted model is a table ``(feature, mean, deviation, component, loading)``,
got from the solution over donors by a second pass over the same blocks, and
read out on another cohort by one join on the feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship

#: Donors of a cohort: their products (200 MB at this number) are solved on the driver; more are an error.
MOST_DONORS = 5_000
#: Features of a dense block, donors of a strip, strips added by a task in each round.
BLOCK, STRIP, FAN_IN = 256, 16, 32
FOLD = "donor_id string, is_test boolean, target double"
MODEL = "feature string, mean double, deviation double, component int, loading double"


def fold_rows(donors: DataFrame) -> list[tuple]:
    """(donor_id, is_test, target) of donors with a target, train donors first, each by name; ValueError for too many or repeated donors."""
    known = donors.where(F.col("target").isNotNull() & ~F.isnan("target")).select("donor_id", "is_test", "target")
    rows = sorted(map(tuple, known.limit(MOST_DONORS + 1).collect()), key=lambda r: (r[1], r[0]))
    if len(rows) > MOST_DONORS:
        raise ValueError(f"more than {MOST_DONORS} donors")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("donor_id must be unique")
    return rows


def placed(features: DataFrame, rows: list[tuple]) -> DataFrame:
    """(feature, at, value) side by side by feature; ``at`` is a donor's place in ``rows``."""
    ship(features.sparkSession)
    places = features.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(rows)], "donor_id string, at int")
    known = features.where(F.col("feature").isNotNull() & F.col("value").isNotNull())
    return known.join(F.broadcast(places), "donor_id").select("feature", "at", F.col("value").cast("double").alias("value")).repartition("feature").sortWithinPartitions("feature")


def _blocks(batches, width: int):
    """(names, dense features x donors) of rows that stand by feature; rows of one donor and feature are added up."""
    names, x = [], np.zeros((BLOCK, width))
    for b in batches:
        coded = b.column(0).dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at, value = b.column(1).to_numpy(), b.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if not names or words[codes[lo]] != names[-1]:
                if len(names) == BLOCK:
                    yield names, x
                    names, x = [], np.zeros((BLOCK, width))
                names.append(words[codes[lo]])
            np.add.at(x[len(names) - 1], at[lo:hi], value[lo:hi])
    if names:
        yield names, x[: len(names)]


def _standard(x: np.ndarray, n: int, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features centred on the first ``n`` donors, and divided by their population deviation (1 where constant)."""
    mean = x[:, :n].mean(axis=1) if n else np.zeros(len(x))
    deviation = x[:, :n].std(axis=1) if n and scale else np.ones(len(x))
    deviation[deviation < 1e-12] = 1.0
    return (x - mean[:, None]) / deviation[:, None], mean, deviation


STRIPS = "strip int, part int, m binary"


def _added(batches):
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for strip, part, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            key, m = (strip, part // FAN_IN), np.frombuffer(m)
            sums[key] = sums[key] + m if key in sums else m
    yield pa.RecordBatch.from_pydict({"strip": pa.array([k[0] for k in sums], pa.int32()), "part": pa.array([k[1] for k in sums], pa.int32()), "m": pa.array([m.tobytes() for m in sums.values()], pa.binary())})


def added_up(parts: DataFrame, partitions: int) -> dict[int, np.ndarray]:
    """{strip: sum} of ``parts(strip, part, m)``, rows of numbers that partitions made, by a tree of shuffles; a row for each strip reaches the driver."""
    left = max(2, partitions)
    while left > 1:
        parts = parts.repartition("strip", F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("strip", "part").mapInArrow(_added, STRIPS)
        left = -(-left // FAN_IN)
    out: dict[int, np.ndarray] = {}
    for strip, _, m in parts.collect():
        m = np.frombuffer(m)
        out[strip] = out[strip] + m if strip in out else m
    return out


def products(features: DataFrame, donors: DataFrame, scale: bool = True) -> tuple[list[tuple], np.ndarray]:
    """Donors ``(donor_id, is_test, target)``, train first, and the products of their features with train donors' features.

    Features are centred on train donors, and divided by their population
    deviation if ``scale`` (by 1 where they are constant).  A feature that a
    donor lacks is 0; one that no train donor has adds nothing.
    """
    rows = fold_rows(donors)
    width, n = len(rows), sum(not r[1] for r in rows)
    if not n:
        return rows, np.zeros((width, 0))

    def partial(batches):
        total, seen = np.zeros((width, n)), False
        for _, x in _blocks(batches, width):
            z, _, _ = _standard(x, n, scale)
            total += z.T @ z[:, :n]
            seen = True
        if seen:
            strips = range(0, width, STRIP)
            yield pa.RecordBatch.from_pydict({"strip": pa.array([k // STRIP for k in strips], pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(strips), pa.int32()), "m": pa.array([total[k : k + STRIP].tobytes() for k in strips], pa.binary())})

    parts = placed(features, rows).mapInArrow(partial, STRIPS)
    k = np.zeros((width, n))
    for strip, m in added_up(parts, int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))).items():
        m = m.reshape(-1, n)
        k[strip * STRIP : strip * STRIP + len(m)] += m
    return rows, k


@dataclass
class Model:
    """A linear model: its table, the weight of each component's score, and the intercept."""

    table: DataFrame
    weights: list[float]
    intercept: float


def _table(features: DataFrame, rows: list[tuple], n: int, coefficients: np.ndarray, scale: bool) -> DataFrame:
    width = len(rows)

    def work(batches):
        for names, x in _blocks(batches, width):
            z, mean, deviation = _standard(x, n, scale)
            loading = z[:, :n] @ coefficients
            known = np.flatnonzero((x[:, :n] != 0).any(axis=1))
            c = coefficients.shape[1]
            yield pa.RecordBatch.from_pydict({"feature": pa.array([names[i] for i in known for _ in range(c)], pa.string()), "mean": np.repeat(mean[known], c), "deviation": np.repeat(deviation[known], c), "component": pa.array(np.tile(np.arange(c), len(known)), pa.int32()), "loading": loading[known].ravel()})

    return placed(features, rows).mapInArrow(work, MODEL)


def components(k: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances (times n) and donors' coefficients of the first components of centred products: at most ``most``, train donors less one, or what has variance."""
    values, vectors = np.linalg.eigh(k[:n])
    best = np.argsort(-values)[: max(0, min(most, n - 1))]
    best = best[values[best] > max(values.max(), 0) * 1e-10]
    return values[best], vectors[:, best] / np.sqrt(values[best])


def fit_ridge(features: DataFrame, donors: DataFrame, alpha: float = 1.0) -> Model:
    """Ridge on standardised features of train donors, solved over donors; one component, whose loadings are the weights.

    The long features are read twice; write them first where they are costly.
    """
    rows, k = products(features, donors)
    n = k.shape[1]
    y = np.array([r[2] for r in rows[:n]])
    dual = np.linalg.solve(k[:n] + alpha * np.eye(n), y - y.mean())
    return Model(_table(features, rows, n, dual[:, None], True), [1.0], float(y.mean()))


def fit_components(features: DataFrame, donors: DataFrame, most: int = 20, alpha: float = 1.0) -> Model:
    """Ridge on the standardised scores of principal components, both fitted on train donors."""
    rows, k = products(features, donors, scale=False)
    n = k.shape[1]
    _, coefficients = components(k, n, most)
    scores = k @ coefficients
    deviation = np.sqrt((scores[:n] ** 2).mean(axis=0))
    z, y = scores[:n] / deviation, np.array([r[2] for r in rows[:n]])
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return Model(_table(features, rows, n, coefficients, False), (w / deviation).tolist(), float(y.mean()))


def scores(model: Model, features: DataFrame, donors: DataFrame) -> DataFrame:
    """(donor_id, component, score) of all of ``donors(donor_id)``: features that a donor lacks are 0, features that the model lacks go."""
    at_zero = dict(model.table.groupBy("component").agg(F.sum(-F.col("mean") / F.col("deviation") * F.col("loading"))).collect())  # a row for each component
    base = F.array(*(F.struct(F.lit(c).alias("component"), F.lit(float(at_zero.get(c, 0.0))).alias("base")) for c in range(len(model.weights))))
    every = donors.select("donor_id", F.explode(base).alias("b")).select("donor_id", "b.*")
    got = features.join(model.table, "feature").groupBy("donor_id", "component").agg(F.sum(F.col("value") / F.col("deviation") * F.col("loading")).alias("s"))
    return every.join(got, ["donor_id", "component"], "left").select("donor_id", "component", (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("score"))


def predicted(model: Model, scored: DataFrame) -> DataFrame:
    """(donor_id, predicted) of ``scored(donor_id, component, score)``."""
    weight = F.array(*map(F.lit, model.weights))
    return scored.groupBy("donor_id").agg((F.sum(F.col("score") * F.get(weight, F.col("component"))) + model.intercept).alias("predicted"))
