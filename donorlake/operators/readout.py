"""Held-out readouts: ridge, train-fit PCA, trajectories, residuals.

Features are donor-sized: Gram matrices are summed by Spark and only they (p x p)
reach the driver, never the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_unique
from ..sources.shared import ship, written
from .gram import FAN_IN
from .stats import regression, spearman

LEAST_TRAIN, LEAST_TEST = 5, 3
#: Tasks that add up products of a donor table; the driver gets a matrix of features x features from each, one at a time.
SUMMED_BY = 4
#: Donors of a group of ``grouped_ridge``: up to here their number, added up as a double, is exact; more are an error.
MOST_DONORS = 1 << 53
#: Numbers that a task of ``grouped_ridge`` keeps of its groups before it gives them away.
MOST_HELD = 1 << 22


def _moments(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums and sums of products of columns.

    Some tasks each add up one small dense matrix of the donors that they get;
    only these matrices reach the driver, so the plan's size doesn't grow with
    the number of columns.  A null counts as 0.
    """
    p = len(columns)

    def task(batches):
        n, s, m = 0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, p))
            n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([m.tobytes()])], ["n", "s", "m"])

    parts = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).repartition(SUMMED_BY).mapInArrow(task, "n long, s binary, m binary")
    n, s, m = 0, np.zeros(p), np.zeros((p, p))
    for part in parts.toLocalIterator():
        n, s, m = n + part.n, s + np.frombuffer(bytes(part.s)), m + np.frombuffer(bytes(part.m)).reshape(p, p)
    return n, s, m


def ridge_fit(train: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> dict | None:
    """Weights and intercept on raw features of a ridge on features standardised by the population deviation; null below 5 rows."""
    rows = train.dropna(subset=[*features, target])
    n, s, m = _moments(rows, [*features, target])
    if n < LEAST_TRAIN:
        return None
    mean = s / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    sd[sd < 1e-12] = 1.0
    gram = cov[:-1, :-1] / np.outer(sd, sd) * n
    w = np.linalg.solve(gram + alpha * np.eye(len(features)), cov[:-1, -1] / sd * n) / sd
    return {"weights": w.tolist(), "intercept": float(mean[-1] - mean[:-1] @ w)}


def apply_linear(rows: DataFrame, features: list[str], fit: dict, out: str = "predicted") -> DataFrame:
    value = F.lit(fit["intercept"])
    for c, w in zip(features, fit["weights"]):
        value = value + F.col(c) * F.lit(w)
    return rows.withColumn(out, value)


def ridge_predictions(donors: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(donor_id, observed, predicted) of test donors of ``donors(donor_id, is_test, target, features...)``.

    Donors with a missing value go; no rows below 5 train or 3 test donors.
    """
    known = donors.dropna(subset=[*features, target])
    fit = ridge_fit(known.where("not is_test"), features, target, alpha)
    test = known.where("is_test")
    if fit is None or test.limit(LEAST_TEST).count() < LEAST_TEST:
        return donors.sparkSession.createDataFrame([], "donor_id string, observed double, predicted double")
    return apply_linear(test, features, fit).select("donor_id", F.col(target).alias("observed"), "predicted")


def pca_fit(train: DataFrame, features: list[str], k: int) -> dict:
    """Means and loadings of the first components, fitted on these rows; signs so that the largest loading is positive.

    The width is at most the rows less one and the number of features.
    """
    n, s, m = _moments(train, features)
    mean = s / n
    values, vectors = np.linalg.eigh(m / n - np.outer(mean, mean))
    k = min(k, n - 1, len(features))
    load = vectors[:, np.argsort(-values)[:k]].T
    load *= np.sign(load[np.arange(len(load)), np.abs(load).argmax(axis=1)])[:, None]
    return {"mean": mean.tolist(), "loadings": load.tolist()}


def pca_apply(rows: DataFrame, features: list[str], fit: dict) -> tuple[DataFrame, list[str]]:
    names = [f"pc{i + 1}" for i in range(len(fit["loadings"]))]
    for name, load in zip(names, fit["loadings"]):
        value = F.lit(0.0)
        for c, m, w in zip(features, fit["mean"], load):
            value = value + (F.col(c) - F.lit(m)) * F.lit(w)
        rows = rows.withColumn(name, value)
    return rows, names


def trajectory(donors: DataFrame, features: list[str], target: str) -> DataFrame:
    """(rho, n, protocol): first component fitted and oriented on train donors against the target of test donors; null where the train correlation is 0 or undefined."""
    fit = pca_fit(donors.where("not is_test").dropna(subset=features), features, 1)
    rows, _ = pca_apply(donors, features, fit)
    rho = spearman(rows.select("is_test", "pc1", target), "pc1", target, "is_test")
    got = rho.groupBy().agg(F.max(F.when(~F.col("is_test"), F.col("rho"))).alias("train"), F.max(F.when(F.col("is_test"), F.col("rho"))).alias("test"), F.max(F.when(F.col("is_test"), F.col("n"))).alias("n"))
    return got.select(F.when(F.col("train") != 0, F.signum("train") * F.col("test")).alias("rho"), "n", F.lit("inductive_v2").alias("protocol"))


def residual_readout(donors: DataFrame, base: list[str], state: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(donor_id, observed, predicted): what the state features say of the part of the target that the base features leave, on test donors."""
    known = donors.dropna(subset=[*base, *state, target])
    first = ridge_fit(known.where("not is_test"), base, target, alpha)
    if first is None:
        return donors.sparkSession.createDataFrame([], "donor_id string, observed double, predicted double")
    rest = apply_linear(known, base, first, "_base").withColumn("_residual", F.col(target) - F.col("_base"))
    return ridge_predictions(rest.select("donor_id", "is_test", F.col("_residual").alias("residual"), *state), state, "residual", alpha)


def readout_null(donors: DataFrame, features: list[str], targets: DataFrame, truth: str, alpha: float = 1.0) -> DataFrame:
    """(rep, rho): ridge on permuted train targets ``targets(rep, donor_id, value)``, scored on true test targets.

    Features are fixed, so the Gram matrix is solved once; each replicate is a
    column of right-hand sides, summed by Spark.
    """
    train = donors.where("not is_test").dropna(subset=features)
    n, s, m = _moments(train, features)
    mean = s / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    inv = np.linalg.inv(cov / np.outer(sd, sd) * n + alpha * np.eye(len(features)))
    z = train.select("donor_id", *(((F.col(c) - F.lit(float(a))) / F.lit(float(b))).alias(c) for c, a, b in zip(features, mean, sd)))
    sides = targets.join(z, "donor_id").groupBy("rep").agg(F.avg("value").alias("_y"), *(F.sum(F.col(c) * F.col("value")).alias(c) for c in features))
    weights = [sum((F.col(c) * F.lit(float(inv[i, j])) for j, c in enumerate(features)), F.lit(0.0)).alias(f"w_{i}") for i in range(len(features))]
    solved = sides.select("rep", "_y", *weights)
    test = donors.where("is_test").dropna(subset=[*features, truth])
    value = F.col("_y")
    for i, (c, a, b) in enumerate(zip(features, mean, sd)):
        value = value + (F.col(c) - F.lit(float(a))) / F.lit(float(b)) * F.col(f"w_{i}")
    scored = test.join(F.broadcast(solved))  # replicates x test donors
    return spearman(scored.select("rep", value.alias("p"), F.col(truth).alias("o")), "p", "o", "rep")


def transfer(source: DataFrame, target: DataFrame, features: list[str], outcome: str, alpha: float = 1.0) -> DataFrame:
    """(mode, donor_id, observed, predicted): the source's readout on the target cohort.

    ``strict``: fitted on the source's train donors, applied to all target donors,
    whose outcomes are never used.  ``refit``: fitted on the target's train
    donors (5 or more), applied to its test donors (3 or more).  Features that
    the target lacks are zero.
    """
    for c in features:
        if c not in target.columns:
            target = target.withColumn(c, F.lit(0.0))
    fit = ridge_fit(source.where("not is_test"), features, outcome, alpha)
    if fit is None:
        raise ValueError("the source has too few train donors")
    strict = apply_linear(target.na.fill(0.0, features), features, fit).select(F.lit("strict").alias("mode"), "donor_id", F.col(outcome).alias("observed"), "predicted")
    refit = ridge_predictions(target, features, outcome, alpha).select(F.lit("refit").alias("mode"), "donor_id", "observed", "predicted")
    return strict.unionByName(refit)


def vocabulary_coverage(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Share of the target's distinct values that the source knows."""
    known = source.select(column).distinct().withColumn("hit", F.lit(1))
    return target.select(column).distinct().join(known, column, "left").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage"))


def softmax_standin(train: DataFrame, features: list[str], label: str):
    """Multinomial logistic regression in the place of a neural probe: deterministic, not numerically equal to one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(train)
    return LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50, regParam=1e-3).fit(rows)


def _merged(parts: list[tuple]) -> tuple:
    """Counts, means and centred products of the union of disjoint rows, from those of its parts ``(n_train, n_test, mean, m)``."""
    n, test, mean, m = parts[0]
    for k, t, other, v in parts[1:]:
        test += t
        if k:
            gap, whole = other - mean, n + k
            m, mean, n = m + v + np.outer(gap, gap) * (n * k / whole), mean + gap * (k / whole), whole
    return n, test, mean, m


def _sums(batches, by: str):
    """Rows of SUMS: what a task's train rows of each group add up to, and how many test rows it has."""
    import pyarrow as pa
    from pyspark import TaskContext

    found, held, kind = {}, 0, None

    def told():
        keys, values = list(found), list(found.values())
        return pa.RecordBatch.from_pydict({by: pa.array(keys, kind), "part": pa.array([task] * len(keys), pa.int32()), "n_train": pa.array([float(v[0]) for v in values]), "n_test": pa.array([float(v[1]) for v in values]), "mean": pa.array([v[2].tobytes() for v in values], pa.binary()), "m": pa.array([v[3].tobytes() for v in values], pa.binary())})

    task = TaskContext.get().partitionId()
    for b in batches:
        kind = b.schema.field(by).type
        coded = b.column(b.schema.get_field_index(by)).dictionary_encode(null_encoding="encode")
        codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        test = b.column(b.schema.get_field_index("is_test")).to_numpy(zero_copy_only=False).astype(bool)
        y, x = b.column(b.schema.get_field_index("target")).to_numpy(), b.column(b.schema.get_field_index("x"))
        starts, flat = x.offsets.to_numpy(), x.values.to_numpy()
        for i, key in enumerate(keys):
            mine = np.flatnonzero(codes == i)
            train = mine[~test[mine]]
            width = int(starts[mine[0] + 1] - starts[mine[0]])
            rows = np.column_stack([flat[starts[train][:, None] + np.arange(width)], y[train]]) if len(train) else np.zeros((0, width + 1))
            first = rows[0] if len(rows) else np.zeros(width + 1)  # a constant stays one, to the last bit
            off = rows - first
            middle = off.mean(axis=0) if len(rows) else first
            off = off - middle
            part = (len(train), len(mine) - len(train), first + middle, off.T @ off)
            if key not in found:
                held += part[3].size
            found[key] = part if key not in found else _merged([part, found[key]] if not found[key][0] else [found[key], part])
        if held > MOST_HELD:
            yield told()
            found, held = {}, 0
    if found:
        yield told()


def grouped_ridge(rows: DataFrame, by: str, alpha: float = 1.0) -> DataFrame:
    """(by, donor_id, observed, predicted): a ridge in each group of ``rows(by, donor_id, is_test, target, x)``, for its test donors.

    ``x`` is an array of features, as long in all rows of a group.  Rows with a
    null target, vector or value in it go; a group with fewer than 5 train or 3
    test donors has no rows.  Tasks add up the centred products of the train
    rows that they have, and these are merged by group in two rounds: what is
    gathered is features x features, whatever the number of donors.
    """
    spark, most, least_train, least_test = rows.sparkSession, MOST_DONORS, LEAST_TRAIN, LEAST_TEST
    ship(spark)
    known = rows.select(by, "donor_id", F.coalesce("is_test", F.lit(False)).alias("is_test"), F.col("target").cast("double").alias("target"), F.col("x").cast("array<double>").alias("x"))
    known = written(known.where(F.col("target").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))), "ridge-rows")
    kind = {f.name: f.dataType.simpleString() for f in known.schema}[by]
    sums = f"`{by}` {kind}, part int, n_train double, n_test double, mean binary, m binary"
    parts = known.select(by, "is_test", "target", "x").mapInArrow(lambda batches: _sums(batches, by), sums)

    def read(part):
        got = [(r.n_train, r.n_test, np.frombuffer(r.mean), np.frombuffer(r.m).reshape(len(r.mean) // 8, -1)) for r in part.sort_values("part").itertuples()]
        return _merged(sorted(got, key=lambda g: not g[0]))  # those without train rows last

    def merge(part):
        n, test, mean, m = read(part)
        return part.iloc[:1].assign(part=part["part"] // FAN_IN, n_train=n, n_test=test, mean=mean.tobytes(), m=m.tobytes())[[by, "part", "n_train", "n_test", "mean", "m"]]

    def solve(part):
        n, test, mean, m = read(part)
        if n + test > most:
            raise ValueError(f"a group has more than {most} donors")
        if n < least_train or test < least_test:
            return part.iloc[:0].assign(mean=None, weights=None, middle=0.0)[[by, "mean", "weights", "middle"]]
        sd = np.sqrt(np.diag(m)[:-1] / n)
        sd[sd < 1e-12] = 1.0
        w = np.linalg.solve(m[:-1, :-1] / np.outer(sd, sd) + alpha * np.eye(len(sd)), m[:-1, -1] / sd) / sd
        return part.iloc[:1].assign(mean=[mean[:-1].tolist()], weights=[w.tolist()], middle=mean[-1])[[by, "mean", "weights", "middle"]]

    fewer = parts.groupBy(by, F.floor(F.col("part") / FAN_IN).alias("_to")).applyInPandas(merge, sums)
    fits = fewer.groupBy(by).applyInPandas(solve, f"`{by}` {kind}, mean array<double>, weights array<double>, middle double").withColumnRenamed(by, "_by")
    tested = known.where("is_test").join(fits, F.col(by).eqNullSafe(F.col("_by")))
    off = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "weights", lambda a, b: a * b)
    return tested.select(by, "donor_id", F.col("target").alias("observed"), (F.aggregate(off, F.lit(0.0), lambda s, v: s + v) + F.col("middle")).alias("predicted"))


def evaluation_donors(features: DataFrame, targets: DataFrame, split: DataFrame, by: str) -> DataFrame:
    """(by, donor_id, is_test, target, x): donors of ``split(donor_id, is_test)`` with features and a target.

    ``features(by, donor_id, x)``, ``targets(donor_id, target)``.  A repeated
    donor in a group's features, in the targets or on one side of the split is
    an error, and so is one on both sides.  Donors of the split without
    features or with a missing target are left out.
    """
    require_unique(features, by, "donor_id")
    require_unique(targets, "donor_id")
    sides = split.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("is_test").alias("k"))
    wrong = sides.where("n > 1").orderBy(F.desc("k")).limit(1).collect()
    if wrong:
        raise ValueError("a donor is in train and test" if wrong[0].k > 1 else "a donor is in the split twice")
    known = targets.where(F.col("target").isNotNull() & ~F.isnan("target")).select("donor_id", "target")
    return features.select(by, "donor_id", "x").join(split.select("donor_id", "is_test"), "donor_id").join(known, "donor_id").select(by, "donor_id", "is_test", "target", "x")


def regress_heldout(rows: DataFrame, by: str, alpha: float = 1.0) -> DataFrame:
    """(by, rho, r2, mae, n_train, n_test) of a ridge in each group of ``rows(by, donor_id, is_test, target, x)``.

    Figures are null below 5 train or 3 test donors; rho also where a side is
    constant, r2 where the observed values are.
    """
    counts = rows.groupBy(by).agg(F.count(F.when(~F.col("is_test"), 1)).alias("n_train"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))
    got = grouped_ridge(rows, by, alpha)
    rho = spearman(got, "observed", "predicted", by).select(by, "rho")
    return counts.join(rho, by, "left").join(regression(got, "observed", "predicted", by).select(by, "r2", "mae"), by, "left").select(by, "rho", "r2", "mae", "n_train", "n_test")


def block_combinations(donors: DataFrame, blocks: dict[str, list[str]], combinations: list[tuple[str, ...]], target: str, alpha: float = 1.0) -> DataFrame:
    """(blocks, donor_id, observed, predicted) of a ridge on each combination of feature blocks, all in one job; nulls in features are 0."""
    filled = donors.na.fill(0.0, [c for cs in blocks.values() for c in cs])
    each = F.array(*(F.struct(F.lit("+".join(combo)).alias("blocks"), F.array(*(F.col(c).cast("double") for b in combo for c in blocks[b])).alias("x")) for combo in combinations))
    rows = filled.select("donor_id", "is_test", F.col(target).alias("target"), F.explode(each).alias("_e")).select("donor_id", "is_test", "target", "_e.*")
    return grouped_ridge(rows, "blocks", alpha)


def state_rho(vectors: DataFrame, donors: DataFrame, target: str, dims: int, least_cells: int = 30, alpha: float = 1.0) -> DataFrame:
    """(type, rho, n): per cell type, a donor's mean vector (of ``least_cells`` or more) read out by ridge, against held-out targets.

    ``vectors(donor_id, cell_type, embedding)``; all types are fitted in one job.
    """
    means = vectors.groupBy("donor_id", "cell_type").agg(F.count(F.lit(1)).alias("_n"), F.array(*(F.avg(F.col("embedding")[i]) for i in range(dims))).alias("x")).where(F.col("_n") >= least_cells)
    rows = means.join(donors.select("donor_id", "is_test", F.col(target).alias("target")), "donor_id").withColumnRenamed("cell_type", "type")
    return spearman(grouped_ridge(rows, "type", alpha), "observed", "predicted", "type")
