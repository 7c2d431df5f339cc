"""A linear map from cells to class texts, trained by full-batch gradient descent; the stand-in for the neural text arms.

A cell's features are mapped to the text space, and the map is trained so that
the cosine with its own class's vector stands out among all classes' (softmax
over the bank, at a temperature).  Each round is one job for all arms: partitions
read their cells once and sum each arm's gradient and loss, a tree of shuffles
adds them up, the driver takes the steps and broadcasts the weights.  A step that
doesn't lower the loss is taken back and halved, so the accepted losses fall.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship, written
from .gram import STRIPS, added_up

#: Features of the map; choose variable genes first.
MOST_FEATURES = 20_000
ROWS, STRIP = 512, 1 << 16
#: Numbers of donors' sums that a task holds.
HELD = 1 << 21


@dataclass
class Trained:
    """Weights (text dimensions x features), bias, and the accepted losses."""

    weights: np.ndarray
    bias: np.ndarray
    history: list[float] = field(default_factory=list)


def cell_rows(expr: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """``cells(cell_id, ...)`` with sparse features ``at`` (places in ``genes``) and ``x``; a cell without any has empty ones."""
    if len(genes) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    places = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, at int")
    known = expr.join(F.broadcast(places), "gene").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("double").alias("x")))).alias("l"))
    got = cells.join(known, "cell_id", "left")
    return got.select(*cells.columns, F.coalesce(F.transform("l", lambda p: p["at"]), F.array().cast("array<int>")).alias("at"), F.coalesce(F.transform("l", lambda p: p["x"]), F.array().cast("array<double>")).alias("x"))


def _dense(b: pa.RecordBatch, width: int) -> np.ndarray:
    at, x = b.column(b.schema.get_field_index("at")), b.column(b.schema.get_field_index("x"))
    out = np.zeros((b.num_rows, width))
    sizes = np.diff(at.offsets.to_numpy())
    out[np.repeat(np.arange(b.num_rows), sizes), at.flatten().to_numpy()] = x.flatten().to_numpy()
    return out


def loss_and_gradient(x: np.ndarray, label: np.ndarray, bank: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over the rows of the loss and its gradients by weights and bias."""
    z = x @ weights.T + bias
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    u = z / size
    s = u @ bank.T / temperature
    s -= s.max(axis=1, keepdims=True)
    log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
    p = np.exp(log_p)
    p[np.arange(len(x)), label] -= 1
    du = p @ bank / temperature
    dz = np.where(size > 1e-9, (du - u * (u * du).sum(axis=1, keepdims=True)) / size, 0)  # a cell that maps to nothing has no direction
    return float(-log_p[np.arange(len(x)), label].sum()), dz.T @ x, dz.sum(axis=0)


def start(dims: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, width)) / np.sqrt(width), np.zeros(dims)


def train(cells: DataFrame, bank: np.ndarray, width: int, seed: int = 0, rounds: int = 20, rate: float = 0.1, temperature: float = 0.07, least_gain: float = 1e-4) -> Trained:
    """The map for ``cells(label, at, x)``; ``bank`` has a unit vector for each label.  See ``train_all``."""
    return train_all(cells, [(bank, np.arange(len(bank)))], width, seed, rounds, rate, temperature, least_gain)[0]


def train_all(cells: DataFrame, banks: list[tuple[np.ndarray, np.ndarray]], width: int, seed: int = 0, rounds: int = 20, rate: float = 0.1, temperature: float = 0.07, least_gain: float = 1e-4) -> list[Trained]:
    """A map for each bank from ``cells(label, at, x)``, as if it were trained alone; all read the cells in the same jobs.

    A bank has unit vectors, and for each label the place of its vector or -1,
    whose cells it isn't trained on.  A map ends after ``rounds`` jobs, or when a
    step gains less than ``least_gain`` of the loss, or is halved below a
    millionth.  No cells: the starting map.
    """
    spark = cells.sparkSession
    ship(spark)
    banks = [(bank / np.maximum(np.linalg.norm(bank, axis=1, keepdims=True), 1e-12), place) for bank, place in banks]
    rows = cells.select("label", "at", "x")
    partitions = max(2, rows.rdd.getNumPartitions())

    def summed(asked: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        now = spark.sparkContext.broadcast([(*asked[k], *banks[k]) for k in asked])

        def work(batches):
            maps = now.value
            totals, seen = [np.zeros(w.size + len(c) + 2) for w, c, _, _ in maps], 0
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    every, label = _dense(part, width), part.column(0).to_numpy()
                    seen += part.num_rows
                    for total, (w, c, bank, place) in zip(totals, maps):
                        at = place[label]
                        own = at >= 0
                        x, at = (every, at) if own.all() else (every[own], at[own])
                        loss, dw, dc = loss_and_gradient(x, at, bank, w, c, temperature)
                        total[: w.size] += dw.ravel()
                        total[w.size : -2] += dc
                        total[-2:] += loss, len(x)
            if seen:
                total = np.concatenate(totals)
                cuts = range(0, len(total), STRIP)
                yield pa.RecordBatch.from_pydict({"strip": pa.array([k // STRIP for k in cuts], pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()), "m": pa.array([total[k : k + STRIP].tobytes() for k in cuts], pa.binary())})

        got = added_up(rows.mapInArrow(work, STRIPS), partitions)
        now.unpersist()
        flat, out, at = np.concatenate([got[k] for k in sorted(got)]) if got else None, {}, 0
        for k, (w, c) in asked.items():
            own = np.zeros(w.size + len(c) + 2) if flat is None else flat[at : at + w.size + len(c) + 2]
            at, n = at + len(own), max(1.0, own[-1])
            out[k] = float(own[-2] / n), own[: w.size].reshape(w.shape) / n, own[w.size : -2] / n
        return out

    made = [Trained(*start(bank.shape[1], width, seed)) for bank, _ in banks]
    now = summed({k: (m.weights, m.bias) for k, m in enumerate(made)})
    for k, m in enumerate(made):
        m.history.append(now[k][0])
    rates = dict.fromkeys(range(len(made)), rate)  # of the maps that go on
    for _ in range(rounds):
        if not rates:
            break
        asked = {k: (made[k].weights - r * now[k][1], made[k].bias - r * now[k][2]) for k, r in rates.items()}
        for k, got in summed(asked).items():
            loss = now[k][0]
            if not got[0] < loss:
                rates[k] /= 2
                if rates[k] < 1e-6:
                    del rates[k]
                continue
            now[k], made[k].weights, made[k].bias = got, *asked[k]
            made[k].history.append(got[0])
            if (loss - got[0]) / max(abs(loss), 1e-12) < least_gain:
                del rates[k]
    return made


def _unit(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = x @ weights.T + bias
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def encoded(cells: DataFrame, trained: Trained) -> DataFrame:
    """``cells(..., at, x)`` with ``embedding``, of unit length, in the place of their features."""
    spark = cells.sparkSession
    ship(spark)
    now = spark.sparkContext.broadcast((trained.weights, trained.bias))
    keep = [c for c in cells.columns if c not in ("at", "x")]
    shape = ", ".join(f"`{n}` {t}" for n, t in cells.dtypes if n in keep) + ", embedding array<double>"

    def work(batches):
        w, c = now.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                z = _unit(_dense(part, w.shape[1]), w, c)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))], names=[*keep, "embedding"])

    return cells.mapInArrow(work, shape)


_SUMS = "donor_id string, n double, m binary"


def _sums(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The donors' numbers of cells (held first) and sums."""
    return pa.RecordBatch.from_pydict({"donor_id": pa.array(list(held), pa.string()), "n": pa.array([m[0] for m in held.values()], pa.float64()), "m": pa.array([m[1:].tobytes() for m in held.values()], pa.binary())})


def donor_means(cells: DataFrame, trained: list[Trained]) -> DataFrame:
    """(donor_id, mean): each donor's mean of ``encoded`` by each map, one after the other, from one pass over ``cells(donor_id, at, x)``.

    Tasks add up their own cells, so what moves is a row for a donor and a task.
    """
    spark = cells.sparkSession
    ship(spark)
    now = spark.sparkContext.broadcast([(t.weights, t.bias) for t in trained])
    dims = sum(len(t.bias) for t in trained)
    most = max(1, HELD // (dims + 1))

    def work(batches):
        maps, held = now.value, {}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                x, coded = _dense(part, maps[0][0].shape[1]), part.column(0).dictionary_encode()
                codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                order = np.argsort(codes, kind="stable")
                z = np.concatenate([np.ones((len(x), 1)), *(_unit(x, w, c) for w, c in maps)], axis=1)
                sums = np.add.reduceat(z[order], np.searchsorted(codes[order], np.arange(len(names))))
                if len(held) + len(names) > most and held:
                    yield _sums(held)
                    held = {}
                for name, m in zip(names, sums):
                    held[name] = held[name] + m if name in held else m
        if held:
            yield _sums(held)

    def added(batches):
        held = {}
        for b in batches:
            for name, n, m in zip(*(c.to_pylist() for c in b.columns)):
                if name not in held and len(held) >= most:  # rows stand by donor
                    yield mean(held)
                    held = {}
                m = np.concatenate([[n], np.frombuffer(m)])
                held[name] = held[name] + m if name in held else m
        if held:
            yield mean(held)

    def mean(held):
        flat = np.concatenate([m[1:] / m[0] for m in held.values()])
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.FixedSizeListArray.from_arrays(pa.array(flat), dims).cast(pa.list_(pa.float64()))], names=["donor_id", "mean"])

    parts = cells.select("donor_id", "at", "x").mapInArrow(work, _SUMS)
    return parts.repartition("donor_id").sortWithinPartitions("donor_id").mapInArrow(added, "donor_id string, mean array<double>")


def donor_block(expr: DataFrame, cells: DataFrame, donors: DataFrame, genes: list[str], banks: dict[str, dict[str, np.ndarray]], seed: int = 0, rounds: int = 20) -> tuple[dict[str, DataFrame], dict[str, Trained]]:
    """{arm: features(donor_id, feature, value)} and the trained maps, for ``banks`` {arm: {class: vector}}.

    Cells of train donors whose class the bank has are trained on; a donor's
    features are the mean of its cells' embeddings.
    """
    if not banks:
        return {}, {}
    spark = expr.sparkSession
    rows = written(cell_rows(expr, cells.join(donors.select("donor_id", "is_test"), "donor_id"), genes), "cells")
    classes = sorted(set().union(*banks.values()))
    labels = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(classes)], "cell_type string, label int"))  # a row for each class
    own = {arm: sorted(bank) for arm, bank in banks.items()}
    given = [(np.array([banks[arm][k] for k in own[arm]]), np.array([own[arm].index(k) if k in banks[arm] else -1 for k in classes])) for arm in banks]
    made = train_all(rows.where("not is_test").join(labels, "cell_type"), given, len(genes), seed, rounds)
    means = written(donor_means(rows, made), "text-arms")
    blocks, at = {}, 0
    for arm, t in zip(banks, made):
        flat = means.select("donor_id", F.posexplode(F.slice("mean", at + 1, len(t.bias))).alias("feature", "value"))
        blocks[arm], at = flat.withColumn("feature", F.col("feature").cast("string")), at + len(t.bias)
    return blocks, dict(zip(banks, made))
