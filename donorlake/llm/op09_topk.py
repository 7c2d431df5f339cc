"""Exact top-k inner products by ball-tree branch and bound per shard.

Candidates are dealt to shards by a hash of their id; each task builds a ball
tree over its shard and takes the queries block by block from files.  For a
block the nodes wait in a heap by their upper bound, centre product plus radius
times query length; a node is opened for those of the block's queries whose
current k-th score the bound still reaches, and children take the queries on.
The k-th score is shared: a pilot of bounded size, a part of the candidates,
gives each query a k-th score that the first shards start from; all nodes of a
shard raise it.  Shards are searched in waves, each several times the size of
the one before: what a wave found gives each query its k-th best score so far,
which is written by blocks of queries and is where the next wave starts.
Shards return what reaches it, and the best k of all are kept.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
K = 5
QUERY_BLOCK = 1024
LEAF = 128
#: Candidates of the pilot, about; any subset is right, a larger one prunes more.
PILOT = 2048
#: Vectors of a shard, about.
SHARD_ROWS = 100_000

VECTORS = "vec_id long, q binary"
FOUND = "query_id long, query_key long, block int, slot int, vec_id long, score long"
#: Sixteenths of the candidates in each wave.
WAVES = (1, 3, 12)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, floor(scale * x) as doubles, which are whole numbers); rows with a null vector or component or a non-finite one go, as do those without an id.

    A product with ``scale`` beyond the doubles is held to the largest of them.
    """

    def work(batches):
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or x is None or any(c is None for c in x):
                    continue
                x = np.array(x, np.float64)
                if np.isfinite(x).all():
                    most = np.finfo(np.float64).max / scale
                    ids.append(i)
                    out.append(np.floor(scale * np.clip(x, -most, most)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "q": pa.array(out, pa.binary())})

    common.prepare(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(work, VECTORS)


def stacked(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of one length; shorter vectors end in zeros, which add nothing to a product."""
    width = max([width, *(len(r) // 8 for r in rows)])
    out = np.zeros((len(rows), width), np.float64)
    for k, r in enumerate(rows):
        out[k, : len(r) // 8] = np.frombuffer(r, "<f8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; doubles where no sum can leave their integers, else Python's integers, held to 64 bits."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, w)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = whole(a) @ whole(b).T
    return np.clip(wide, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class BallTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids = points, ids
        self.x = points.astype(np.float64)
        self.nodes: list[tuple] = []  # centre, radius, rows or children
        if len(points):
            self._build(np.arange(len(points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        x = self.x[rows]
        centre = x.mean(axis=0)
        with np.errstate(all="ignore"):
            far = np.nan_to_num(np.linalg.norm(x - centre, axis=1), nan=np.inf)
        me = len(self.nodes)
        self.nodes.append((centre, float(far.max()), rows, ()))
        if len(rows) > leaf and far.max() > 0:
            a = x[far.argmax()]
            with np.errstate(all="ignore"):
                b = x[np.linalg.norm(x - a, axis=1).argmax()]
                side = np.nan_to_num(x @ (b - a))
            left = side < np.median(side)
            if left.any() and not left.all():
                kids = self._build(rows[left], leaf), self._build(rows[~left], leaf)
                self.nodes[me] = (centre, float(far.max()), None, kids)
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), best first, of each query's best k that reach ``kth``; ids of 2**63-1 fill up. ``kth`` is raised in place."""
        n, none = len(queries), np.iinfo(np.int64)
        top = np.full((n, k), none.min, np.int64)
        names = np.full((n, k), none.max, np.int64)
        if not self.nodes or not n:
            return top, names
        w = self.x.shape[1]
        q = np.zeros((n, w))
        q[:, : min(w, queries.shape[1])] = queries[:, :w]
        length = np.linalg.norm(q, axis=1)

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            with np.errstate(all="ignore"):
                up = q[who] @ centre + length[who] * radius
                up = up + 1 + 1e-9 * (np.abs(up) + np.abs(q[who]) @ np.abs(centre) + length[who] * radius)  # above any rounding
            return np.where(np.isnan(up), np.inf, up)

        who = np.arange(n)
        first = bound(0, who)
        heap, count = [(-first.max(), 0, 0, who, first)], 0
        while heap:
            _, _, node, who, up = heapq.heappop(heap)
            who = who[up >= kth[who]]
            if not len(who):
                continue
            _, _, rows, kids = self.nodes[node]
            if rows is None:
                for kid in kids:
                    up = bound(kid, who)
                    alive = up >= kth[who]
                    if alive.any():
                        count += 1
                        heapq.heappush(heap, (-float(up[alive].max()), count, kid, who[alive], up[alive]))
                continue
            score = products(queries[who], self.points[rows])
            score = np.where(self.ids[rows][None, :] == own[who][:, None], none.min, score)
            good = (score >= kth[who][:, None]) & (score > none.min)
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            t = who[some]
            both = np.concatenate([top[t], np.where(good[some], score[some], none.min)], axis=1)
            ids = np.concatenate([names[t], np.where(good[some], self.ids[rows][None, :], none.max)], axis=1)
            order = np.lexsort((ids, -both.astype(np.float64)), axis=1)[:, :k] if abs(both[both > none.min]).max(initial=0) < 2**53 else np.array([sorted(range(both.shape[1]), key=lambda j, r=r: (-int(both[r, j]), int(ids[r, j])))[:k] for r in range(len(both))])
            top[t], names[t] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
            kth[t] = np.maximum(kth[t], top[t, -1])
        return top, names


def _load(name: str) -> dict:
    fs, path = common.open_fs(name)
    with fs.open_input_file(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates, its own id left out; ties go to the smaller id.

    Both tables are (vec_id, q) as ``quantised`` makes them.  Equal query rows
    are one query; candidates that repeat an id stand for themselves.  Vectors
    of other lengths are compared over the components that both have.  Scores beyond
    64 bits are held to them, and tie there.  Empty tables give no rows.
    """
    spark = candidates.sparkSession
    common.prepare(spark)
    folder = common.shared_dir(spark, "topk")
    queries = queries.distinct().withColumn("query_key", F.xxhash64("vec_id", "q"))
    n_queries, n = queries.count(), candidates.count()
    if not n_queries or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = max(1, n // PILOT)
    pilot_rows = candidates.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(4 * PILOT).collect()  # bounded whatever the table
    pilot_ids = np.array([r[0] for r in pilot_rows], np.int64)
    buffer = io.BytesIO()
    np.savez(buffer, ids=pilot_ids, points=stacked([bytes(r[1]) for r in pilot_rows]))
    common.write_file(f"{folder}/pilot.npz", [buffer.getvalue()])
    blocks = -(-n_queries // QUERY_BLOCK)

    def start(batches):
        from pyspark import TaskContext

        pilot, part, count = _load(f"{folder}/pilot.npz"), TaskContext.get().partitionId(), 0
        tree = BallTree(pilot["points"], pilot["ids"])

        def close(rows, count):
            ids = np.array([r[0] for r in rows], np.int64)
            q = stacked([r[1] for r in rows])
            kth = np.full(len(rows), np.iinfo(np.int64).min, np.int64)
            tree.search(q, ids, kth, k)
            out = io.BytesIO()
            np.savez(out, ids=ids, q=q, keys=np.array([r[2] for r in rows], np.int64), kth=kth)
            name = f"{folder}/queries-{part:06d}-{count:06d}.npz"
            common.write_file(name, [out.getvalue()])
            return pa.RecordBatch.from_pydict({"file": [name]})

        held: list = []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= QUERY_BLOCK:
                yield close(held[:QUERY_BLOCK], count)
                held, count = held[QUERY_BLOCK:], count + 1
        if held:
            yield close(held, count)

    dealt = queries.select("vec_id", "q", "query_key").repartition(min(blocks, common.shuffle_partitions(spark)), "query_key").sortWithinPartitions("query_key", "vec_id", "q")
    files = common.materialize(dealt.mapInArrow(start, "file string"), "topk-blocks")
    listed = sorted(common.materialize(files.orderBy("file"), "topk-list").inputFiles())
    shard_rows = candidates.withColumn("_w", F.pmod(F.xxhash64(F.lit("wave"), "vec_id", "q"), F.lit(sum(WAVES))))
    found, begin = None, 0
    for wave, width in enumerate(WAVES):
        bounds = sorted(_bounds(found, f"{folder}/bounds-{wave}", k, blocks).inputFiles()) if found is not None else []
        part = shard_rows.where((F.col("_w") >= begin) & (F.col("_w") < begin + width)).drop("_w")
        rows = n * width // sum(WAVES)
        shards = max(min(common.shuffle_partitions(spark), -(-rows // 2000)), -(-rows // SHARD_ROWS), 1)
        got = common.materialize(part.repartition(shards, F.xxhash64("vec_id", "q")).mapInArrow(_searcher(listed, bounds, k), FOUND), f"topk-wave{wave}")
        found, begin = got if found is None else found.unionByName(got), begin + width
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(found: DataFrame, folder: str, k: int, blocks: int) -> DataFrame:
    """(block, file): a file for each block of queries with the k-th best score found so far, of the queries that have k."""
    best = Window.partitionBy("block", "slot").orderBy(F.desc("score"), "vec_id")
    kth = found.select("block", "slot", "score", F.row_number().over(best).alias("_k")).where(F.col("_k") == k)

    def write(batches):
        block, slots, scores = None, [], []

        def close():
            name, out = f"{folder}/{block:08d}.npz", io.BytesIO()
            np.savez(out, slots=np.array(slots, np.int64), scores=np.array(scores, np.int64))
            common.write_file(name, [out.getvalue()])
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "file": [name]})

        for b in batches:
            for this, slot, score in zip(*(c.to_pylist() for c in b.columns)):
                if block is not None and this != block:
                    yield close()
                    slots, scores = [], []
                block = this
                slots.append(slot)
                scores.append(score)
        if block is not None:
            yield close()

    parts = min(blocks, common.shuffle_partitions(found.sparkSession))
    return common.materialize(kth.select("block", "slot", "score").repartition(parts, "block").sortWithinPartitions("block", "slot").mapInArrow(write, "block int, file string"), "topk-bounds")


def _searcher(listed: list[str], bounds: list[str], k: int):
    """Takes a shard's candidates through all blocks of queries, from the k-th scores of earlier waves."""

    def search(batches):
        import pyarrow.parquet as pq

        def table(name: str):
            fs, path = common.open_fs(name)
            return pq.read_table(path, filesystem=fs)

        ids, points = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            points += b.column(1).to_pylist()
        if not ids:
            return
        tree = BallTree(stacked(points), np.array(ids, np.int64))
        learned = {i: f for name in bounds for i, f in zip(*(c.to_pylist() for c in table(name).select(["block", "file"]).columns))}
        place = -1
        for list_file in listed:
            for name in table(list_file).column("file").to_pylist():
                place += 1
                block = _load(name)
                kth = block["kth"].copy()
                if place in learned:
                    known = _load(learned[place])
                    kth[known["slots"]] = np.maximum(kth[known["slots"]], known["scores"])
                score, found = tree.search(block["q"], block["ids"], kth, k)
                i, j = np.nonzero(score > np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_pydict({"query_id": block["ids"][i], "query_key": block["keys"][i], "block": np.full(len(i), place, np.int32), "slot": i.astype(np.int32), "vec_id": found[i, j], "score": score[i, j]})

    return search


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of each vector whose id is divisible by 50 (see top_k and quantised for nulls, ties and empty tables)."""
    vectors = common.materialize(quantised(common.read_table(spark, sf_dir, "embeddings")), "quantised")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
