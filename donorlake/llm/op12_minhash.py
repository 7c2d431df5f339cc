"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one node.  A tree branches its nodes by
the minwise token at a chosen coordinate: two sets meet in a branch with the
chance of their similarity, and a tree node has 1 / similarity branches on
average, so pairs at the threshold keep meeting however deep a tree goes while
less similar ones part.  Tree nodes of up to ``SMALL`` documents are compared
exhaustively, larger ones branch again; independent trees repeat this.

A pair at a similarity of 0.8 misses all 15 branches at the roots of 12 trees
with 0.2^15; below, a tree keeps it with about 2 / (2 + 0.32 * depth), so at the
deepest level all trees lose it with 0.5^12.  Crowded tree nodes are also dealt
into random groups of ``SMALL`` / 2, compared likewise, for as long as rounds
find links (these bounds do without the groups).  What is still crowded
at the deepest level (sets that their minwise tokens can't tell apart) is
compared exhaustively, by pairs of blocks, so no case is dropped.

Comparing takes two steps.  Sketches (two bits of 256 minwise tokens) leave the
members of a tree node that may have a partner in another component, which they
don't meet in another tree node of the round before; only their
full shingle sets are fetched, intersected exactly, and a spanning forest of the
true links leaves the tree node, never all pairs.  Rounds follow each other: two
trees, the other trees, deeper levels; each knows the components so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .op10_simhash import components

WORDS = 4
#: Hundredths: links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
TREES = 12
#: Trees of the first round, which finds most links.
FIRST = 2
#: Tree nodes up to this size are compared exhaustively.
SMALL = 1024
#: Levels below the roots; each chooses among so many coordinates of its own.
DEPTH, WIDTH = 5, 16
#: Minwise tokens of a set: for the sketch all, for trees the first ones.
TOKENS = 256
#: Sketches of pairs at 0.8 differ in 38 of 256 places with a deviation of 5.7; five deviations more are let through.
SKETCH_APART = 67
#: Rows (three numbers) up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000

#: (tree, coordinate) of the branches at the roots: one for each tree, a second for a quarter of them.
ROOTS = [(t, t) for t in range(TREES)] + [(t, TREES + t // 4) for t in range(0, TREES, 4)]
_N_ROOTS = len(ROOTS)
_MULTIPLIERS = np.random.default_rng(12).integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the distinct word shingles of a text, ascending; fewer words are one shingle, none are none."""
    w = text.lower().split()  # bytes.lower() knows A-Z only, bytes.split() parts at the six characters of ASCII white space
    if not w:
        return np.zeros(0, np.uint64)
    seen: dict[bytes, int] = {}
    for x in w:
        if x not in seen:
            seen[x] = xxhash.xxh3_64_intdigest(x)
    h = np.array([seen[x] for x in w], np.uint64)
    size = min(words, len(w))
    made = np.full(len(h) - size + 1, size, np.uint64)  # sequences of other lengths are other shingles
    for k in range(size):
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[k : k + len(made)] ^ (h[k : k + len(made)] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    made ^= made >> np.uint64(31)
    return np.unique(made)


def minwise(h: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the permutations."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 512):
        np.minimum(least, (h[k : k + 512, None] * _MULTIPLIERS[None, :]).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """Two bits of each minwise token, mixed from its high bits."""
    x = least * np.uint64(0x9E3779B97F4A7C15)
    bits = np.stack([(x >> np.uint64(63)) & np.uint64(1), (x >> np.uint64(62)) & np.uint64(1)], axis=1).astype(np.uint8)
    return np.packbits(bits.ravel()).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places where sketches (rows of eight numbers) differ, for all pairs."""
    total = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        total += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return total


PRINTS = "doc_id long, text_hash long, node long, n_shingles long, root array<long>, deep array<int>, sketch binary"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty()).withColumn("text_hash", F.xxhash64("text"))


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For each document: a number for its shingle set (null: none), its size, and minwise tokens."""
    common.prepare(docs.sparkSession)

    def work(batches):
        for b in batches:
            rows = {k: [] for k in ("node", "n_shingles", "root", "deep", "sketch")}
            for text in b.column(2).to_pylist():
                h = shingle_set(text, words)
                least = minwise(h)
                node = np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64).view(np.int64)[0] if len(h) else None
                low = (least[_N_ROOTS : _N_ROOTS + DEPTH * WIDTH] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for k, v in zip(rows, (node, len(h), least[:_N_ROOTS].view(np.int64), low, sketch(least))):
                    rows[k].append(v)
            kinds = {"node": pa.int64(), "n_shingles": pa.int64(), "root": pa.list_(pa.int64()), "deep": pa.list_(pa.int32()), "sketch": pa.binary()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text_hash": b.column(1)} | {k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return _rows(docs).select("doc_id", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(work, PRINTS)


def nodes_of(found: DataFrame) -> DataFrame:
    """A row for each set of ``prints``, with the smallest doc_id and a document whose text it can be read from."""
    one = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("of"), *(F.first(c).alias(c) for c in ("n_shingles", "root", "deep", "sketch")))
    return common.materialize(one.select("node", "least", "n_shingles", "of.doc_id", "of.text_hash", "root", "deep", "sketch"), "minhash-nodes")


def rooted(nodes: DataFrame, branches) -> DataFrame:
    """(key, node): the tree nodes below the roots."""
    return nodes.select(F.explode(F.array(*(F.xxhash64(F.lit(t), F.lit(c), F.col("root")[c]) for t, c in branches))).alias("key"), "node")


def branched(rows: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(key, node): the branches of crowded tree nodes, one at a coordinate that the tree node's key chooses, for a quarter of them a second."""
    at = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(m))
    first = at(1, WIDTH)
    second = F.pmod(first + 1 + at(2, WIDTH - 1), F.lit(WIDTH))
    way = lambda c: F.xxhash64(F.col("key"), c, F.get("deep", (c + level * WIDTH).cast("int")))
    chosen = F.when(at(3, 4) == 0, F.array(way(first), way(second))).otherwise(F.array(way(first)))
    return rows.join(nodes.select("node", "deep"), "node").select(F.explode(chosen).alias("key"), "node")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a tree node side by side."""
    return rows.repartition(common.shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key")


def _runs(batches):
    """Lists of columns for each tree node of rows that stand by key; one tree node is held at a time."""
    held = None
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            if held is not None and held[0] == key[lo]:
                held[1].append(part)
                continue
            if held is not None:
                yield held
            held = (key[lo], [part])
    if held is not None:
        yield held


def _column(parts, k: int) -> np.ndarray:
    return np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts])


def _binary(parts, k: int) -> list[bytes]:
    return [x for p in parts for x in p.column(k).to_pylist()]


def _met_before(key: int, keys: pa.ListArray) -> np.ndarray | None:
    """A column for each key before ``key`` that at least two rows have; rows with a common one meet there."""
    n = np.diff(keys.offsets.to_numpy(zero_copy_only=False))
    flat, row = keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
    flat, row = flat[flat < key], row[flat < key]
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    if not often.any():
        return None
    has = np.zeros((len(n), int(often.sum())), np.float32)
    has[row[often[at]], (np.cumsum(often) - 1)[at[often[at]]]] = 1
    return has


def promising(rows: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Of ``rows(key, node, label, sketch, n_shingles, of, part, keys)`` those (key, node, label) with a partner of another label in their tree node.

    A partner's sketch is near and its set large enough for a link.  Two that
    meet more than once in a round are partners where they first do: ``of`` is
    the tree node that a group compares (all of, or one pair of its blocks:
    ``part``), ``keys`` all those of the row's node.
    """

    def work(batches):
        keys, nodes, labels = [], [], []
        for key, parts in _runs(batches):
            label = _column(parts, 2)
            if len(label) < 2 or (label == label[0]).all():
                continue
            s, near = np.frombuffer(b"".join(_binary(parts, 3)), np.uint64).reshape(len(label), -1), np.zeros(len(label), bool)
            size, part, met = _column(parts, 4), _column(parts, 6), False
            for k in range(0, len(label), 256):
                some = slice(k, k + 256)
                fits = 100 * np.minimum(size[some, None], size) >= similarity * np.maximum(size[some, None], size)
                fits &= (label[some, None] != label[None, :]) & ((part[some, None] != part[None, :]) | (part[None, :] < 0))
                fits &= apart(s[some], s) <= SKETCH_APART
                if fits.any():
                    if met is False:
                        met = _met_before(parts[0].column(5)[0].as_py(), pa.concat_arrays([p.column(7) for p in parts]))
                    if met is not None:
                        fits &= met[some] @ met.T == 0
                    near[some] |= fits.any(axis=1)
                    near |= fits.any(axis=0)
            hit = np.flatnonzero(near)
            if len(hit):
                keys.append(np.full(len(hit), key))
                nodes.append(_column(parts, 1)[hit])
                labels.append(label[hit])
            if sum(map(len, keys)) > 1 << 15:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "node": np.concatenate(nodes), "label": np.concatenate(labels)})
                keys, nodes, labels = [], [], []
        if keys:
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "node": np.concatenate(nodes), "label": np.concatenate(labels)})

    return _dealt(rows.select("key", "node", "label", "sketch", "n_shingles", "of", "part", "keys")).mapInArrow(work, "key long, node long, label long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[size[0], both], [both, size[1]]], np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, common_ = np.repeat(np.arange(len(sets)), size), times > 1
    place = (np.cumsum(common_) - 1)[at]
    keep = common_[at]
    who, place, found = who[keep], place[keep], np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(place, kind="stable")
    who, place = who[order], place[order]
    width = max(64, (1 << 22) // len(sets))
    for lo in range(0, int(common_.sum()), width):
        a, b = np.searchsorted(place, (lo, lo + width))
        has = np.zeros((len(sets), width), np.float32)
        has[who[a:b], place[a:b] - lo] = 1
        found += (has @ has.T).astype(np.int64)
    np.fill_diagonal(found, size)
    return found


def forest(linked: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie what the links tie, given that equal labels are tied already."""
    _, group = np.unique(label, return_inverse=True)
    todo, edges = np.ones(len(label), bool), []
    for root in range(len(label)):
        if not todo[root]:
            continue
        front = np.flatnonzero(group == group[root])
        todo[front] = False
        while len(front):
            open_ = np.flatnonzero(todo)
            near = linked[np.ix_(front, open_)]
            new = []
            for k in np.flatnonzero(near.any(axis=0)):
                if todo[open_[k]]:
                    edges.append((int(front[near[:, k].argmax()]), int(open_[k])))
                    new.append(np.flatnonzero((group == group[open_[k]]) & todo))
                    todo[new[-1]] = False
            front = np.concatenate(new) if new else np.zeros(0, np.int64)
    return edges


def verified(rows: DataFrame, similarity: int) -> DataFrame:
    """(a, b): a spanning forest of the true links between labels in each tree node of ``rows(key, node, label, s)``."""

    def work(batches):
        a, b = [], []
        for _, parts in _runs(batches):
            label = _column(parts, 2)
            if len(label) < 2 or (label == label[0]).all():
                continue
            node, sets = _column(parts, 1), [np.frombuffer(x, np.uint64) for x in _binary(parts, 3)]
            both, size = intersections(sets), np.array([len(s) for s in sets])
            links = 100 * both >= similarity * (size[:, None] + size[None, :] - both)
            for x, y in forest(links, label):
                a.append(node[x])
                b.append(node[y])
            if len(a) > 1 << 15:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(rows.select("key", "node", "label", "s")).mapInArrow(work, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, s): the full shingle sets of ``wanted(node, doc_id, text_hash)``."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "s": pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())})

    rows = _rows(docs)
    named = wanted.select("node", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    found = rows.join(_small(named), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    return found.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(work, "node long, s binary").dropDuplicates(["node"])


def links(docs: DataFrame, nodes: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(node, root): the components of ``nodes(node, n_shingles, root, deep, sketch, doc_id, text_hash)``, for all that have a link."""
    edges = labels = crowded = sets = None
    mixing = True
    early = [b for b in ROOTS if b[0] < FIRST]
    for round_ in range(DEPTH + 2):
        parts = [rooted(nodes, early if round_ == 0 else [b for b in ROOTS if b not in early])] if round_ < 2 else []
        if crowded is not None:
            parts.append(branched(crowded, nodes, round_ - 1) if round_ <= DEPTH else crowded)
        if not parts:
            break
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if labels is not None:
            rows = rows.join(labels, "node", "left")
        named = common.materialize(rows.select("key", "node", (F.col("node") if labels is None else F.coalesce("label", "node")).alias("label")), "minhash-tree")
        # only tree nodes with members of more than one component go on
        sizes = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "n")
        live = named.join(_small(common.materialize(sizes, "minhash-sizes")), "key")
        large = live.where(F.col("n") > small)
        crowded = common.materialize(large.select("key", "node", "n", "label"), "minhash-crowded")
        crowded = None if crowded.isEmpty() else crowded
        whole = lambda key: (key.alias("of"), F.lit(-1).cast("long").alias("part"))
        compared = live.where(F.col("n") <= small).select("key", "node", "label", *whole(F.col("key")))
        if crowded is not None:
            block, blocks = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") * 2 / small)), F.ceil(F.col("n") * 2 / small)
            mixed = lambda *c: F.xxhash64("key", F.lit("block"), *c)
            if round_ > DEPTH:  # pairs of blocks
                dense = crowded.withColumn("block", block).select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
                part = F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).cast("long")
                compared = compared.unionByName(dense.select(mixed(F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "label", F.col("key").alias("of"), part.alias("part")))
            elif mixing:  # random groups
                compared = compared.unionByName(crowded.select(mixed(block).alias("key"), "node", "label", *whole(mixed(block))))
            crowded = crowded.select("key", "node")
        compared = compared.withColumn("keys", F.collect_set("of").over(Window.partitionBy("node")))
        hopeful = common.materialize(promising(compared.join(nodes.select("node", "sketch", "n_shingles"), "node"), similarity), "minhash-promising")
        if hopeful.isEmpty():
            mixing = mixing and round_ == 0
            continue
        new = hopeful.select("node").distinct()
        wanted = nodes.join(new if sets is None else new.join(sets, "node", "left_anti"), "node").select("node", "doc_id", "text_hash")
        more = common.materialize(shingle_sets(docs, common.materialize(wanted, "minhash-wanted"), words), "minhash-sets")
        sets = more if sets is None else sets.unionByName(more)
        found = common.materialize(verified(hopeful.join(sets, "node"), similarity), "minhash-links")
        mixing = mixing and (round_ == 0 or not found.isEmpty())
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges).withColumnRenamed("root", "label")
    if labels is None:
        return nodes.select("node", F.col("node").alias("root")).limit(0)
    return labels.withColumnRenamed("label", "root")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that a chain of links reaches, the document's own included.

    Links have 100 * intersection >= similarity * union of the sets of distinct
    word shingles.  Null and empty texts, and texts without words, have the
    empty set and are linked with nothing.  Rows with the same doc_id are rows
    of their own; null doc_ids get the component of their links (null where it
    has no other id).  Columns besides doc_id and text are ignored; an empty
    table gives no rows.
    """
    found = common.materialize(prints(docs, words), "minhash-prints")
    nodes = nodes_of(found)
    tied = nodes.select("node", "least").join(links(docs, nodes.drop("least"), words, similarity, small), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = common.materialize(tied.join(named, "root").select("node", "component_id"), "minhash-components")
    some = found.where("node is not null").select("doc_id", "node", "n_shingles").join(_small(by_node), "node").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(found.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document, and whether it stays as the smallest of its component (see near_duplicates for nulls, ties and empty tables)."""
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same in SQL: pairs of distinct sets by their common shingles, components by reaching out.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM w
), c AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM s GROUP BY list_sort(s), len(s)
), e AS (
  SELECT node, n, hash(unnest(s)) AS x FROM c
), p AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), t AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT node, node AS to_ FROM c UNION SELECT r.node, t.b FROM r JOIN t ON t.a = r.to_
), m AS (
  SELECT node, min(to_) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE m.component_id END AS component_id,
       s.doc_id = CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE m.component_id END AS kept
FROM s JOIN c ON list_sort(s.s) = c.s JOIN m ON m.node = c.node
"""
