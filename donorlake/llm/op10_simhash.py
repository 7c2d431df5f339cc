"""SimHash near-dedup by multi-index hashing.

Fingerprints are split into segments.  Two that differ in at most ``distance``
bits differ in at most ``radius = distance // segments`` bits of one segment, so
every fingerprint is filed under each of its segments and looks itself up under
every key of the small Hamming ball around them.  A key's rows meet in one run
of a sorted partition; complete distances are verified there, and only the edges
of a spanning forest leave the run, never all pairs.  Equal fingerprints are one
row before that, so copies meet no one.

Runs with more than ``DENSE`` rows are split again by a second segment inside
the rest of the fingerprint: rows that share more than one segment have few
possible values, so a run's size is bounded whatever the data.

Components are found by alternating large and small stars over edges between
distinct fingerprints, each round a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 64
DISTANCE = 3
SEGMENTS = 2
SEED = 42
DENSE = 4096


def fingerprint(text: bytes, words: int, seed: int = SEED) -> int:
    """SimHash of the word shingles (repeats count) of a text, A-Z lower-cased; words are parted by ASCII white space."""
    w = text.lower().split()  # bytes.split() parts at exactly these six characters
    if not w:
        return 0
    digest = xxhash.xxh64_digest
    if len(w) < words:
        hashes = [digest(b" ".join(w), seed)]
    else:
        line = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(w) - words + 1].tolist()
        hashes = [digest(line[a:e], seed) for a, e in zip(starts, ends[words - 1 :].tolist())]
    h = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):  # blocks bound the memory of a very long text
        ones += np.unpackbits(h[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of whole texts; null texts have none of the words and so fingerprint zero."""
    common.prepare(docs.sparkSession)

    def work(batches):
        for b in batches:
            fp = [signed(fingerprint(x, words)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    """Masks of 1 to radius bits."""
    masks, found = [0], []
    for _ in range(radius):
        masks = sorted({m | 1 << b for m in masks for b in range(width) if not m >> b & 1})
        found += masks
    return found


def _keys(fp: np.ndarray, shift: int, width: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, key, looks up) for a segment: itself, and the ball's keys.

    Of two fingerprints that differ inside a segment each would find the other;
    only masks whose highest bit is 0 in the fingerprint are looked up.
    """
    own = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    who, key, probe = [np.arange(len(fp))], [own], [np.zeros(len(fp), bool)]
    for m in _ball(width, radius):
        top = np.uint64(1 << (m.bit_length() - 1))
        k = np.flatnonzero((own & top) == 0)
        who.append(k)
        key.append(own[k] ^ np.uint64(m))
        probe.append(np.ones(len(k), bool))
    return np.concatenate(who), np.concatenate(key), np.concatenate(probe)


ROWS = "k0 long, k1 long, fp long, probe boolean"


def _rows(k0, k1, fp, probe):
    return pa.RecordBatch.from_pydict({"k0": pa.array(k0.astype(np.int64)), "k1": pa.array(k1.view(np.int64) if k1.dtype == np.uint64 else k1), "fp": pa.array(fp.view(np.int64)), "probe": pa.array(probe)})


def filed(distinct: DataFrame, segments: int, distance: int) -> DataFrame:
    """Rows of the table and of its look-ups, by segment number (k0) and key (k1)."""
    width, radius = BITS // segments, distance // segments

    def work(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for s in range(segments):
                who, key, probe = _keys(fp, s * width, width, radius)
                yield _rows(np.full(len(who), s), key, fp[who], probe)

    return distinct.select("fp").mapInArrow(work, ROWS)


def refiled(dense: DataFrame, segments: int, distance: int) -> DataFrame:
    """Rows of dense keys under a second segment: half of the bits outside the first.

    A look-up already differs in its first segment, so it and a filed row differ
    in at most ``distance`` bits outside, one half has at most half of them.
    """
    width = BITS // segments

    def work(batches):
        for b in batches:
            k0, k1, fp, probe = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.astype(np.int64).view(np.uint64)
            for s in range(segments):
                for t in range(segments):
                    if t == s:
                        continue
                    for half in range(2):
                        mine = np.flatnonzero(k0 == s)
                        who, key, more = _keys2(fp[mine], t * width + half * (width // 2), width // 2, distance // 2, probe[mine])
                        who = mine[who]
                        tag = np.int64(1000 + (s * segments + t) * 2 + half)
                        mixed = _mix(k1[who].astype(np.int64).view(np.uint64), key)
                        yield _rows(np.full(len(who), tag), mixed, fp[who], more)

    return dense.select("k0", "k1", "fp", "probe").mapInArrow(work, ROWS)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 32-bit key and a 16-bit key side by side (segments of 32 bits); other widths stay apart likewise as long as both fit."""
    return (a << np.uint64(24)) ^ b


def _keys2(fp, shift, width, radius, probe):
    """As _keys; filed rows are filed, and both filed rows and look-ups look up the whole ball."""
    own = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    filed_rows = np.flatnonzero(~probe)
    who, key, more = [filed_rows, np.flatnonzero(probe)], [own[filed_rows], own[probe]], [np.zeros(len(filed_rows), bool), np.ones(int(probe.sum()), bool)]
    for m in _ball(width, radius):
        who.append(np.arange(len(fp)))
        key.append(own ^ np.uint64(m))
        more.append(np.ones(len(fp), bool))
    return np.concatenate(who), np.concatenate(key), np.concatenate(more)


def forest(fp: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (filed-filed, look-up-filed) of one key; verified on complete distances."""
    nodes, where = np.unique(fp, return_inverse=True)
    table = np.unique(where[~probe])
    seen = np.zeros(len(nodes), bool)
    is_table = np.zeros(len(nodes), bool)
    is_table[table] = True
    edges, step = [], max(1, 4_000_000 // max(1, len(nodes)))
    todo = np.ones(len(nodes), bool)
    for root in range(len(nodes)):
        if seen[root]:
            continue
        seen[root] = True
        todo[root] = False
        front = np.array([root])
        while len(front):
            reached = []
            for k in range(0, len(front), step):
                some = front[k : k + step]
                open_nodes = np.flatnonzero(todo)
                if not len(open_nodes):
                    break
                near = np.bitwise_count(nodes[some][:, None] ^ nodes[open_nodes][None, :]) <= distance
                near &= is_table[some][:, None] | is_table[open_nodes][None, :]
                hit = near.any(axis=0)
                who = near.argmax(axis=0)
                new = open_nodes[hit]
                edges += zip(nodes[some[who[hit]]].tolist(), nodes[new].tolist())
                todo[new] = False
                seen[new] = True
                reached.append(new)
            front = np.concatenate(reached) if reached else np.empty(0, np.int64)
    return edges


def linked(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b) edges between distinct fingerprints from rows that are dealt and sorted by key."""

    def work(batches):
        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield edges([c[:cut] for c in cols], new[:-1])
        if rest is not None and len(rest[0]):
            new = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1
            yield edges(rest, new)

    def edges(cols, new):
        fp, probe = cols[2].astype(np.int64).view(np.uint64), cols[3].astype(bool)
        bounds = np.concatenate([[0], new, [len(fp)]])
        size = np.diff(bounds)
        filed_rows = np.add.reduceat((~probe).astype(np.int64), bounds[:-1])
        a, b = [], []
        for k in np.flatnonzero((size > 1) & (filed_rows > 0)):
            for x, y in forest(fp[bounds[k] : bounds[k + 1]], probe[bounds[k] : bounds[k + 1]], distance):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})

    spark = rows.sparkSession
    dealt = rows.repartition(common.shuffle_partitions(spark), "k0", "k1").sortWithinPartitions("k0", "k1")
    return dealt.mapInArrow(work, "a long, b long")


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Edges that connect all distinct fingerprints within ``distance`` bits of each other."""
    rows = filed(distinct, segments, distance)
    sizes = rows.groupBy("k0", "k1").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("k0", "k1", F.lit(True).alias("dense"))
    dense_keys = common.materialize(sizes, "simhash-dense")
    if dense_keys.isEmpty():
        return linked(rows, distance).distinct()
    marked = rows.join(dense_keys, ["k0", "k1"], "left")
    sparse = linked(marked.where(F.col("dense").isNull()).drop("dense"), distance)
    dense = linked(refiled(marked.where("dense"), segments, distance), distance)
    return sparse.unionByName(dense).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component, for all nodes that have an edge.

    Alternates large stars (each larger neighbour of a node is tied to the least
    one around it) and small stars (each smaller one likewise) until nothing
    changes; every round is a written table.
    """
    e = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        after = common.materialize(small, "stars")
        same = after.count() == e.count() and after.subtract(e).isEmpty()
        common.forget(e.sparkSession, e)
        e = after
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a chain of links reaches, the document's own included.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with the same doc_id are rows of their own; null doc_ids get the
    component of their links (null where it has no other id).  Columns besides
    doc_id and text are ignored; an empty table gives no rows.
    """
    prints = common.materialize(fingerprints(docs, words), "fingerprints")
    distinct = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct, distance, segments))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = common.materialize(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


# Similarity of shingle sets: wide fingerprints find candidates, the sets decide.

WIDE_WORDS = 4
WIDE_SEGMENT = 16
#: A candidate may differ in this many of 64 further bits: at a similarity of 0.8 a bit differs with 0.15, 10 of 64 with a deviation of 3; of unlike texts 32 with 4.
WIDE_LOOSE = 22
#: And in this many of all 256, which is as loose: 38 at a similarity of 0.8, with a deviation of 6.
WIDE_LOOSE_ALL = 88
#: Pairs for each row up to which all pairs of a key are candidates at once; a key with more comes again after the first groups are known.
WIDE_PAIRS = 2
#: Rows of a decision table (two longs each) up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 2_000_000
PRINTS = "doc_id long, text_hash long, node long, " + ", ".join(f"w{i} long" for i in range(WIDE_WORDS))
_WIDE_ROWS = "k0 long, k1 long, node long, x long, probe boolean"


def shingle_hashes(text: bytes, words: int, wide: bool) -> np.ndarray:
    """A row of 32 bytes (wide) or one 64-bit number for each shingle, repeats included."""
    w = text.lower().split()
    if not w:
        return np.zeros((0, 32), np.uint8) if wide else np.zeros(0, np.uint64)
    line = b" ".join(w)
    if len(w) < words:
        cuts = [line]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(size + 1) - 1
        cuts = [line[a:e] for a, e in zip((ends - size)[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())]
    if not wide:
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, cuts)), ">u8").astype(np.uint64)
    a, digest = b"".join(map(xxhash.xxh3_128_digest, cuts)), xxhash.xxh3_128_digest
    b = b"".join([digest(c, 1) for c in cuts])
    return np.concatenate([np.frombuffer(a, np.uint8).reshape(-1, 16), np.frombuffer(b, np.uint8).reshape(-1, 16)], axis=1)


def wide_prints(docs: DataFrame, words: int) -> DataFrame:
    """A 256-bit SimHash of the distinct shingles of each whole text; node numbers equal sets of shingles."""

    def work(batches):
        for b in batches:
            out, node = np.zeros((b.num_rows, WIDE_WORDS), np.uint64), []
            for k, text in enumerate(b.column(2).to_pylist()):
                h = np.unique(shingle_hashes(text, words, True).view("V32").ravel()).view(np.uint8).reshape(-1, 32)
                node.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                ones = np.zeros(64 * WIDE_WORDS, np.int64)
                for lo in range(0, len(h), 1 << 14):
                    ones += np.unpackbits(h[lo : lo + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
                out[k] = np.frombuffer(np.packbits(ones * 2 > len(h)).tobytes(), ">u8")
            cols = {"doc_id": b.column(0), "text_hash": b.column(1), "node": pa.array(np.array(node, np.uint64).view(np.int64))}
            yield pa.RecordBatch.from_pydict(cols | {f"w{i}": pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in range(WIDE_WORDS)})

    return docs.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(work, PRINTS)


def _nearest_tree(x: np.ndarray, probe: np.ndarray, loose: int) -> list[tuple[int, int]]:
    """Edges of a forest of least distances (Prim) over the links of one key; at most one less than rows."""
    filed_at = np.flatnonzero(~probe)
    near = np.zeros(len(x), bool)
    for k in range(0, len(filed_at), 1024):
        some = filed_at[k : k + 1024]
        d = np.bitwise_count(x[some][:, None] ^ x[None, :]) <= loose
        d[np.arange(len(some)), some] = False
        near |= d.any(axis=0)
        near[some] |= d.any(axis=1)
    nodes = np.flatnonzero(near)
    if not len(nodes):
        return []
    y, p = x[nodes], probe[nodes]
    best, parent, out = np.full(len(nodes), 255, np.uint8), np.zeros(len(nodes), np.int64), np.ones(len(nodes), bool)
    edges, u = [], 0
    for _ in range(len(nodes)):
        out[u] = False
        d = np.bitwise_count(y ^ y[u])
        if p[u]:
            d = np.where(p, np.uint8(255), d)
        closer = out & (d < best)
        best[closer], parent[closer] = d[closer], u
        masked = np.where(out, best, np.uint8(255))
        u = int(masked.argmin())
        if not out[u]:
            rest = np.flatnonzero(out)
            if not len(rest):
                break
            u = int(rest[0])
        elif masked[u] <= loose:
            edges.append((int(nodes[parent[u]]), int(nodes[u])))
    return edges


def _all_pairs(x: np.ndarray, probe: np.ndarray, loose: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """All links of one key; None where there are more than ``most``."""
    filed_at, left, right, n = np.flatnonzero(~probe), [], [], 0
    step = max(1, (1 << 20) // len(x))
    for k in range(0, len(filed_at), step):
        some = filed_at[k : k + step]
        i, j = np.nonzero(np.bitwise_count(x[some][:, None] ^ x[None, :]) <= loose)
        ok = probe[j] | (some[i] < j)
        left.append(some[i][ok])
        right.append(j[ok])
        n += len(left[-1])
        if most is not None and n > most:
            return None
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _wide_file(nodes: DataFrame, root: bool) -> DataFrame:
    """Rows of the nodes under each segment and its ball."""
    per_word = 64 // WIDE_SEGMENT

    def file(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            words = [b.column(1 + i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(WIDE_WORDS)]
            roots = b.column(1 + WIDE_WORDS).to_numpy(zero_copy_only=False) if root else None
            for s in range(WIDE_WORDS * per_word):
                w = s // per_word
                who, key, probe = _keys(words[w], s % per_word * WIDE_SEGMENT, WIDE_SEGMENT, 1)
                x = words[(w + 1) % WIDE_WORDS][who].view(np.int64)
                rows = {"k0": pa.array(np.full(len(who), s, np.int64)), "k1": pa.array(key.astype(np.int64)), "node": pa.array(node[who]), "x": pa.array(x), "probe": pa.array(probe)}
                yield pa.RecordBatch.from_pydict(rows | ({"root": pa.array(roots[who])} if root else {}))

    return nodes.select("node", *(f"w{i}" for i in range(WIDE_WORDS)), *(["root"] if root else [])).mapInArrow(file, _WIDE_ROWS + (", root long" if root else ""))


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, k0, k1) of nodes that share a segment up to one bit.

    All pairs of a key within the bound, or where they are many a forest of the
    nearest and one row with the key (k0, k1) and no nodes: ``more_candidates``
    has the rest.
    """
    return _wide_link(_wide_file(nodes, False), False)


def more_candidates(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b) of nodes(..., root) of different roots: all pairs within the bound that share one of the keys."""
    return _wide_link(_wide_file(nodes, True).join(_small(keys), ["k0", "k1"]).select("k0", "k1", "node", "x", "probe", "root"), True)


def _wide_link(rows: DataFrame, root: bool) -> DataFrame:
    def link(batches):
        rest = None

        def edges(cols, new):
            bounds = np.concatenate([[0], new, [len(cols[0])]])
            filed_rows = np.add.reduceat((~cols[4].astype(bool)).astype(np.int64), bounds[:-1])
            a, b, again, have = [], [], [], 0
            for k in np.flatnonzero((np.diff(bounds) > 1) & (filed_rows > 0)):
                lo, hi = bounds[k], bounds[k + 1]
                x, probe, node = cols[3][lo:hi], cols[4][lo:hi], cols[2][lo:hi]
                if root:
                    if (cols[5][lo:hi] == cols[5][lo]).all():
                        continue
                    i, j = _all_pairs(x, probe, WIDE_LOOSE)
                    ok = cols[5][lo:hi][i] != cols[5][lo:hi][j]
                    i, j = i[ok], j[ok]
                else:
                    found = _all_pairs(x, probe, WIDE_LOOSE, WIDE_PAIRS * (hi - lo))
                    if found is None:
                        again.append(lo)
                        tree = np.array(_nearest_tree(x, probe, WIDE_LOOSE), np.int64).reshape(-1, 2)
                        i, j = tree[:, 0], tree[:, 1]
                    else:
                        i, j = found
                a.append(node[i])
                b.append(node[j])
                have += len(i)
                if have > 1 << 20:
                    yield from batch(cols, a, b, again)
                    a, b, again, have = [], [], [], 0
            yield from batch(cols, a, b, again)

        def batch(cols, a, b, again):
            a, b, again = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]), np.array(again, np.int64)
            none = np.zeros(len(a), np.int64)
            key = np.arange(len(a) + len(again)) < len(a)
            left, right = np.concatenate([np.minimum(a, b), again * 0]), np.concatenate([np.maximum(a, b), again * 0])
            k0, k1 = (np.concatenate([none, cols[c][again]]) for c in (0, 1))
            for lo in range(0, len(left), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_pydict({"a": pa.array(left[s], mask=~key[s]), "b": pa.array(right[s], mask=~key[s]), "k0": pa.array(k0[s], mask=key[s]), "k1": pa.array(k1[s], mask=key[s])})

        for batch_ in batches:
            cols = [batch_.column(i).to_numpy(zero_copy_only=False) for i in range(6 if root else 5)]
            cols[3] = cols[3].astype(np.int64).view(np.uint64)
            cols[4] = cols[4].astype(bool)
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield from edges([c[:cut] for c in cols], new[:-1])
        if rest is not None and len(rest[0]):
            yield from edges(rest, np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1)

    dealt = rows.repartition(common.shuffle_partitions(rows.sparkSession), "k0", "k1").sortWithinPartitions("k0", "k1")
    return dealt.mapInArrow(link, "a long, b long, k0 long, k1 long").where("a is null or a <> b").distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, node, root): documents tied by chains of pairs whose shingle sets have that Jaccard similarity, to hundredths.

    Found by the join of ``op12_minhash``: what leaves a tree node are its
    members, verified on the whole shingle sets, never its pairs, so a group of
    texts that lie just under the bound costs no rows for its pairs.  Null texts
    are empty; texts without words are alike.
    """
    from . import op12_minhash as join  # which takes components from here

    prints = common.materialize(join.prints(docs, words), "similar-prints")
    found = join.links(docs, join.nodes_of(prints).drop("least"), words, round(100 * similarity))
    empty = F.lit(0).cast("long")
    return prints.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("node", empty).alias("node"), F.coalesce("root", "node", empty).alias("root"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document (the smallest doc_id, null last) of each group of similar ones; all columns stay."""
    groups = common.materialize(similar_groups(docs, words, similarity), "similar-groups")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(name).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = groups.join(_small(common.materialize(first, "similar-first")), "root").where(name != F.col("first")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_th")).distinct()
    gone = common.materialize(gone, "similar-gone")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    left = docs.join(_small(gone), docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]) & (text_hash == gone["_th"]), "left_anti")
    if not groups.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # rows that repeat id and text
        name = common.fresh(left, "text_hash")
        left = left.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["doc_id", name]).drop(name)
    return left


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document (see near_duplicates for nulls, ties and empty tables)."""
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
