"""Line dedup over range-partitioned hashes; returns compressed keep bitmaps.

Each line becomes a 128-bit hash of its key with its document and position.  The
rows are dealt by ranges of (hash, document) and sorted by (hash, document,
position), so a hash that a third of all documents share is spread over many
partitions and yet each partition streams runs of equal hashes.  A run that
reaches the document threshold is decided on the spot.  Only a partition's first
and last run can go on in a neighbour: of these one row with the count leaves
the task, and their undecided lines (fewer than the threshold's documents);
counts, at most two per partition, are joined to them afterwards.

The result is a bitmap of kept lines for each document that loses a line (zlib
over packed bits); texts move only where they are put together again.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What is stripped from both ends of a line (fixed values).
BLANK = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_LENGTH = 1

LINES = "h0 long, h1 long, doc_id long, text_hash long, pos int"
EVENTS = "kind int, part int, h0 long, h1 long, doc_id long, text_hash long, pos int, n long"
_DROP, _OPEN, _FIRST, _COUNT = 0, 1, 2, 3


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(BLANK).lower() for x in text.split(b"\n")]  # bytes.lower() changes A-Z only


def hashed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    def explode(batches):
        for b in batches:
            h0, h1, ids, hashes, pos = [], [], [], [], []
            for doc, th, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, key in enumerate(line_keys(text)):
                    if len(key) >= min_length and (min_length <= 1 or len(key.decode()) >= min_length):
                        d = xxhash.xxh3_128_digest(key)
                        h0.append(int.from_bytes(d[:8], "big", signed=True))
                        h1.append(int.from_bytes(d[8:], "big", signed=True))
                        ids.append(doc)
                        hashes.append(th)
                        pos.append(k)
            yield pa.RecordBatch.from_pydict({"h0": pa.array(h0, pa.int64()), "h1": pa.array(h1, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "text_hash": pa.array(hashes, pa.int64()), "pos": pa.array(pos, pa.int32())})

    return docs.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(explode, LINES)


def _stream(min_docs: int, keep_first: bool):
    """Task function over sorted lines: decides runs, hands on the runs at both ends."""

    def run_rows(kind, part, key, rows, n=0):
        return [(kind, part, key[0], key[1], d, t, p, n) for d, t, p in rows]

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        key = last_doc = None
        held: list[tuple] = []  # lines of a run that hasn't reached the threshold
        n, first, decided = 0, True, False

        def close(edge: bool):
            if key is None or not edge:
                return
            out.append((_COUNT, part, key[0], key[1], None, None, 0, n))
            if not decided:
                out.extend(run_rows(_OPEN, part, key, held))

        def flush():
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("kind", "part", "h0", "h1", "doc_id", "text_hash", "pos", "n")
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=list(names))

        for b in batches:
            for h0, h1, doc, th, pos in zip(*(c.to_pylist() for c in b.columns)):
                if (h0, h1) != key:
                    close(first)
                    first = key is None
                    key, n, held, decided, last_doc = (h0, h1), 0, [], False, ()
                if doc != last_doc:
                    n, last_doc = n + 1, doc
                if decided:
                    out.append((_DROP, part, h0, h1, doc, th, pos, 0))
                    continue
                held.append((doc, th, pos))
                if n >= min_docs:
                    decided = True
                    if keep_first:  # whether the run's first line is the first of all is open where a neighbour may have it
                        out.extend(run_rows(_FIRST, part, key, held[:1]))
                        out.extend(run_rows(_DROP, part, key, held[1:]))
                    else:
                        out.extend(run_rows(_DROP, part, key, held))
                    held = []
            if len(out) > 20_000:
                yield flush()
        close(True)
        yield flush()

    return work


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines to drop, from hashed lines."""
    spark = lines.sparkSession
    dealt = lines.repartitionByRange(common.shuffle_partitions(spark), "h0", "h1", "doc_id").sortWithinPartitions("h0", "h1", "doc_id", "text_hash", "pos")
    events = common.materialize(dealt.mapInArrow(_stream(min_docs, keep_first), EVENTS), "line-events")
    counts = events.where(F.col("kind") == _COUNT).groupBy("h0", "h1").agg(F.sum("n").alias("total"), F.min("part").alias("lead"))
    where = ["doc_id", "text_hash", "pos"]
    sure = events.where(F.col("kind") == _DROP).select(where)
    open_lines = events.where(F.col("kind") == _OPEN).join(F.broadcast(counts), ["h0", "h1"])  # at most two rows per partition
    if keep_first:
        rank = F.min(F.struct("part", F.col("doc_id").isNotNull(), "doc_id", "text_hash", "pos"))
        # the first line of all: in the lead partition, the least of its open lines
        lead = open_lines.where(F.col("part") == F.col("lead")).groupBy("h0", "h1").agg(rank.alias("r")).select("h0", "h1", F.col("r.doc_id").alias("f_doc"), F.col("r.text_hash").alias("f_th"), F.col("r.pos").alias("f_pos"), F.lit(True).alias("has_first"))
        joined = open_lines.where(F.col("total") >= min_docs).join(F.broadcast(lead), ["h0", "h1"], "left")
        is_first = F.coalesce(F.col("has_first") & F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("text_hash") == F.col("f_th")) & (F.col("pos") == F.col("f_pos")), F.lit(False))
        open_drop = joined.where(~is_first).select(where)
        firsts = events.where(F.col("kind") == _FIRST).join(F.broadcast(counts), ["h0", "h1"], "left")
        first_drop = firsts.where(F.col("lead").isNotNull() & (F.col("lead") < F.col("part"))).select(where)
        return sure.unionByName(open_drop).unionByName(first_drop)
    return sure.unionByName(open_lines.where(F.col("total") >= min_docs).select(where))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap): a bit per line up to the last dropped one, 1 where it stays; lines beyond stay.

    Documents that lose nothing have no row.  Rows of the same doc_id count as
    one document, a null doc_id as a document of its own; equal rows share a
    bitmap.  A null or empty text has one empty line, whose key is below any
    ``min_length`` of 1 or more and so stays.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty()).withColumn("text_hash", F.xxhash64("text"))
    gone = dropped_lines(hashed_lines(rows, min_length), min_docs, keep_first)
    by_doc = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))

    def bits(batches):
        for b in batches:
            maps, n = [], []
            for gone_here in b.column(2).to_pylist():
                keep = np.ones(-(-(max(gone_here) + 1) // 8) * 8, bool)
                keep[gone_here] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
                n.append(len(gone_here))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text_hash": b.column(1), "n_dropped": pa.array(n, pa.int64()), "bitmap": pa.array(maps, pa.binary())})

    return by_doc.mapInArrow(bits, "doc_id long, text_hash long, n_dropped long, bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """Kept lines joined, number of lines, number of dropped lines."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)].tolist()
    left = [x for x, k in zip(lines, keep) if k] + lines[len(keep) :]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with their bitmap (null: nothing is dropped) as a last column, and its name."""
    name = common.fresh(docs, "bitmap")
    maps = bitmaps.select(F.col("doc_id").alias("map_doc"), F.col("text_hash").alias("map_hash"), F.col("bitmap").alias("map_bits"))
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    both = docs.join(maps, docs["doc_id"].cast("long").eqNullSafe(maps["map_doc"]) & (text_hash == maps["map_hash"]), "left")
    return both.select(*(docs[c] for c in docs.columns), maps["map_bits"].alias(name)), name


def without_repeats(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """``docs`` with the texts' kept lines (and n_chars of them); all other columns and rows stay."""
    both, _ = with_bitmaps(docs, common.materialize(keep_bitmaps(docs, min_docs, MIN_LENGTH, keep_first), "keep-bitmaps"))
    at, names = docs.columns.index("text"), docs.columns

    def work(batches):
        for b in batches:
            texts, cols = b.column(at).to_pylist(), list(b.columns[:-1])
            maps = b.column(len(names)).to_pylist()
            left = [t if t is None or m is None else kept_text(t.encode(), m)[0].decode() for t, m in zip(texts, maps)]
            cols[at] = pa.array(left, cols[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = b.column(k).to_pylist()
                cols[k] = pa.array([n if m is None else len(t or "") for n, t, m in zip(old, left, maps)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(work, docs.schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, dropped lines and digest of what stays (see keep_bitmaps for nulls, ties and empty tables)."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = common.materialize(keep_bitmaps(docs), "keep-bitmaps")
    both, name = with_bitmaps(docs, bitmaps)
    both = both.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), name)

    def digest(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for text, bitmap in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                left, lines, dropped = kept_text(text, bitmap)
                n.append(lines)
                gone.append(dropped)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return both.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
