"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens.  In each round (one window of tokens) a
queue's deficit counter grows by its quantum, the window length times its share
of the mixture; while the counter covers a slice the queue sends one, and what
is left stays for the next round.  The slices in their order make one stream,
which is cut into windows.  So each window holds the target proportions up to a
slice of each source, and no token is padded but in the last window.

The counters have a closed form: after round r a queue has sent
``floor((r + 1) * quantum / slice)`` slices (or all it has).  Hence a slice's
place in the stream follows from its place in its queue alone, and deficits
carry across windows and partitions without any pass in order: each partition
of the token table computes the places of its own documents.  A queue that is
exhausted sends no more; the others go on in their proportions.

A place so computed sums over all queues, which suits some hundreds of them.  Of
more, a slice's round still follows from its place in its queue alone; slices
are dealt by ranges of (round, queue, place in it), and running sums over the
ranges are their places in the stream.  The stream is the same.

The last window is cut into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import TokenizerFile, column, grouped, loaded

WINDOW = 2048
#: No slice is shorter, so that small sources send rarely rather than token by token.
LEAST_SLICE = 64
#: Quanta are counted in this fraction of a token.
UNIT = 1 << 16
#: A table of queue bases larger than this (rows) is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000

#: Places are computed against every queue up to so many, and by ranges of the stream beyond.
MANY = 256

STORE = "part int, queue string, doc_id long, at long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
SLICES = "round long, queue string, at long, doc_id long, start long, length long, doc_tokens long, ids binary"
STREAM = "part int, place long, doc_id long, start long, length long, doc_tokens long, queue string, ids binary"


class Windows:
    """Where a stream of so many tokens is cut: windows, and powers of two in what is left."""

    def __init__(self, total: int, window: int = WINDOW):
        full, tail = divmod(total, window)
        ends = [1 << b for b in reversed(range(window.bit_length())) if tail >> b & 1]
        self.window, self.full, self.tail_at = window, full, full * window
        self.tail_starts = self.tail_at + np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)

    def cut(self, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts runs of the stream: run number, place, length, sequence and offset of each piece."""
        run, p, size = _starts(place, size, np.full(len(place), self.window, np.int64))
        if (tail := p >= self.tail_at).any():  # the last window falls into powers of two
            parts = [(run[~tail], p[~tail], size[~tail])]
            for d, y, z in zip(run[tail], p[tail], size[tail]):
                cuts = [c for c in self.tail_starts.tolist() if y < c < y + z]
                parts += [([d], [a], [e - a]) for a, e in zip([y, *cuts], [*cuts, y + z])]
            run, p, size = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        last = np.searchsorted(self.tail_starts, p, "right") - 1
        inside = p < self.tail_at
        sequence = np.where(inside, p // self.window, self.full + last)
        offset = np.where(inside, p % self.window, p - self.tail_starts[np.maximum(last, 0)])
        return run, p, size, sequence, offset


class Quanta:
    """What a queue gets in each round, in fractions of a token: its share of the tokens, or of the weights."""

    def __init__(self, total: int, window: int = WINDOW, weights: dict | None = None, absent: int = 0):
        """``weights`` are those of queues that exist; ``absent`` more queues have weight 1."""
        self.total, self.window, self.weights = total, window, weights
        if weights is not None:
            if not all(math.isfinite(w) and w > 0 for w in weights.values()):
                raise ValueError("weights are finite and above 0")
            self.most = max([*weights.values(), *([1.0] if absent else [])], default=1.0)
            self.whole = float(sum((Fraction(w / self.most) for w in weights.values()), Fraction(1.0 / self.most) * absent))

    def of(self, queue, tokens: int) -> int:
        if self.weights is None:
            return max(1, self.window * UNIT * tokens // max(1, self.total))
        return max(1, int(self.window * UNIT * (self.weights.get(queue, 1) / self.most / self.whole)))


class Plan:
    """The round-robin's closed form for given token counts of the queues."""

    def __init__(self, tokens: list[int], weights: list[float] | None = None, window: int = WINDOW, least: int = LEAST_SLICE):
        self.windows = Windows(sum(tokens), window)
        self.tokens = np.array(tokens, np.int64)
        quanta = Quanta(sum(tokens), window, None if weights is None else dict(enumerate(weights)))
        self.quantum = np.array([quanta.of(q, t) for q, t in enumerate(tokens)], np.int64)
        self.slice = _slices(self.quantum, window, least)
        #: A slice's price in fractions of a token; rounds until a queue is empty (beyond, counters don't grow).
        self.price = self.slice * UNIT
        self.finish = np.array([_finish(*x) for x in zip(tokens, self.slice.tolist(), self.quantum.tolist())], np.int64)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (columns) has sent after so many rounds (rows)."""
        whole, part = np.divmod(np.minimum(rounds[:, None], self.finish), self.price)  # apart, so that no product leaves 64 bits
        slices = whole * self.quantum + part * self.quantum // self.price
        return np.minimum(slices * self.slice, self.tokens)

    def places(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place in the stream of the slices that start at these places of their queues."""
        out = np.empty(len(at), np.int64)
        step = max(1, 2_000_000 // max(1, len(self.tokens)))
        for lo in range(0, len(at), step):
            q, a = queue[lo : lo + step], at[lo : lo + step]
            rounds = _round(a // self.slice[q], self.slice[q], self.quantum[q])
            before = self.sent(rounds)
            here = self.sent(rounds + 1) - before
            prior = np.cumsum(here, axis=1) - here
            i = np.arange(len(q))
            out[lo : lo + step] = before.sum(axis=1) + prior[i, q] + a - before[i, q]
        return out


def _slices(quantum: np.ndarray, window: int, least: int) -> np.ndarray:
    return np.clip(quantum // UNIT, least, window)


def _finish(tokens: int, size: int, quantum: int) -> int:
    """Rounds until a queue is empty; an error beyond what is counted in 64 bits."""
    rounds = -(-(-(-tokens // size) * size * UNIT) // quantum)
    if rounds >= 1 << 62:
        raise ValueError("a source's share is too small for its tokens")
    return rounds


def _round(k: np.ndarray, size: np.ndarray, quantum: np.ndarray) -> np.ndarray:
    """The round in which a queue sends its k-th slice; the last may be short and is sent with the deficit of a full one."""
    whole, part = np.divmod(k + 1, quantum)  # apart, so that no product leaves 64 bits
    return whole * size * UNIT - (-(part * size * UNIT) // quantum) - 1


def _starts(at: np.ndarray, n: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs [at, at + n) at the multiples of step: run number, start, length of each piece."""
    first, last = at // step, (at + n - 1) // step
    count = np.where(n > 0, last - first + 1, 0)
    run = np.repeat(np.arange(len(at)), count)
    k = np.repeat(first, count) + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.maximum(at[run], k * step[run])
    hi = np.minimum((at + n)[run], (k + 1) * step[run])
    return run, lo, hi - lo


def _width(enc: TokenizerFile, end_id: int | None) -> int:
    """Bytes of a stored id."""
    return 2 if max(enc.bits, (end_id or 0).bit_length()) <= 16 else 4


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text, source)`` once into a table of ids; ``at`` counts within the partition's part of a queue."""
    spark = docs.sparkSession
    common.prepare(spark)

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc: TokenizerFile = loaded(TokenizerFile, tokenizer, special_as_text)
        sent: dict[str | None, int] = {}
        kind = np.dtype(f"<u{_width(enc, end_id)}")
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        width = kind.itemsize
        for table in grouped(batches, "text"):
            ids, ends = enc.encode(column(table, "text"))
            raw = ids.astype(kind, copy=False).tobytes()
            queues, names = column(table, "queue").to_pylist(), column(table, "doc_id").to_pylist()
            lo, rows, at, n = 0, [], [], []
            for hi, q in zip(ends.tolist(), queues):
                row = raw[lo * width : hi * width] + end
                lo = hi
                rows.append(row)
                at.append(sent.get(q, 0))
                n.append(len(row) // width)
                sent[q] = at[-1] + n[-1]
            for k in range(0, len(rows), 2048):
                s = slice(k, k + 2048)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(rows[s]), pa.int32()), "queue": pa.array(queues[s], pa.string()), "doc_id": pa.array(names[s], pa.int64()), "at": at[s], "n": n[s], "ids": pa.array(rows[s], pa.binary())})

    return common.materialize(docs.select("doc_id", "queue", "text").mapInArrow(encode, STORE), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 1, window: int = WINDOW, weights: dict | None = None, special_as_text: bool = False, many: int = MANY) -> DataFrame:
    """Pieces of packed sequences of ``docs(doc_id, text, source)``.

    A null text is empty; with an end id it still has that one token, without it
    has none and no piece.  Rows with the same doc_id are packed one by one.
    Null doc_ids are kept.  ``weights`` by source gives another mixture than the
    corpus' own (sources it lacks get weight 1; a weight that isn't finite and
    above 0 is an error).  Each source is a queue, a null one too; queues take
    turns in the order of their names, null first.  Other columns are ignored;
    an empty table gives no pieces.  Strings of special tokens in a text become
    these tokens, unless ``special_as_text``.  More than ``many`` sources are
    packed by ranges of the stream, with the same result and one more shuffle of
    the ids; the driver never holds more than so many.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("queue"), common.text_or_empty())
    store = store_tokens(rows, tokenizer, end_id, special_as_text)
    sums = common.materialize(store.groupBy("part", "queue").agg(F.sum("n").alias("n")), "packing-sums")
    bases = sums.select("part", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    totals = sums.groupBy("queue").agg(F.sum("n").alias("tokens"))
    width = _width(loaded(TokenizerFile, tokenizer, special_as_text), end_id)
    counts = dict(totals.limit(many + 1).collect())
    if len(counts) > many:
        return _by_ranges(spark, store, bases, totals, window, weights, width)
    names = sorted(counts, key=lambda x: (x is not None, x or ""))
    number = {q: i for i, q in enumerate(names)}
    plan = Plan([counts[q] for q in names], [weights.get(q, 1) for q in names] if weights and names else None, window)

    def cut(batches):
        for b in batches:
            at, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            queue = np.array([number[q] for q in b.column(1).to_pylist()], np.int64)
            doc, lo, size = _starts(at, n, plan.slice[queue])
            whole = lo // plan.slice[queue[doc]] * plan.slice[queue[doc]]
            place = plan.places(queue[doc], whole) + lo - whole
            run, p, size, sequence, offset = plan.windows.cut(place, size)
            doc, first = doc[run], lo[run] + p - place[run] - at[doc[run]]
            yield from _pieces(b.column(0), b.column(1), n, b.column(4), width, doc, first, size, first, sequence, offset)

    return _placed(store, bases, sums).mapInArrow(cut, PIECES)


def _placed(store: DataFrame, bases: DataFrame, sums: DataFrame, *more: str) -> DataFrame:
    """Documents with their places in their queues."""
    if sums.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    named = bases.withColumnsRenamed({"part": "_part", "queue": "_queue"})
    on = (F.col("part") == F.col("_part")) & F.col("queue").eqNullSafe(F.col("_queue"))
    return store.join(named, on).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids", *more)


def _pieces(doc_ids, queues, tokens, ids, width, doc, inside, size, start, sequence, offset):
    """Batches of pieces: ``inside`` is a piece's first id in its row's ids, ``start`` in its document."""
    raw = [memoryview(np.frombuffer(x, f"<u{width}").astype("<u4")).cast("B") for x in ids.to_pylist()]
    crc = [zlib.crc32(raw[d][4 * a : 4 * (a + s)]) for d, a, s in zip(doc.tolist(), inside.tolist(), size.tolist())]
    for k in range(0, len(doc), 20_000):
        s = slice(k, k + 20_000)
        row = pa.array(doc[s])
        yield pa.RecordBatch.from_pydict({"doc_id": doc_ids.take(row), "start": start[s], "length": size[s], "ids_crc32": pa.array(crc[s], pa.int64()), "doc_tokens": tokens[doc[s]], "sequence_id": sequence[s], "offset": offset[s], "queue": queues.take(row).cast(pa.string())})


def _by_ranges(spark: SparkSession, store: DataFrame, bases: DataFrame, totals: DataFrame, window: int, weights: dict | None, width: int) -> DataFrame:
    """The same stream for any number of queues: slices in ranges of (round, queue, place), places by running sums over the ranges."""
    total, n_queues = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    known = None
    if weights:
        given = spark.createDataFrame([(q,) for q in weights], "_queue string")
        known = {r[0]: weights[r[0]] for r in totals.join(F.broadcast(given), F.col("queue").eqNullSafe(F.col("_queue"))).select("queue").collect()}  # no more than there are weights
    quanta = Quanta(total, window, known, n_queues - len(known or ()))

    def rates(batches):
        for b in batches:
            queues, tokens = b.column(0).to_pylist(), b.column(1).to_pylist()
            quantum = [quanta.of(q, t) for q, t in zip(queues, tokens)]
            size = _slices(np.array(quantum, np.int64), window, LEAST_SLICE)
            for t, z, q in zip(tokens, size.tolist(), quantum):
                _finish(t, z, q)
            yield pa.RecordBatch.from_pydict({"_name": pa.array(queues, pa.string()), "quantum": pa.array(quantum, pa.int64()), "size": size})

    rated = totals.mapInArrow(rates, "_name string, quantum long, size long")
    sums = common.materialize(bases.join(rated, F.col("queue").eqNullSafe(F.col("_name"))).drop("_name"), "packing-rates")

    def slices(batches):
        for b in batches:
            at, n, quantum, size = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 5, 6))
            doc, lo, length = _starts(at, n, size)
            rounds, first = _round(lo // size[doc], size[doc], quantum[doc]), lo - at[doc]
            raw = b.column(4).to_pylist()
            for k in range(0, len(doc), 2048):
                s = slice(k, k + 2048)
                row = pa.array(doc[s])
                cut = [raw[d][width * f : width * (f + z)] for d, f, z in zip(doc[s].tolist(), first[s].tolist(), length[s].tolist())]
                yield pa.RecordBatch.from_pydict({"round": rounds[s], "queue": b.column(1).take(row).cast(pa.string()), "at": lo[s], "doc_id": b.column(0).take(row), "start": first[s], "length": length[s], "doc_tokens": n[doc[s]], "ids": pa.array(cut, pa.binary())})

    def numbered(batches):
        from pyspark import TaskContext

        part, sent = TaskContext.get().partitionId(), 0
        for b in batches:
            length = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            place = sent + np.cumsum(length) - length
            sent += int(length.sum())
            yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), pa.array(place), *b.columns], names=["part", "place", *b.schema.names])

    order = ["round", "queue", "at"]
    dealt = _placed(store, sums, sums, "quantum", "size").mapInArrow(slices, SLICES).repartitionByRange(*order).sortWithinPartitions(*order)
    stream = common.materialize(dealt.select("doc_id", "start", "length", "doc_tokens", "queue", "ids").mapInArrow(numbered, STREAM), "packing-stream")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = stream.groupBy("part").agg(F.sum("length").alias("_n")).select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    placed = stream.join(F.broadcast(ranges), "part").select("doc_id", "queue", "start", "doc_tokens", "ids", (F.col("_base") + F.col("place")).alias("place"), "length")
    windows = Windows(total, window)

    def cut(batches):
        for b in batches:
            start, tokens, place, length = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 5, 6))
            run, p, size, sequence, offset = windows.cut(place, length)
            inside = p - place[run]
            yield from _pieces(b.column(0), b.column(1), tokens, b.column(4), width, run, inside, size, start[run] + inside, sequence, offset)

    return placed.mapInArrow(cut, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences, in the corpus' own mixture (see pack for nulls, ties and empty tables)."""
    import public_tokenizers

    return pack(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("queue")
