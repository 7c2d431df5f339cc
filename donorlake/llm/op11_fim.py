"""Fill-in-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over buffers that
never change: its own UTF-8 text and one buffer for each sentinel.  Cutting
splits a descriptor, an arrangement permutes the parts and puts sentinels
between them, a digest runs over the descriptors without building the text.
To restore, the output is one buffer again: its sentinels are found, the text
between them becomes descriptors, and the inverse permutation puts these in
order.

Units are words with the white space before them; white space at the end is a
unit of its own.  No text is transformed that holds a sentinel, so the first
sentinel behind each start is the written one: a sentinel begins with ``<``,
which no other place of a sentinel holds, so none arises across a border.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Shares in hundredths: documents that are transformed, and those of them with the suffix first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Buffer numbers: the text, then the sentinels.
TEXT = 0
SENTINELS = (b"", PREFIX, SUFFIX, MIDDLE)
#: For each form the parts (0 prefix, 1 middle, 2 suffix) in written order, each behind its sentinel.
ORDER = {"psm": ((1, 0), (2, 2), (3, 1)), "spm": ((2, 2), (1, 0), (3, 1))}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

Descriptor = tuple[int, int, int]


def unit_ends(text: bytes) -> np.ndarray:
    """Byte places where units end, in ascending order."""
    if not text:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text))  # the last word, or white space behind it


def code_points(text) -> int:
    b = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((b & 0xC0) != 0x80))


class PieceTable:
    """Descriptors over the text and the sentinels."""

    def __init__(self, text: bytes):
        self.buffers = [memoryview(text), *map(memoryview, SENTINELS[1:])]
        self.pieces: list[Descriptor] = [(TEXT, 0, len(text))]

    def cut(self, *places: int) -> None:
        """Split descriptors so that a piece begins at each of the places (counted over the pieces, ascending); pieces may be empty."""
        for place in places:
            ahead = 0
            for k in range(len(self.pieces) - 1, -1, -1):  # the last piece that begins at or before the place
                ahead = sum(p[2] for p in self.pieces[:k])
                if ahead <= place:
                    break
            buffer, start, length = self.pieces[k]
            at = place - ahead
            self.pieces[k : k + 1] = [(buffer, start, at), (buffer, start + at, length - at)]

    def arrange(self, order) -> None:
        """Pieces in another order, each behind its sentinel."""
        self.pieces = [d for sentinel, part in order for d in ((sentinel, 0, len(SENTINELS[sentinel])), self.pieces[part])]

    def views(self):
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for v in self.views():
            h.update(v)
        return h.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.views())


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the decimal doc_id (null: none)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(text: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, PieceTable]:
    """Form, number of units, and the arranged table of a text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends, table = unit_ends(text), PieceTable(text)
    n = len(ends)
    if not text or any(s in text for s in SENTINELS[1:]) or h3 % 100 >= rate:
        return "plain", n, table
    form = "spm" if h4 % 100 < spm_rate else "psm"
    table.cut(*(int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))))
    table.arrange(ORDER[form])
    return form, n, table


def restored(output: bytes, form: str) -> PieceTable:
    """The table of the original text, over the output as its buffer."""
    table = PieceTable(output)
    if form == "plain":
        return table
    parts, at, order = {}, 0, ORDER[form]
    for k, (sentinel, part) in enumerate(order):
        start = at + len(SENTINELS[sentinel])
        at = output.index(SENTINELS[order[k + 1][0]], start) if k + 1 < len(order) else len(output)
        parts[part] = (TEXT, start, at - start)
    table.pieces = [parts[k] for k in range(3)]
    return table


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, pieces array<struct<buffer:int,start:long,length:long>>"
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``: its form, lengths, output text, and the descriptors that made it.

    A null text is empty, an empty one stays plain; a null doc_id draws as an
    empty one, rows that repeat a doc_id draw alike; ``prefix_chars`` and
    ``middle_chars`` are null where the text is plain.  Other columns are
    ignored, an empty table gives no rows.  Descriptors count bytes; buffer 0
    is the text, 1 to 3 are the sentinels.  A text is held once in memory with
    its output, whatever its length.
    """
    common.prepare(docs.sparkSession)

    def work(batches):
        for b in batches:
            rows = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces")}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form, n, table = transformed(text, doc_id, seed, rate, spm_rate)
                at = {part: 2 * k + 1 for k, (_, part) in enumerate(ORDER.get(form, ()))}
                views = list(table.views())
                made = (n, form, code_points(views[at[0]]) if at else None, code_points(views[at[1]]) if at else None, table.text(), table.sha256(), [dict(zip(("buffer", "start", "length"), p)) for p in table.pieces])
                for k, v in zip(rows, made):
                    rows[k].append(v)
            kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "pieces": _PIECES}
            cols = {k: pa.array(v, pa.binary()).cast(pa.string()) if k == "output" else pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | cols)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(work, OUT)


def restore(made: DataFrame) -> DataFrame:
    """``made(output, form, ...)`` with the columns ``restored`` and ``restored_sha256``, from output and form alone; its other columns stay, but for clashing names."""
    left = made.drop("restored", "restored_sha256")
    names, at = [*left.columns, "restored", "restored_sha256"], {c: k for k, c in enumerate(left.columns)}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema) + ", restored string, restored_sha256 string"

    def work(batches):
        for b in batches:
            tables = [restored((o or "").encode(), f or "plain") for o, f in zip(b.column(at["output"]).to_pylist(), b.column(at["form"]).to_pylist())]
            more = [pa.array([t.text() for t in tables], pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in tables], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=names)

    return left.mapInArrow(work, schema)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of all documents' outputs, and of the texts restored from these (see fill_in_middle for nulls and repeated rows)."""
    made = fill_in_middle(common.read_table(spark, sf_dir, "documents")).drop("pieces")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The same in SQL, over lists of units.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(k1, k2)], '') AS pre, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS mid, array_to_string(u[greatest(k1, k2) + 1:], '') AS suf FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
