"""Token ids in wavelet-matrix files: succinct bit planes with rank and select.

A shard holds the ids of a run of documents in ascending ``doc_id`` order.  Level
0 takes every id's highest bit; before each further level the ids are parted,
those with a 0 in front, in their order.  A level's bits are stored in blocks of
64 Ki bits, each compressed by itself; the head keeps every block's place and
the ones before it, so reading a token, counting a token or finding its n-th
occurrence touches one block (counts: two) of each level.

Layout: ``DLWM`` | version u32 | head length u32 | head (zstd, JSON) | blocks.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import TokenizerFile, column, grouped, loaded

MAGIC, VERSION = b"DLWM", 1
BLOCK_BITS = 1 << 16
#: Ids of a shard at which it is closed (a single longer document makes a longer shard).
SHARD_TOKENS = 2_000_000



def build(ids: np.ndarray, bits: int, doc_ids: list, ends: np.ndarray) -> list[bytes]:
    """The parts of a shard file."""
    z, a = zstandard.ZstdCompressor(level=1), np.ascontiguousarray(ids)
    levels, blocks, at = [], [], 0
    for level in range(bits):
        ones = (a >> np.array(bits - 1 - level, a.dtype)) & np.array(1, a.dtype)
        ones = ones.astype(bool)
        plane = np.packbits(ones)
        step = BLOCK_BITS // 8
        sizes, before, total = [], [], 0
        counts = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), step)) if len(plane) else []
        for k, n in zip(range(0, len(plane), step), counts):
            packed = z.compress(plane[k : k + step].tobytes())
            blocks.append(packed)
            sizes.append(len(packed))
            before.append(total)
            total += int(n)
        levels.append({"at": at, "sizes": sizes, "ones": before, "total": total})
        at += sum(sizes)
        a = np.concatenate([a[~ones], a[ones]])
    known = [x is not None for x in doc_ids]
    side = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.packbits(known).tobytes() + ends.astype("<i8").tobytes()
    side = zstandard.ZstdCompressor(level=3).compress(side)
    head = json.dumps({"bits": bits, "n": len(ids), "docs": len(doc_ids), "levels": levels, "side": [at, len(side)]}).encode()
    head = zstandard.ZstdCompressor(level=3).compress(head)
    return [MAGIC + struct.pack("<II", VERSION, len(head)), head, *blocks, side]


class Shard:
    """Reads a shard by ranges; only the head is held."""

    def __init__(self, uri: str):
        fs, path = common.open_fs(uri)
        self.file = fs.open_input_file(path)
        raw = self.file.read_at(12, 0)
        if raw[:4] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        _, n = struct.unpack("<II", raw[4:])
        self.head = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(n, 12)))
        self.base, self.bits, self.n = 12 + n, self.head["bits"], self.head["n"]
        for x in self.head["levels"]:
            x["where"] = np.concatenate([[0], np.cumsum(x["sizes"])]).astype(np.int64) + x["at"] + self.base
        self.zeros = [self.n - x["total"] for x in self.head["levels"]]

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids of the documents (None where null) and the end of each one's tokens."""
        at, n = self.head["side"]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, self.base + at))
        d = self.head["docs"]
        ids, mask = np.frombuffer(raw, "<i8", d), np.frombuffer(raw, "u1", -(-d // 8), 8 * d)
        known = np.unpackbits(mask, count=d).astype(bool)
        return [int(x) if k else None for x, k in zip(ids, known)], np.frombuffer(raw, "<i8", d, 8 * d + len(mask))

    def _block(self, level: int, k: int) -> np.ndarray:
        where = self.head["levels"][level]["where"]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(where[k + 1] - where[k]), int(where[k])))
        return np.frombuffer(raw, np.uint8)

    def _bit_rank(self, level: int, i: int) -> tuple[int, int]:
        """Bit i of a level and the ones before it."""
        if i >= self.n:
            return 0, self.head["levels"][level]["total"]
        k, r = divmod(i, BLOCK_BITS)
        block = self._block(level, k)
        ones = self.head["levels"][level]["ones"][k] + int(np.bitwise_count(block[: r // 8]).sum())
        last = int(block[r // 8])
        return last >> (7 - r % 8) & 1, ones + (last >> (8 - r % 8)).bit_count()

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit, ones = self._bit_rank(level, i)
            token, i = token << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._bit_rank(level, lo)[1], self._bit_rank(level, hi)[1]
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token among positions lo to hi (rank)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a level."""
        x = self.head["levels"][level]
        starts = np.arange(len(x["ones"]), dtype=np.int64) * BLOCK_BITS
        before = np.array(x["ones"], np.int64) if bit else starts - np.array(x["ones"], np.int64)
        b = int(np.searchsorted(before, k, "right")) - 1
        found = np.flatnonzero(np.unpackbits(self._block(level, b)) == bit)
        return b * BLOCK_BITS + int(found[k - before[b]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        lo, hi = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def all(self) -> np.ndarray:
        """All tokens, by undoing the partings from the last level to the first."""
        dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        raw = self.file.read_at(self.head["side"][0], self.base)
        z, order = zstandard.ZstdDecompressor(), np.zeros(self.n, dtype)
        for level in reversed(range(self.bits)):
            x, at = self.head["levels"][level], 0
            at, plane = x["at"], []
            for size in x["sizes"]:
                plane.append(z.decompress(raw[at : at + size]))
                at += size
            ones = np.unpackbits(np.frombuffer(b"".join(plane), np.uint8), count=self.n).astype(bool)
            out = np.empty_like(order)
            out[~ones] = order[: self.zeros[level]]
            out[ones] = order[self.zeros[level] :] | np.array(1 << (self.bits - 1 - level), dtype)
            order = out
        return order


MANIFEST = "part int, file string, start_in_part long, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None, out: str, shard_tokens: int = SHARD_TOKENS, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards below ``out``; returns the manifest, a row per shard.

    Documents are dealt by ranges of doc_id, so shards in the order of their
    names hold them in ascending order; null ids come first, rows with the same
    id follow each other by text.  A null text is empty and has only the end id;
    columns besides the two are ignored; an empty table gives an empty manifest.
    Strings of special tokens in a text become these tokens, unless
    ``special_as_text``.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc: TokenizerFile = loaded(TokenizerFile, tokenizer, special_as_text)
        bits = max(enc.bits, (end_id or 0).bit_length())
        kind = np.dtype("<u2" if bits <= 16 else "<u4")
        held, names, sizes, n, before, shard = [], [], [], 0, 0, 0

        def close():
            ids = np.concatenate(held) if held else np.empty(0, kind)
            name = f"{out}/part-{part:06d}-{shard:06d}.dlwm"
            common.write_file(name, build(ids, bits, names, np.cumsum(sizes)))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "start_in_part": [before], "n_docs": [len(names)], "n_tokens": [len(ids)]})

        for table in grouped(batches, "text"):
            ids, ends = enc.encode(column(table, "text"))
            docs_here = column(table, "doc_id").to_pylist()
            at = 0
            for doc, end in zip(docs_here, ends.tolist()):
                held.append(ids[at:end].astype(kind, copy=False))
                size = end - at
                if end_id is not None:
                    held.append(np.array([end_id], kind))
                    size += 1
                names.append(doc)
                sizes.append(size)
                n, at = n + size, end
                if n >= shard_tokens:
                    yield close()
                    held, names, sizes, n, before, shard = [], [], [], 0, before + n, shard + 1
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty())
    dealt = rows.repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.materialize(dealt.mapInArrow(encode, MANIFEST), "wavelet-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """A row per document, read from the shard files: place among all ids, number of ids, checksum of the ids as 32-bit integers.

    Only one number per partition (its ids) is summed up in one place.
    """
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", "n")
    bases, total = [], 0
    for part, n in sorted(parts.collect()):  # as many rows as the write had partitions
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")
    files = manifest.join(F.broadcast(base), "part").select((F.col("base") + F.col("start_in_part")).alias("start"), "file")

    def read(batches):
        for b in batches:
            for start, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(name)
                docs, ends = shard.documents()
                ids = shard.all().astype("<u4")
                raw, firsts = memoryview(ids).cast("B"), np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(firsts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(start + firsts), "n_tokens": pa.array((ends - firsts).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()), "file": [name] * len(docs)})

    return files.repartition(common.shuffle_partitions(spark), "file").mapInArrow(read, ROWS)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum among the ids of all documents, read back from wavelet-matrix files (see write_shards for nulls, ties and empty tables)."""
    import public_tokenizers

    out = common.shared_dir(spark, "wavelet")
    manifest = write_shards(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, out)
    return read_documents(manifest).drop("file")
