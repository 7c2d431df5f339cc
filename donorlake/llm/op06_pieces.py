"""SentencePiece encoding that keeps byte offsets, and decoding.

The normaliser walks the text by longest prefix through the model's compiled
character map (a double-array trie of byte strings), and notes for every byte it
puts out from which source bytes it came; pieces are spans of normalised bytes,
so each piece projects to a span of the original bytes.  The merges are the
sentencepiece library's own.

Where the model has no character map, trims nothing and has no piece with a
space inside, borders before a run of spaces are never merged over: texts are
then encoded chunk by chunk, each distinct chunk once.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import _INVALID, Pool, column, grouped, loaded

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()


class CharacterMap:
    """A compiled character map: u32 size of the trie, its units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if size else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of text[at:] and what it becomes."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        pos = self._offset(unit)
        for k in range(at, len(text)):
            pos ^= text[k]
            unit = units[pos]
            if unit & 0x800000FF != text[k]:  # label, and not a leaf
                break
            pos ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[pos] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Normalizer:
    """The library's normalisation with the source place of every byte put out."""

    def __init__(self, spec, symbols: list[bytes] = (), suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.symbols, self.suffix = sorted(symbols, key=len, reverse=True), suffix
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = not self.map.units and not self.trim

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What comes out for the source bytes from here, and how many they are; user-defined symbols stay as they are."""
        for symbol in self.symbols:
            if raw.startswith(symbol, at):
                return symbol, len(symbol)
        if hit := self.map.longest(raw, at):
            return hit[1], hit[0]
        b = raw[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return raw[at : at + n], n

    def run(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each (and the end) the source byte it starts from."""
        raw = text.encode()
        space = _SPACE_BYTES if self.escape else b" "
        out, src, at, stop = bytearray(), [], 0, len(raw)
        if self.trim:
            while at < stop:
                piece, n = self._step(raw, at)
                if piece != b" ":
                    break
                at += n
        if at >= stop:
            return b"", [0]

        def put(piece: bytes, where: int):
            own = raw.startswith(piece, where)  # unchanged: each byte is its own source
            for k, byte in enumerate(piece):
                for b in space if byte == 0x20 else bytes([byte]):
                    out.append(b)
                    src.append(where + k if own else where)

        if self.dummy and not self.suffix:
            out += space
            src += [at] * len(space)
        after_space = self.trim
        while at < stop:
            piece, n = self._step(raw, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                put(piece, at)
                after_space = self.trim and piece.endswith(b" ")
            at += n
        if self.trim:
            while out.endswith(space):
                stop = src[len(out) - len(space)]
                del out[-len(space) :], src[-len(space) :]
        if self.dummy and self.suffix:
            out += space
            src += [stop] * len(space)
        return bytes(out), [*src, stop]


class PieceFile(Pool):
    """A sentencepiece model."""

    dtype = np.dtype("<u4")

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.normalizer = Normalizer(proto.normalizer_spec, [p.piece.replace(SPACE, " ").encode() for p in proto.pieces if p.type == 4], suffix)
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        spec = proto.normalizer_spec
        bpe = proto.trainer_spec.model_type == 2
        self.chunked = bpe and self.normalizer.identity and spec.add_dummy_prefix and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and not any(inside.search(p.piece) or p.type == 4 for p in proto.pieces)
        n, sp = self.sp.get_piece_size(), self.sp
        #: Original bytes of each piece where the map is the identity, and pieces that don't tell them.
        self.piece_bytes = np.array([1 if sp.is_byte(i) else len(sp.id_to_piece(i).replace(SPACE, " ").encode()) for i in range(n)], np.int64)
        self.unsure = np.array([sp.is_unknown(i) for i in range(n)])
        self.straight = self.normalizer.identity and spec.add_dummy_prefix and spec.escape_whitespaces and not suffix
        super().__init__()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def cuts(self):
        return [lambda t: pc.split_pattern(t, " ")] if self.chunked else []

    def learn(self, chunks: list[str]) -> None:
        """A chunk is what follows a space; an empty one marks repeated spaces, which merge with each other."""
        good = [c for c in chunks if c and not c.startswith(SPACE) and not c.endswith(SPACE)]
        for c in chunks:
            self.row[c] = _INVALID
        self._add(good, self.whole(good))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the original bytes that each piece comes from.

        Bytes that the map changes belong to the start of what they come from.
        An unknown piece covers the run that the library couldn't spell.
        """
        if self.straight and SPACE not in text and not self.unsure[ids].any():  # the pieces follow each other, behind one added space
            ends = np.cumsum(self.piece_bytes[ids]) - 1
            return np.maximum(0, ends - self.piece_bytes[ids]), np.maximum(0, ends)
        _, src = self.normalizer.run(text)
        if self.unsure[ids].any():
            size = [1 if self.sp.is_byte(p.id) else len(p.piece.encode()) for p in self.sp.encode(text, return_type="proto").pieces]
        else:
            size = [1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in ids.tolist()]
        at, src = np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.array(src, np.int64)
        return src[at[:-1]], src[at[1:]]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encode(docs: DataFrame, model: str, spans: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends): ids of each whole text and every piece's span of original UTF-8 bytes.

    A null or empty text has no ids; null and repeated doc_ids stay rows of
    their own; other columns are ignored.
    """
    common.prepare(docs.sparkSession)

    def work(batches):
        enc: PieceFile = loaded(PieceFile, model)
        for table in grouped(batches, "text"):
            texts = column(table, "text")
            flat, ends = enc.encode(texts)
            rows = np.split(flat, ends[:-1]) if len(ends) else []
            starts, stops = [], []
            for text, ids in zip(texts.to_pylist(), rows):
                found = enc.spans(text, ids) if spans else ([], [])
                starts.append(found[0])
                stops.append(found[1])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(column(table, "doc_id"), pa.int64()), "ids": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(stops, pa.list_(pa.int32()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty())
    return rows.mapInArrow(work, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of ids, of the pieces' spans of original bytes (starts, then ends, as 64-bit integers) and of the decoded text of each document.

    Nulls and ties as in ``encode``; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)

    def work(batches):
        enc: PieceFile = loaded(PieceFile, model)
        for table in grouped(batches, "text"):
            texts = column(table, "text")
            flat, ends = enc.encode(texts)
            n, sha, decoded, spans = [], [], [], []
            for text, ids in zip(texts.to_pylist(), np.split(flat, ends[:-1]) if len(ends) else []):
                ids_list = ids.tolist()
                n.append(len(ids_list))
                sha.append(hashlib.sha256(",".join(map(str, ids_list)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(ids_list).encode() if ids_list else b"").hexdigest())
                starts, stops = enc.spans(text, ids)
                spans.append(zlib.crc32(np.concatenate([starts, stops]).astype("<i8").tobytes()))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(column(table, "doc_id"), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "spans_crc32": pa.array(spans, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty())
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's pieces, their spans and its decoded text (see round_trip for nulls and empty tables)."""
    import public_tokenizers

    return round_trip(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
