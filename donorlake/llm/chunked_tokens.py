"""Exact whole-text encoding by a tokenizer library, one distinct chunk at a time.

BPE never merges across a pre-token border, and single spaces, single newlines
and a point or comma between a letter and white space always are such borders.
Texts are cut there, a batch's chunks are numbered by Arrow's dictionary
encoding, each distinct chunk is encoded once by the library and remembered,
and a text's ids are its chunks' ids in a row.  A chunk of letters is one
pre-token, so the library's model encodes it without the stages before it.
Texts with chunks whose borders aren't certain are cut at spaces and newlines
only; if that isn't certain either (repeated or unusual white space), the text
is encoded whole, as are all texts of tokenizers of another make.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Chunks that are remembered before all are forgotten: bounds a worker's memory.
MAX_CHUNKS = 300_000
#: Text encoded at once.
GROUP_BYTES = 4 << 20
_LETTERS_BELOW = "Ā"
_NO_APOSTROPHE = frozenset('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
_INVALID = -1


def loaded(kind: type, path: str, *options) -> "Pool":
    """One encoder for each worker process, file and options, kept between tasks."""
    return common.kept((kind.__name__, path, *options), lambda: kind(path, *options))


def grouped(batches, column: str, limit: int = GROUP_BYTES):
    """Arrow batches gathered until their text has about `limit` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(b.schema.get_field_index(column)).nbytes
        if n >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after another."""
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


def byte_letters() -> list[str]:
    """The printable letter by which byte-level BPE writes each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Pool:
    """Remembers the ids of chunks in one growing array."""

    dtype = np.dtype("<u4")
    #: Texts with these are encoded whole.
    odd = "[\\x00-\\x04]"

    def __init__(self):
        self._forget()

    def _forget(self):
        self.row: dict[str, int] = {}
        self.ids = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.start, self.size = array("q"), array("q")

    def _add(self, chunks: list[str], ids: list[list[int]]) -> None:
        flat = np.fromiter(chain.from_iterable(ids), self.dtype)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(flat)), self.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        for c, x in zip(chunks, ids):
            self.row[c] = len(self.start)
            self.start.append(self.used)
            self.size.append(len(x))
            self.used += len(x)

    def learn(self, chunks: list[str]) -> None:
        """Remember each chunk by _add, or as _INVALID in self.row."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def cuts(self, texts: pa.Array) -> list:
        """Functions from texts to a list array of chunks, the fastest first."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the end of each text's; texts hold no null."""
        if len(self.row) > MAX_CHUNKS:
            self._forget()
        parts: list = [None] * len(texts)
        marked = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        left, odd = np.flatnonzero(~marked), np.flatnonzero(marked)
        for cut in self.cuts():
            if not len(left):
                break
            some = texts if len(left) == len(texts) else texts.take(pa.array(left))
            lists = cut(some)
            ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            codes = lists.flatten().dictionary_encode()
            words = codes.dictionary.to_pylist()
            rows = list(map(self.row.get, words))
            if None in rows:
                self.learn([w for w, r in zip(words, rows) if r is None])
                rows = list(map(self.row.__getitem__, words))
            rows = np.array(rows, np.int64)[codes.indices.to_numpy(zero_copy_only=False)] if words else np.empty(0, np.int64)
            bad = np.add.reduceat(np.append(rows == _INVALID, False).astype(np.int64), ends[:-1]) if len(some) else np.empty(0)
            bad = (bad > 0) & (np.diff(ends) > 0)
            sizes = np.append(np.frombuffer(self.size, np.int64), 0)[rows]
            total = np.concatenate([[0], np.cumsum(sizes)])
            flat = self.ids[ragged(np.append(np.frombuffer(self.start, np.int64), 0)[rows], sizes)]
            if len(some) == len(texts) and not bad.any():
                return flat, total[ends[1:]]
            lo, hi = total[ends[:-1]], total[ends[1:]]
            for k in np.flatnonzero(~bad):
                parts[left[k]] = flat[lo[k] : hi[k]]
            left = left[bad]
        left = np.concatenate([left, odd])
        if len(left):
            for k, ids in zip(left, self.whole(texts.take(pa.array(left)).to_pylist())):
                parts[k] = np.array(ids, self.dtype)
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return (np.concatenate(parts) if parts else np.empty(0, self.dtype)), ends


class TokenizerFile(Pool):
    """A tokenizer of the tokenizers library, with no special tokens added.

    The strings of special tokens inside a text become these tokens, as in the
    library's plain call; ``special_as_text`` makes them ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.model = self.tok.model
        self.bits = max(1, (self.tok.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        added = [t["content"] for t in spec.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        if added:  # letters of either case, as the tokenizer may lower them first
            self.odd = "|".join([Pool.odd, *("(?i:" + re.escape(t) + ")" for t in added)])
        self.kind = "whole"
        if spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
                self.kind = "attached"  # a space belongs to the word behind it
            elif [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                split = pre["pretokenizers"][0]
                if split["behavior"] == "Removed" and split["invert"] and r"[^\\s\\p{L}\\p{N}]+" in str(split["pattern"]):
                    self.kind = "dropped"  # white space has no ids, letters are lower-cased
        self.table = dict(enumerate(byte_letters()))
        super().__init__()

    def _forget(self):
        super()._forget()
        self.tails: dict[str, list[int]] = {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def cuts(self):
        return {"attached": [lambda t: self._attached(t, True), lambda t: self._attached(t, False)], "dropped": [lambda t: self._dropped(t, True), lambda t: self._dropped(t, False)], "whole": []}[self.kind]

    # Marks in chunks: NUL in front = no space before it; \1 alone = end of the text; \2 behind = cut at spaces and newlines only;
    # \3 in front = a point or comma that was cut off a word (one that stands alone has no certain border).
    def _attached(self, t: pa.Array, points: bool) -> pa.ListArray:
        t = pc.binary_join_element_wise("\0", t, " \1", "")
        t = pc.replace_substring(t, "\n", " \0\n \0")
        t = pc.replace_substring(t, " \0 \1", " \1")
        if points:
            t = self._points(t)
        else:
            t = pc.replace_substring(t, " ", "\2 ")
        return pc.split_pattern(t, " ")

    @staticmethod
    def _points(t: pa.Array) -> pa.Array:
        """Points and commas before a space stand alone; in two steps, so that no space that was put in counts."""
        t = pc.replace_substring(pc.replace_substring(t, ". ", "\4. "), ", ", "\4, ")
        return pc.replace_substring(t, "\4", " \3")

    def _dropped(self, t: pa.Array, points: bool) -> pa.ListArray:
        t = pc.replace_substring(pc.ascii_lower(pc.binary_join_element_wise(t, " ", "")), "\n", " ")
        if points:
            t = self._points(t)
        else:
            t = pc.replace_substring(t, " ", "\2 ")
        return pc.split_pattern(t, " ")

    def learn(self, chunks: list[str]) -> None:
        attached, spell, tokenize = self.kind == "attached", self.table, self.model.tokenize
        done, ids, odd = [], [], []
        tails: dict[str, list[int]] = self.tails

        def letters(word: str) -> list[int]:
            if not word.isascii():
                word = (word if attached else word.lower()).encode().decode("latin-1").translate(spell)
            return [t.id for t in tokenize(word)]

        for c in chunks:
            plain = c[-1:] == "\2"
            word = c[:-1] if plain else c
            glued = word[:1] == "\0"
            word = word[1:] if glued else word
            lead = "Ġ" if attached and not glued else ""
            if word.isalpha() and max(word) < _LETTERS_BELOW:
                done.append(c)
                ids.append([t.id for t in tokenize(lead + word)] if word.isascii() else letters(" " * bool(lead) + word))
            elif word == "\1" and attached and not glued and not plain or not word and not attached:
                done.append(c)
                ids.append([])
            elif word in ("\3.", "\3,"):
                odd.append((c, word[1:]))
            elif plain or word == "\n" and glued:
                if attached and not (word == "\n" and glued) and word.split() != [word]:
                    self.row[c] = _INVALID
                    continue
                stem = word.rstrip('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
                tail = word[len(stem) :]
                if stem and tail and stem.isalpha() and max(stem) < _LETTERS_BELOW:
                    if tail not in tails:
                        tails[tail] = self.whole([tail])[0]
                    done.append(c)
                    ids.append(([t.id for t in tokenize(lead + stem)] if stem.isascii() else letters(" " * bool(lead) + stem)) + tails[tail])
                else:
                    odd.append((c, word if not lead else " " + word))
            elif word and word[-1].isalnum() and word[-1] < _LETTERS_BELOW and word.split() == [word]:
                odd.append((c, word if not lead else " " + word))
            else:
                self.row[c] = _INVALID
        done += [c for c, _ in odd]
        ids += self.whole([w for _, w in odd])
        self._add(done, ids)
