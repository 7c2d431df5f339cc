"""Language ID of mixed texts: scripts narrow candidates, Viterbi labels spans.

A text's words get a score per language from character n-grams (naive Bayes over
hashed n-grams of the word with its borders).  Each word's script, the Unicode
range of its first letter, leaves only the languages that use this script in
training.  Over the words of a text the best sequence of languages is found by
Viterbi, where a switch costs a fixed penalty; runs of one language are spans.
The text's language is the one with most letters in its spans.

Viterbi runs over a batch of texts at once, one word of each per step.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import column, grouped

UNKNOWN = "und"
SWITCH_PENALTY = 12.0
NGRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 17
#: Documents per language that are learned from, about (a sample by hash); the bound of the fit.
TRAIN_DOCS = 3000
#: A script belongs to a language if it has this share of the language's letters in training.
SCRIPT_SHARE = 0.01
#: Words of a batch whose scores are held at once.
GROUP_BYTES = 8 << 20
#: Scores of words that are remembered before all are forgotten.
MAX_WORDS = 200_000

#: First code points of script ranges (fixed values, Unicode blocks): letters from here on are of this script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other-indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA4D0, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
_LETTER = re.compile(r"[^\W\d_]")


def word_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of letters and script number of the first letter (-1: none) of each word."""
    n, script = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for k, w in enumerate(words):
        if w.isalpha():
            n[k], first = len(w), w[0]
        else:
            letters = _LETTER.findall(w)
            if not letters:
                continue
            n[k], first = len(letters), letters[0]
        script[k] = _SCRIPT_OF[np.searchsorted(_STARTS, ord(first), "right") - 1] if ord(first) >= 0x370 else SCRIPT_NAMES.index("latin")
    return n, script


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased words with a border at both ends: buckets, and how many each word has."""
    flat = np.frombuffer("".join(f"\x02{w.lower()}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w.lower()) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(flat))  # letters to the word's end, this one included
    h = np.zeros(len(flat), np.uint64)
    out, who = [], []
    for n in range(1, max(NGRAMS) + 1):
        nxt = np.zeros(len(flat), np.uint64)
        nxt[: len(flat) - n + 1] = flat[n - 1 :]
        h = (h ^ nxt) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in NGRAMS:
            ok = left >= n
            out.append((h[ok] ^ np.uint64(n)) % np.uint64(BUCKETS))
            who.append(word[ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(who)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32).T.copy()  # buckets x languages
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        allowed = (share >= SCRIPT_SHARE).T  # scripts x languages
        allowed[~allowed.any(axis=1)] = True  # a script that no language uses leaves all
        self.allowed = allowed
        self._forget()

    def _forget(self):
        self.row: dict[str, int] = {}
        self.score = np.zeros((1 << 14, len(self.langs)), np.float32)
        self.letters = np.zeros(1 << 14, np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in self.score and self.letters; unseen words are scored first."""
        found = list(map(self.row.get, words))
        if None in found:
            new = [w for w, r in zip(words, found) if r is None]
            base = len(self.row)
            need = base + len(new)
            while need > len(self.letters):
                self.score = np.concatenate([self.score, np.zeros_like(self.score)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            n, script = word_letters(new)
            for lo in range(0, len(new), 50_000):
                some = new[lo : lo + 50_000]
                bucket, who = ngram_buckets(some)
                order = np.argsort(who, kind="stable")
                starts = np.searchsorted(who[order], np.arange(len(some)))
                score = np.add.reduceat(self.logp[bucket[order]], starts, axis=0)
                score -= score.max(axis=1, keepdims=True)
                s = script[lo : lo + 50_000]
                score[(s >= 0)[:, None] & ~self.allowed[s]] = -1e4
                score[s < 0] = 0  # nothing to tell languages by
                self.score[base + lo : base + lo + len(some)] = score
            self.letters[base:need] = n
            for k, w in enumerate(new):
                self.row[w] = base + k
            found = list(map(self.row.__getitem__, words))
        return np.array(found, np.int64)


def viterbi(score: np.ndarray, ends: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word; texts lie in ``score`` one after another, each up to its end."""
    n, langs = score.shape
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    best_from = np.zeros(n, np.int16)  # label before a switch, or -1: any label stays as it was
    stay = np.zeros((n, langs), bool)
    v = np.zeros((len(size), langs), np.float32)
    for t in range(steps):
        a = alive[t]
        at = starts[:a] + t
        if t:
            here = v[:a]
            top = here.argmax(axis=1)
            jump = here[np.arange(a), top] - penalty
            keep = here >= jump[:, None]
            best_from[at], stay[at] = top, keep
            v[:a] = np.where(keep, here, jump[:, None]) + score[at]
        else:
            v[:a] = score[at]
    label = np.zeros(n, np.int16)
    now = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        at = starts[:a] + t
        label[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], best_from[at])
    return label


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: about ``train_docs`` per language, chosen by a hash; rows with null text or lang teach nothing."""
    common.prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Model([UNKNOWN], np.zeros((1, BUCKETS)), np.zeros((1, len(SCRIPT_NAMES))))
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_docs / sizes[k])))])
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        table = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)), np.int64)
        for t in grouped(batches, "text"):
            for lang, text in zip(column(t, "lang").to_pylist(), column(t, "text").to_pylist()):
                words = text.split()
                if not words:
                    continue
                k = langs.index(lang)
                n, script = word_letters(words)
                words = [w for w, s in zip(words, script) if s >= 0]
                if words:
                    table[k, :BUCKETS] += np.bincount(ngram_buckets(words)[0], minlength=BUCKETS)
                    table[k, BUCKETS:] += np.bincount(script[script >= 0], n[script >= 0], len(SCRIPT_NAMES)).astype(np.int64)
        i, j = np.nonzero(table)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(i, pa.int32()), "bucket": pa.array(j, pa.int32()), "n": pa.array(table[i, j], pa.int64())})

    summed = sample.select("lang", "text", "doc_id").repartition(min(8, common.shuffle_partitions(docs.sparkSession)), F.xxhash64("doc_id", "text")).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    got = summed.toArrow()  # at most languages x buckets rows
    table[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(langs, table[:, :BUCKETS], table[:, BUCKETS:])


def _labeller(spark: SparkSession, model: Model, penalty: float, spans: bool):
    """A function for tasks: texts to languages, scores and spans; the model lies in the shared folder."""
    common.prepare(spark)
    folder = common.shared_dir(spark, "language")
    langs, logp, allowed = model.langs, model.logp.tobytes(), model.allowed.tobytes()
    common.write_file(f"{folder}/model", [allowed, logp])

    def load() -> Model:
        fs, path = common.open_fs(f"{folder}/model")
        with fs.open_input_file(path) as f:
            raw = f.read()
        m = Model.__new__(Model)
        m.langs, n = langs, len(langs) * len(SCRIPT_NAMES)
        m.allowed = np.frombuffer(raw, bool, n).reshape(len(SCRIPT_NAMES), len(langs))
        m.logp = np.frombuffer(raw, np.float32, offset=n).reshape(BUCKETS, len(langs))
        m._forget()
        return m

    def label(texts: pa.Array) -> tuple[list, np.ndarray, list]:
        m = common.kept(folder, load)
        if len(m.row) > MAX_WORDS:
            m._forget()
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        ends = lists.offsets.to_numpy(zero_copy_only=False)[1:].astype(np.int64) - lists.offsets[0].as_py()
        codes = lists.flatten().dictionary_encode()
        rows = m.rows(codes.dictionary.to_pylist())[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.empty(0, np.int64)
        letters = m.letters[rows].astype(np.int64)
        best_of = viterbi(m.score[rows], ends, penalty)
        doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        sums = np.bincount(doc * len(langs) + best_of, letters, len(ends) * len(langs)).reshape(len(ends), len(langs))
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        score = np.where(total > 0, sums[np.arange(len(ends)), best] / np.maximum(1, total), 0.0)
        pred = [langs[k] if t else UNKNOWN for k, t in zip(best.tolist(), total.tolist())]
        found: list = [[] for _ in pred]
        if spans:
            starts = np.concatenate([[0], ends[:-1]])
            for k, (a, e, t) in enumerate(zip(starts.tolist(), ends.tolist(), total.tolist())):
                if t:
                    first = [0, *(np.flatnonzero(np.diff(best_of[a:e])) + 1).tolist()]
                    found[k] = [{"first": f, "words": g - f, "lang": langs[best_of[a + f]]} for f, g in zip(first, [*first[1:], e - a])]
        return pred, score, found

    return label


def accepted(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least this share of its letters."""
    label = _labeller(docs.sparkSession, model, penalty, False)
    at = docs.columns.index("text")

    def work(batches):
        for b in batches:
            texts = pc.fill_null(b.column(at).cast(pa.string()), "")
            pred, score, _ = label(texts)
            yield b.filter(pa.array([p != UNKNOWN and x >= least for p, x in zip(pred, score.tolist())], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans): language of whole texts, its share of the letters, and spans of words.

    ``spans`` are (first word, words, language), words as white space parts
    them.  A text that is null or has no letter is ``und`` with score 0 and no
    spans.  Ties go to the language that sorts first.  Null and repeated doc_ids
    stay rows of their own; other columns are ignored.
    """
    label = _labeller(docs.sparkSession, model, penalty, spans)

    def work(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for table in grouped(batches, "text", GROUP_BYTES):
            pred, score, found = label(column(table, "text"))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(column(table, "doc_id"), pa.int64()), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "spans": pa.array(found, kind)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty())
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>")


def held_out(doc_id="doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from the others (see predict and train for nulls, ties and empty tables)."""
    docs = common.read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
