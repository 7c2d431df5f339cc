"""Lines, languages, pieces, chat, near copies and the pipeline against brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from donorlake.llm import op03_lines, op05_language, op06_pieces, op07_chat, op10_simhash
from tests.conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# lines

def line_docs(spark):
    rows = [(i, "Same Line \n" + f"own {i}\n\n same line", "x") for i in range(12)]
    rows += [(100, None, "x"), (101, "", "x"), (None, "same line\nnull id", "x"), (3, "Same Line \nown 3\n\n same line", "y"), (102, "same line", "x"), (103, "tail\n" + "rare\n" * 300 + "same line", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, bitmap string"), rows


def brute_lines(rows, min_docs):
    docs = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").encode().split(b"\n"):
            docs[x.strip(b" \t\n\x0b\x0c\r").lower()].add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").encode().split(b"\n")
        left = [x for x in lines if not (k := x.strip(b" \t\n\x0b\x0c\r").lower()) or len(docs[k]) < min_docs]
        out.append((d, len(lines), len(lines) - len(left), b"\n".join(left)))
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_lines(spark, partitions):
    docs, rows = line_docs(spark)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        maps = {(r.doc_id, r.text_hash): r.bitmap for r in op03_lines.keep_bitmaps(docs).collect()}
        hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        got = []
        for d, t, _ in rows:
            text, n, gone = op03_lines.kept_text((t or "").encode(), maps.get((d, hashes[d, t])))
            got.append((d, n, gone, text))
        assert got == brute_lines(rows, 10)
        kept = op03_lines.without_repeats(docs).collect()
        assert len(kept) == len(rows) and sum((r.text or "").lower().split("\n").count("same line") + (r.text or "").split("\n").count("Same Line ") for r in kept) == 1
        assert {r.bitmap for r in kept} == {"x", "y"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert op03_lines.without_repeats(docs.limit(0)).count() == 0


# languages

def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(20):
        ends = np.cumsum(rng.integers(0, 6, 5))
        score = (rng.normal(size=(int(ends[-1]), 3)) * 3).astype(np.float32)
        label, a = op05_language.viterbi(score, ends, 2.0), 0
        for e in ends:
            value = lambda p, a=a: sum(score[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
            if e > a:
                assert abs(value(label[a:e].tolist()) - max(map(value, itertools.product(range(3), repeat=int(e - a))))) < 1e-4
            a = e


def test_language(spark):
    model = op05_language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    en, de = "the and of with that is to for this " * 4, "und der die nicht ein ist das mit von " * 4
    rows = [(1, en + de, 0.5), (2, None, 0.5), (3, "12 34 !!", 0.5), (None, de, 0.5), (5, "", 0.5), (6, en * 3000, 0.5), (1, en + de, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = op05_language.predict(docs, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "de"), (1, "de"), (1, "de"), (2, "und"), (3, "und"), (5, "und"), (6, "en")]  # the German half has more letters
    mixed = next(r for r in got if r.doc_id == 1)
    assert [s.lang for s in mixed.spans] == ["en", "de"] and [s.words for s in mixed.spans] == [36, 36]
    assert all(0 <= r.score <= 1 for r in got)
    kept = op05_language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert op05_language.predict(docs.limit(0), model).count() == 0
    nothing = op05_language.train(docs.limit(0).withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in op05_language.predict(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op05_language.op5_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_scripts_narrow():
    counts, scripts = np.zeros((2, op05_language.BUCKETS)), np.zeros((2, len(op05_language.SCRIPT_NAMES)))
    scripts[0, op05_language.SCRIPT_NAMES.index("latin")] = scripts[1, op05_language.SCRIPT_NAMES.index("cyrillic")] = 10
    m = op05_language.Model(["la", "ru"], counts, scripts)
    assert m.score[m.rows(["слово", "word"])].argmax(axis=1).tolist() == [1, 0]


# pieces

def test_pieces(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "  a", " a", "a  b", "▁a b", "a▁ b", "日本 語x", "\n\n a", "<s> <0x41> a", "é b. c", "word " * 5000]
    enc = op06_pieces.PieceFile(MODEL)
    flat, ends = enc.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [sp.encode(t) for t in texts]
    for t in texts[:-1]:
        spans = zip(*(x.tolist() for x in enc.spans(t, np.array(sp.encode(t), np.int64))))
        assert b"".join(t.encode()[a:b] for a, b in spans) == t.encode()
    rows = [(1, "x y", 1), (None, None, 1), (1, "x y", 1), (2, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, tuple(r.ids), tuple(r.ends)) for r in op06_pieces.encode(docs, MODEL).collect()}
    assert got == {(1, tuple(sp.encode("x y")), (1, 3)), (None, (), ()), (2, (), ())}
    assert op06_pieces.round_trip(docs.limit(0), MODEL).count() == 0
    for r in op06_pieces.op6_pieces(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        ids = sp.encode(r.text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_character_map():
    from sentencepiece import sentencepiece_model_pb2

    for trim in (True, False):
        lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        ours = op06_pieces.Normalizer(proto.normalizer_spec)
        for t in ["ｆｕｌｌ ﾊﾞ①  x ", "  ﬁne Å\tb", "ば か　x", " x", "㍿ ½", "plain"]:
            norm, src = ours.run(t)
            assert norm.decode() == lib.normalize(t) and len(src) == len(norm) + 1 and src == sorted(src)


# chat

def test_chat(spark):
    odd = ["<|im_end|>", "<||im_end|>", "a <| b", "<|im_start|>user\nhi<|im_end|>\n", "<", "||", "", None, "<|||", "x" * 50_000, "\\n"]
    rows = [(c, t, role, odd[(c + t) % len(odd)], "e") for c in range(12) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    rows += [(50, None, "as|<|im_end|>\n\\n\\", "t", "e"), (50, 1, None, None, "e"), (50, 1, None, None, "e"), (None, 0, "user", "q", "e")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    made = op07_chat.format_conversations(conv)
    assert made.where("not identical").count() == 0 and made.count() == 14
    for r in made.collect():
        want = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x, _ in rows if c == r.conv_id))
        loss = [re.sub(r"<(\|+)\|", r"<\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert loss == [x for *_, role, x in want if role == "assistant"] and r.n_turns == len(want)
    assert op07_chat.format_conversations(conv.limit(0)).count() == 0
    plan = op07_chat.op7_chat(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# near copies

def brute_print(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    rows = [(r.doc_id, r.text, "f") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000, None, "f"), (1001, "", "f"), (1002, " \n", "f"), (1003, "one", "f"), (1003, "one", "f"), (None, "one", "f"), (1004, "word " * 40_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id) for r in op10_simhash.near_duplicates(docs).collect())
    fp = [brute_print(t) for _, t, _ in rows]
    rows_fp = np.array(fp, np.uint64)
    root = groups(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(rows_fp ^ rows_fp[i]) <= 3)])
    least = {g: min(r[0] for r, h in zip(rows, root) if h == g and r[0] is not None) for g in set(root)}
    assert got == sorted((r[0] is None, r[0] or 0, f, least[g]) for r, f, g in zip(rows, fp, root))
    assert op10_simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [4096, 40])
def test_dense_keys(spark, monkeypatch, dense):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.int64)
    pts = np.unique(np.concatenate([base, *(base ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for _ in range(10)), (np.int64(5) << 32) + rng.integers(0, 2**18, 300)]))
    monkeypatch.setattr(op10_simhash, "DENSE", dense)
    found = {r.node: r.root for r in op10_simhash.components(op10_simhash.links(spark.createDataFrame([(int(x),) for x in pts], "fp long"))).collect()}
    u = pts.view(np.uint64)
    root = groups(len(pts), [(i, int(j)) for i in range(len(pts)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3)])
    assert all(found.get(int(x), int(x)) == int(pts[g]) for x, g in zip(pts, root))


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_keep_one(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(40):
        words = [vocabulary[i] for i in rng.integers(0, 4000, 300)]
        rows.append((k, " ".join(words), "a"))
        for c in range(3):
            edited = list(words)
            for i in rng.integers(0, 300, 1 + 2 * c):
                edited[i] = "edited"
            rows.append((100 + 10 * k + c, " ".join(edited), "a"))
    rows += [(0, rows[0][1], "b"), (9000, None, "a"), (9001, "", "a"), (None, rows[4][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    sets = [shingles(t) for _, t, _ in rows]
    near = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b) > 0
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    want = collections.Counter(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == g) for g in set(root))
    kept = op10_simhash.keep_one(docs, 5, 0.8)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert op10_simhash.keep_one(docs.limit(0)).count() == 0


def test_similar_pair_in_a_template_group(spark):
    """A pair just above the bound among many just below it, with near candidates that all fail."""
    rng = np.random.default_rng(12)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for k in range(300):
        words = list(base)
        for i in rng.choice(np.arange(3, 397, 9), 12, replace=False):
            words[i] = f"x{k}_{i}"
        rows.append((k, words))
    for k in range(0, 20, 2):
        edited = list(rows[k][1])
        for i in rng.choice(np.arange(5, 397, 9), 8, replace=False):
            edited[i] = f"y{k}_{i}"
        rows[k + 1] = (k + 1, edited)
    rows = [(k, " ".join(w)) for k, w in rows]
    sets = [shingles(t) for _, t in rows]
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert len(set(root)) == len(rows) - 10
    kept = op10_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_no_candidate_is_left_to_shorter_ones(spark):
    """A pair that others connect by shorter edges is a candidate too, in short keys at once and in long ones afterwards."""
    rng = np.random.default_rng(15)
    for masks in ([0, 0b1111111111, 0b11111], sorted({int(x) for x in rng.integers(0, 1 << 16, 24)})):
        nodes = spark.createDataFrame([(i, m, m, m, m, i) for i, m in enumerate(masks)], "node long, w0 long, w1 long, w2 long, w3 long, root long")
        found = op10_simhash.candidates(nodes)
        pairs = {(r.a, r.b) for r in found.select("a", "b").collect() if r.a is not None}
        if len(masks) > 3:
            keys = found.where("a is null").select("k0", "k1")
            assert not keys.isEmpty()
            pairs |= {(r.a, r.b) for r in op10_simhash.more_candidates(nodes, keys).collect()}
        assert pairs == set(itertools.combinations(range(len(masks)), 2))


def test_unlike_texts_with_equal_filler_stay(spark):
    rng = np.random.default_rng(13)
    rows = [(k, " ".join([*(f"a{x}" for x in rng.integers(0, 10**6, 300)), *["."] * 400])) for k in range(6)]
    assert op10_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6


def test_uneven_repeats_are_alike(spark):
    rng = np.random.default_rng(14)
    rows = []
    for k in range(40):
        body, line = (" ".join(f"b{x}" for x in rng.integers(0, 10**6, n)) for n in (200, 20))
        rows += [(2 * k, " ".join([body, *[line] * 2])), (2 * k + 1, " ".join([body, *[line] * 40]))]
    kept = op10_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(range(0, 80, 2))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, at = {}, docs
    from donorlake.llm import common

    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, at, SF), "t")
        frames[name] = (at, after)
        at = after
    before, after = frames["near_copies"]
    assert all(frames[n][1].columns == docs.columns for n in ("language", "lines", "near_copies"))
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = [shingles(t) for _, t in rows]
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    both = {(a, b) for v in index.values() for a, b in itertools.combinations(v, 2)}
    empty = [i for i, s in enumerate(sets) if not s]
    linked = [(a, b) for a, b in both if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] + list(zip(empty, empty[1:]))
    root = groups(len(rows), linked)
    assert {r.doc_id for r in after.collect()} == {min(rows[i][0] for i in range(len(rows)) if root[i] == g) for g in set(root)}
    packed = frames["packing"][1]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in after.collect()}


def test_unknown_pieces_have_spans(tmp_path):
    """A model without byte fallback: an unknown piece covers the run that can't be spelled."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == 6:
            p.type = 1
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    enc = op06_pieces.PieceFile(path)
    for text in ("a 𓀀𓀁 b", "𓀀", "x𓀀 y𓀁𓀂z", "plain text"):
        ids = np.array(enc.sp.encode(text), np.int64)
        starts, ends = enc.spans(text, ids)
        assert b"".join(text.encode()[a:b] for a, b in zip(starts, ends)) == text.encode()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column, repeated rows and clashing names pass all stages."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars int, bitmap string, queue int, node long, root long, text_hash long"
    long = " ".join(f"the word{i} and that other{i}" for i in range(60))
    rows = [(1, long, "en", "a", 5, "x", 1, 2, 3, 4), (1, long, "en", "a", 5, "x", 1, 2, 3, 4), (2, None, None, None, None, None, None, None, None, None), (None, long + " more", "en", None, 5, "x", 1, 2, 3, 4), (3, "", "en", "b", 0, "", 1, 1, 1, 1), (4, "das ist ein anderer Satz mit vielen Worten " * 9, "de", "b", 9, "", 1, 1, 1, 1)]
    for n, some in enumerate(([], rows)):
        path = str(tmp_path / f"t{n}")
        spark.createDataFrame(some, kind).write.parquet(f"{path}/documents.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert bool(out) == bool(some)
        if some:
            assert {r.doc_id for r in out} == {1, 4}
            assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
