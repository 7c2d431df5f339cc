"""Wavelet files and packing against the plain library."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from donorlake.llm import common, op01_wavelet, op02_packing
from donorlake.llm.chunked_tokens import TokenizerFile

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", " a", "a  ", "a   b\n c", "x\t y \n\n z", "İstanbul é´ ́b Σας ΣΑΣ", "I'm you'll don't. It's", "<|endoftext|> a", "123 45.6,, x", "a　b \xa0c", "a.,b ,. c..", "ß ª½²", "\x1c a \x1d b\x85 c", "a.\n", "a\n", "\na", "a \0b", "a\1 b \1", "a\2 b", "x%%%. y", ". . a, , b", "''s 's. 'S", "..", ".. ,, a", "a,. b", "a .. b. .", ".", "\n. a", ", , b"]


@pytest.fixture(scope="module")
def encoders():
    return {(p, s): TokenizerFile(p, s) for p in (WORD, BYTE) for s in (False, True)}


def plain(path, texts, special_as_text=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(flat, ends):
    return [x.tolist() for x in np.split(flat, ends[:-1])]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_odd_texts(encoders, path, special_as_text):
    odd = [*ODD, "a <|endoftext|> b", "x<|ENDOFTEXT|>y <|startoftext|>", "<|endoftext|"]
    assert split(*encoders[path, special_as_text].encode(pa.array(odd))) == plain(path, odd, special_as_text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé ,.\n\t'%0ñ日", max_size=30), min_size=1, max_size=4))
def test_any_texts(texts):
    for path in (WORD, BYTE):
        enc = test_any_texts.__dict__.setdefault(path, TokenizerFile(path))
        assert split(*enc.encode(pa.array(texts, pa.string()))) == plain(path, texts)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=200))
def test_wavelet_matrix(tmp_path_factory, values):
    ids = np.array(values, "<u2")
    uri = "file://" + str(tmp_path_factory.mktemp("w") / "x")
    common.write_file(uri, op01_wavelet.build(ids, 9, [None, 5], np.array([len(ids) // 2, len(ids)])))
    s = op01_wavelet.Shard(uri)
    assert s.all().tolist() == values and s.documents()[0] == [None, 5]
    for i in range(0, len(values), 17):
        assert s.access(i) == values[i]
        assert s.count(values[i], 0, i) == values[:i].count(values[i])
        assert s.select(values[i], values[:i].count(values[i])) == i
    assert s.count(301) == 0


def test_many_blocks(tmp_path):
    ids = np.random.default_rng(0).integers(0, 50, 200_000).astype("<u2")
    uri = f"file://{tmp_path}/x"
    common.write_file(uri, op01_wavelet.build(ids, 6, [1], np.array([len(ids)])))
    s = op01_wavelet.Shard(uri)
    assert (s.all() == ids).all()
    assert s.select(7, 3000) == np.flatnonzero(ids == 7)[3000] and s.count(7, 100, 150_000) == (ids[100:150_000] == 7).sum()


def documents(spark):
    rows = [(3, "the cat. sat, here", "s1", 9), (None, "no id", "s2", 9), (1, None, None, 9), (3, "the cat. sat, here", "s1", 9), (2, "", "s2", 9), (9, "word " * 6000, "s1", 9), (8, "tail  two\n", "s3", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, queue int"), rows


def test_shards_round_trip(spark):
    docs, rows = documents(spark)
    manifest = op01_wavelet.write_shards(docs, WORD, 1, common.shared_dir(spark, "t"), shard_tokens=50)
    got = sorted(op01_wavelet.read_documents(manifest).drop("file").collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r, ids in zip(order, plain(WORD, [r[1] or "" for r in order])):
        ids = np.array([*ids, 1], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want and manifest.count() > 1
    assert op01_wavelet.read_documents(op01_wavelet.write_shards(docs.limit(0), WORD, 1, common.shared_dir(spark, "t"))).count() == 0


def check_pieces(rows, pieces, end=True):
    ids = [np.array([*x, 1], "<u4") for x in plain(BYTE, [r[1] or "" for r in rows])]
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seqs[p.sequence_id].append((p.offset, p.length))
    total = collections.Counter()
    for r, x in zip(rows, ids):
        total[r[0]] += len(x)
    assert {d: sum(p.length for p in ps) for d, ps in by.items()} == dict(total)
    whole = {r[0]: x for r, x in zip(rows, ids)}
    for p in pieces:
        x = whole[p.doc_id]
        assert p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
    lengths = []
    for k in range(len(seqs)):
        at = 0
        for o, n in sorted(seqs[k]):
            assert o == at
            at += n
        lengths.append(at)
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in lengths)


def test_packing(spark):
    docs, rows = documents(spark)
    check_pieces(rows, op02_packing.pack(docs, BYTE).collect())
    assert op02_packing.pack(docs.limit(0), BYTE).count() == 0


def test_packing_weights_and_proportions(spark):
    rows = [(i, "alpha beta gamma delta " * 40, "a" if i % 4 else "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = op02_packing.pack(docs, BYTE).collect()
    check_pieces(rows, pieces)
    share = collections.Counter()
    for p in pieces:
        share[p.sequence_id] += p.length if p.doc_id % 4 == 0 else 0
    full = max(p.sequence_id for p in pieces) - 11
    assert all(abs(share[k] - 512) <= 600 for k in range(full))  # a slice of each source
    assert abs(sum(share[k] for k in range(full)) / full - 512) < 30  # deficits are carried
    check_pieces(rows, op02_packing.pack(docs, BYTE, weights={"a": 1, "b": 3}).collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9000), min_size=1, max_size=6), st.integers(0, 1))
def test_closed_form_is_the_round_robin(tokens, weighted):
    plan = op02_packing.Plan(tokens, [1.0 + i for i in range(len(tokens))] if weighted else None)
    want, sent, deficit = {}, [0] * len(tokens), [0] * len(tokens)
    at = 0
    while sum(sent) < sum(tokens):
        for q in range(len(tokens)):
            deficit[q] += int(plan.quantum[q])
            while deficit[q] >= int(plan.slice[q]) * op02_packing.UNIT:
                deficit[q] -= int(plan.slice[q]) * op02_packing.UNIT
                n = min(int(plan.slice[q]), tokens[q] - sent[q])
                if n > 0:
                    want[q, sent[q]] = at
                    at, sent[q] = at + n, sent[q] + n
    if want:
        keys = list(want)
        got = plan.places(np.array([q for q, _ in keys]), np.array([a for _, a in keys]))
        assert got.tolist() == [want[k] for k in keys]


def test_op_queries(spark):
    from tests.conftest import SF

    assert op01_wavelet.op1_wavelet(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pieces(rows, op02_packing.op2_packing(spark, SF).collect())


def literal_round_robin(tokens, plan):
    """The stream in order: (queue, place) of each slice, by counters alone."""
    deficit, sent, out = [0] * len(tokens), [0] * len(tokens), []
    while any(s < t for s, t in zip(sent, tokens)):
        for q in range(len(tokens)):
            if sent[q] >= tokens[q]:
                continue
            deficit[q] += int(plan.quantum[q])
            while deficit[q] >= int(plan.price[q]) and sent[q] < tokens[q]:
                out.append((q, sent[q]))
                deficit[q] -= int(plan.price[q])
                sent[q] += min(int(plan.slice[q]), tokens[q] - sent[q])
    return out


@pytest.mark.parametrize("weights", [None, [20, 1, 3], [1e-3, 1, 1], [1e3, 1e3, 1.0]])
def test_weighted_plans(weights):
    tokens = [9000, 40_000, 3001]
    plan = op02_packing.Plan(tokens, weights)
    order = literal_round_robin(tokens, plan)
    q, at = (np.array(x, np.int64) for x in zip(*order))
    place = plan.places(q, at)
    size = np.minimum(plan.slice[q], np.array(tokens)[q] - at)
    assert place.tolist() == (np.cumsum(size) - size).tolist()


def test_plans_of_large_corpora():
    """No product leaves 64 bits, and bad weights are errors."""
    for tokens, weights in (([10**13] * 2, [20, 1]), ([10**12] * 2, [200, 1]), ([25 * 10**12, 10**6], None)):
        plan = op02_packing.Plan(tokens, weights)
        total = sum(tokens)
        for q in (0, 1):
            last = (tokens[q] - 1) // int(plan.slice[q]) * int(plan.slice[q])
            places = plan.places(np.array([q, q]), np.array([0, last]))
            assert 0 <= places[0] <= places[1] < total
        ends = [int(plan.places(np.array([q]), np.array([(tokens[q] - 1) // int(plan.slice[q]) * int(plan.slice[q])]))[0]) + (tokens[q] - 1) % int(plan.slice[q]) + 1 for q in (0, 1)]
        assert max(ends) == total
    for bad in ([1, 0], [1, -1], [1, float("nan")], [0, 0]):
        with pytest.raises(ValueError):
            op02_packing.Plan([10**7] * 2, bad)


def test_many_sources_keep_their_weights(spark):
    docs = spark.createDataFrame([(i, "word " * 200, f"s{i % 300:03d}" if i % 300 else None) for i in range(600)], "doc_id long, text string, source string")
    pieces = op02_packing.pack(docs, BYTE, weights={"s001": 50.0}).collect()
    assert len({p.queue for p in pieces}) == 300
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in plain(BYTE, ["word " * 200] * 600))
    assert max(p.sequence_id for p in pieces if p.doc_id == 301) < 40  # the heavy source is sent first


@pytest.mark.parametrize(("weights", "end"), [(None, 1), ({"a": 3.0, None: 0.5, "none": 9.0}, None)])
def test_packing_by_ranges_is_the_closed_form(spark, weights, end):
    """Few sources packed as many ones are: the same pieces, documents without tokens and of many windows included."""
    texts = ["", "alpha beta", "x " * 5000, "one two three " * 30]
    docs = spark.createDataFrame([(i, texts[i % 4] if i % 11 else None, [None, "a", "b", "\u00e9", "a"][i % 5]) for i in range(150)], "doc_id long, text string, source string").repartition(5)
    few, many = (sorted(map(tuple, op02_packing.pack(docs, BYTE, end_id=end, weights=weights, many=m).collect()), key=str) for m in (256, 1))
    assert few == many and len({x[-1] for x in few}) == 4
    assert op02_packing.pack(docs.limit(0), BYTE, many=0).count() == 0


def test_fifty_thousand_sources(spark):
    """A queue for each of 50,000 sources, against counters that run round by round."""
    n = 50_000
    rows = [(i, "a b c" if i % 3 else "word " * (i % 400), f"s{i:05d}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = op02_packing.pack(docs, BYTE).collect()
    check_pieces(rows, pieces)
    tokens = np.zeros(n, np.int64)
    for p in pieces:
        tokens[p.doc_id] = p.doc_tokens
    quantum = np.maximum(1, 2048 * op02_packing.UNIT * tokens // tokens.sum())
    size, deficit, sent, order = np.clip(quantum // op02_packing.UNIT, 64, 2048), np.zeros(n, np.int64), np.zeros(n, np.int64), []
    while (left := sent < tokens).any():
        deficit += np.where(left, quantum, 0)
        for q in np.flatnonzero(deficit >= size * op02_packing.UNIT):
            while deficit[q] >= size[q] * op02_packing.UNIT and sent[q] < tokens[q]:
                deficit[q] -= size[q] * op02_packing.UNIT
                order += [(q, x) for x in range(sent[q], min(tokens[q], sent[q] + size[q]))]
                sent[q] = min(tokens[q], sent[q] + size[q])
    got = [(p.doc_id, p.start + i) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for i in range(p.length)]
    assert got == order
