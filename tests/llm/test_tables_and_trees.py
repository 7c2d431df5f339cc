"""Fill-in-middle, similar shingle sets and Merkle manifests against brute force and SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.llm import op11_fim, op12_minhash, op13_merkle
from tests.conftest import SF

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def held_against_sql(df, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, x)) for x in df.select(*names).collect()) == sorted(tuple(map(str, x)) for x in r.fetchall())


# fill in middle

def brute_fim(text, doc_id):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["", None, " ", "\n\t x", "a", "a b\x0b", "é ü 日本  x", "<<<S <P", "holds <P> it", "<M>", "x<", "\x85 \xa0 y", "a  b  c  d  e\n\n", "w " * 60000]


def test_fill_in_middle(spark):
    rows = [(i, ODD[i % len(ODD)], 0.5, "x") for i in range(10 * len(ODD))] + [(None, "null id and <", 0.5, "x"), (3, "again a 3", 0.5, "x"), (3, "again a 3", 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n double, output string")
    made = op11_fim.fill_in_middle(docs)
    back = op11_fim.restore(made.withColumn("restored", F.lit(1))).collect()
    want = sorted((repr((d, *brute_fim(t, d))), t or "") for d, t, *_ in rows)
    assert sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in back) == want
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
        assert sum(p.length for p in r.pieces) == len(r.output.encode()) and len(r.pieces) == (1 if r.form == "plain" else 6)
    assert op11_fim.restore(op11_fim.fill_in_middle(docs.limit(0))).count() == 0
    held_against_sql(op11_fim.op11_fim(spark, SF), op11_fim.ORACLE)


def test_piece_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = bytes(rng.choice(list(b"ab<PSM> \n"), rng.integers(0, 30)).tolist())
        places = sorted(rng.integers(0, len(text) + 1, 2).tolist())
        t = op11_fim.PieceTable(text)
        t.cut(*places)
        assert t.text() == text and [p[2] for p in t.pieces] == [places[0], places[1] - places[0], len(text) - places[1]]
        for form, order in op11_fim.ORDER.items():
            if any(s in text for s in op11_fim.SENTINELS[1:]):
                continue
            u = op11_fim.PieceTable(text)
            u.cut(*places)
            u.arrange(order)
            assert op11_fim.restored(u.text(), form).text() == text and u.sha256() == hashlib.sha256(u.text()).hexdigest()


# similar shingle sets

def brute_similar(rows, words=4):
    """(doc_id, size of the set, smallest doc_id of the component), all pairs compared on sets of strings."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"e{rng.integers(1 << 30)}"
    return " ".join(out)


def families():
    """A crowded family around a text that is not there itself, chains, short and odd texts."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = [(1000 + k, edited(rng, base, int(rng.integers(1, 9)))) for k in range(260)]
    chain = [f"c{x}" for x in range(200)]
    rows += [(k, " ".join(chain[k : k + 150])) for k in range(30)]
    rows += [(100 + k, t) for k, t in enumerate([None, "", " \n", "One two", "one\tTWO", "one two three", "a b c d", "a b c d e", "A B C D", "É b c d", "é b c d", "x y z x y z x y z x y z"] * 2)]
    rows += [(None, "one two"), (None, "only null here now"), (None, None), (7, "again the same id"), (7, "again the same id"), (8, "word " * 50000), (9, "word " * 40000)]
    rows += [(2000 + k, " ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) + " a passage that many documents share in the end") for k in range(120)]
    return rows


@pytest.mark.parametrize("small", [op12_minhash.SMALL, 24])
def test_similar_sets(spark, small):
    rows = families()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, node int, key string, label int")
    got = op12_minhash.near_duplicates(docs, small=small).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute_similar(rows)))
    assert op12_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_pairs_meet_once_in_a_round(spark):
    """Near sets without a link that meet in five tree nodes, and in all pairs of two blocks, leave one of these only."""
    h = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 1000, np.uint64))
    sketches = [bytearray(op12_minhash.sketch(op12_minhash.minwise(x))) for x in (h[:800], h[150:950])]
    many = [5, 7, 9, 11, 13]
    rows = [(key, n, n, s, 800, key, -1, many) for key in many for n, s in enumerate(sketches)]
    rows += [(90, n, n, sketches[n % 2], 800, 90, part, [90]) for n, part in ((10, 1), (12, 1), (11, 2))]  # one pair of blocks
    rows += [(91, n, n, sketches[0], size, 91, -1, [91]) for n, size in ((20, 800), (21, 600))]  # sizes that allow no link
    some = spark.createDataFrame(rows, "key long, node long, label long, sketch binary, n_shingles long, of long, part long, keys array<long>")
    got = {(r.key, r.node) for r in op12_minhash.promising(some).collect()}
    assert got == {(5, 0), (5, 1), (90, 10), (90, 11), (90, 12)}


def test_minhash_query(spark):
    held_against_sql(op12_minhash.op12_minhash(spark, SF), op12_minhash.ORACLE)


def test_exact_intersections_and_sketches():
    rng = np.random.default_rng(8)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(rng.integers(2, 12))]
        assert op12_minhash.intersections(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    apart = []
    for _ in range(200):  # pairs of similarity 0.8
        h = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = (np.frombuffer(op12_minhash.sketch(op12_minhash.minwise(x)), np.uint64)[None] for x in (h[:810], h[90:]))
        apart.append(int(op12_minhash.apart(a, b)[0, 0]))
    assert 36 < np.mean(apart) < 41 and np.std(apart) < 7 and max(apart) <= op12_minhash.SKETCH_APART


# Merkle manifests

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(digests, arity):
    """Root, and for each leaf its siblings' steps (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for leaf, k in enumerate(at):
            lo = k // arity * arity
            paths[leaf].append(("".join(level[lo:k]), "".join(level[k + 1 : lo + arity])))
        at = [k // arity for k in at]
        level = [sha(*level[k : k + arity]) for k in range(0, len(level), arity)]
    return level[0], paths


def brute_manifest(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees.append((ranked, *brute_tree([brute_leaf(r) for r in ranked], arity)))
    root, upper = brute_tree([t[1] for t in trees], arity)
    return [(r[0], r[1], brute_leaf(r), sub, root, path + up) for (ranked, sub, paths), up in zip(trees, upper) for r, path in zip(ranked, paths)]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest(spark, arity):
    rows = [(i, "hot", "en", i, f"text {i}\n") for i in range(70)] + [(i, None, None, None, None) for i in (5, 1, 9, 1)] + [(None, "hot", "en", 1, ""), (None, "", "de", 1, "ü"), (7, "Z", "x", 2, "one"), (7, "Z", "x", 2, "one"), (6, "é", "x", 2, "1:a"), (8, "a", "x", 2, "-"), (3, "a", None, 2, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, i int")
    made = op13_merkle.manifest(docs, arity).withColumn("end", op13_merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(map(repr, brute_manifest(rows, arity))) == sorted(repr((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path])) for r in made)
    assert all(r.end == r.root for r in made)


def test_manifest_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert op13_merkle.manifest(docs.limit(0)).count() == 0
    (one,) = op13_merkle.manifest(docs.where("doc_id = 3")).collect()
    assert one.leaf == one.subroot == one.root and one.path == []
    few = docs.where("doc_id < 12").withColumn("source", F.col("doc_id").cast("string"))  # a leaf in each source
    rows = [tuple(r) for r in few.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert {(r.doc_id, r.root) for r in op13_merkle.manifest(few).collect()} == {(r[0], r[4]) for r in brute_manifest(rows, 3)}


def test_tampering(spark):
    got = op13_merkle.op13_merkle(spark, SF)
    held_against_sql(got, op13_merkle.ORACLE)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in text[r.doc_id]) for r in rows)
    assert {r.verified for r in rows} == {True, False}
