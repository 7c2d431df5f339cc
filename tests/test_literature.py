"""The query language, the stored index, budgets and retrieval arms."""

import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from donorlake.operators import fulltext, literature

DOCS = [
    (1, "Beta cells", "insulin in the pancreas. Beta again", "Islets"),
    (2, "cells of the immune system", "beta testing", "B-Lymphocytes"),
    (3, None, "", None),
    (4, "the pancreas", "no insulin; cells, beta", "B Lymphocytes; Islets"),
    (5, "insulin insulin insulin", "in the", "pancreas"),
]
SCHEMA = "doc_id long, title string, abstract string, mesh string"


@pytest.fixture(scope="module")
def index(spark):
    made = fulltext.Index.create(spark, buckets=16)
    made.add(spark.createDataFrame(DOCS[:3], SCHEMA))
    made.add(spark.createDataFrame(DOCS[3:], SCHEMA))
    return made


def found(spark, index, query):
    return {r.doc_id for r in fulltext.search(index, fulltext.clauses(spark, {"q": query})).collect()}


def test_trees():
    def shown(n):
        return f"{n.field + ':' if n.field else ''}{' '.join(n.words)}" if n.op == "LEAF" else f"({shown(n.children[0])} {n.op} {shown(n.children[1])})"

    same = {
        "a OR b AND c": "(a OR (b AND c))",
        "a AND b OR c": "((a AND b) OR c)",
        "a NOT b AND c": "((a NOT b) AND c)",
        "a AND b NOT c": "(a AND (b NOT c))",
        "a b OR c": "((a AND b) OR c)",
        "(a OR b) c": "((a OR b) AND c)",
        'mesh: "B-Lymphocytes" AND a': "(mesh:b lymphocytes AND a)",
        "mesh:(a OR b) c": "((mesh:a OR mesh:b) AND c)",
        '"say ""it"" now"': "say it now",
        "AND_ or not": "((and AND or) AND not)",
    }
    assert {q: shown(fulltext.parse(q)) for q in same} == same
    for bad in ("", "  ", "a AND", "OR a", "(a", "a)", "()", "year: a", "mesh: title: a", 'a "b', "a : b", "NOT a", "mesh:"):
        with pytest.raises(ValueError):
            fulltext.parse(bad)


def test_expressions(spark, index):
    want = {
        "beta": {1, 2, 4},
        '"beta cells"': {1},
        '"cells beta"': {4},
        '"in the pancreas"': {1},
        '"the pancreas"': {1, 4},
        '"system beta"': set(),  # across fields
        "insulin AND cells": {1, 4},
        "insulin OR cells": {1, 2, 4, 5},
        "insulin NOT beta": {5},
        "insulin AND (immune OR islets)": {1, 4},
        "immune OR insulin AND islets": {1, 2, 4},
        "mesh: islets": {1, 4},
        "mesh: pancreas": {5},
        "title: (pancreas OR immune)": {2, 4},
        'mesh: "B-Lymphocytes"': {2, 4},
        '""': set(),
        "beta OR !!": {1, 2, 4},
        "(insulin NOT (mesh: islets)) OR immune": {2, 5},
    }
    assert {q: found(spark, index, q) for q in want} == want


def test_scores_are_of_phrases(spark, index):
    rows = fulltext.search(index, fulltext.clauses(spark, {"a": "insulin", "b": "insulin OR zzz", "c": "insulin NOT beta", "d": "insulin insulin"}), 2).collect()
    by = {q: [(r.doc_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in "abcd"}
    assert by["a"] == by["b"] and by["a"][0][0] == 5 and len(by["a"]) == 2
    assert by["c"] == by["a"][:1] and by["d"][0][1] == pytest.approx(2 * by["a"][0][1], abs=1e-5)


def test_segments(spark, index):
    again = fulltext.Index.open(spark, index.path)
    assert (again.segments, again.n_docs, again.n_words, again.version) == (index.segments, 5, index.n_words, 3)
    before = found(spark, index, "insulin OR beta")
    for bad in (DOCS[:1], [(9, "a", "b", "c"), (9, "d", "e", "f")], [(None, "a", "b", "c")]):
        with pytest.raises(ValueError):
            again.add(spark.createDataFrame(bad, SCHEMA))
    again.merge()
    assert len(again.segments) == 1 and again.version == 4 and found(spark, again, "insulin OR beta") == before
    assert found(spark, index, "insulin OR beta") == before  # the older manifest's segments are still there
    with pytest.raises(Exception, match="(?i)exist"):  # another writer was first
        index.add(spark.createDataFrame([(8, "late", "", "")], SCHEMA))
    assert found(spark, fulltext.Index.open(spark, index.path), "late") == set()
    none = fulltext.Index.create(spark)
    assert found(spark, none, "a") == set() and none.documents().count() == 0
    none.add(spark.createDataFrame([], SCHEMA))
    assert found(spark, none, "a AND b") == set()


def test_a_search_reads_its_terms_buckets(spark, index):
    terms = spark.createDataFrame([("insulin",), ("beta",)], "term string")
    rows = index.rows(terms)
    read = {f.split("bucket=")[1].split("/")[0] for f in rows.select(F.input_file_name().alias("f")).distinct().toPandas().f}
    want = {str(r[0]) for r in terms.select(fulltext._bucket(F.col("term"), 16)).collect()}
    assert read == want and len(want) < 16
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert "PushedFilters: [In(term" in plan
    file = next(iter(rows.inputFiles())).replace("file://", "")
    meta = pq.ParquetFile(file).metadata.row_group(0)
    at = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == "at")
    assert "DELTA_BINARY_PACKED" in at.encodings


def test_budget(spark, index):
    def sleepy():
        def work(batches):
            for b in batches:
                time.sleep(60)
                yield b

        return spark.range(0, 1, 1, 1).mapInArrow(work, "id long")

    began = time.time()
    tables, told = fulltext.within(spark, {"slow": sleepy, "good": lambda: fulltext.search(index, fulltext.clauses(spark, {"q": "beta"}))}, 20.0)
    assert time.time() - began < 55
    assert {r.query_id: (r.hits, r.timed_out) for r in told.collect()} == {"slow": (0, True), "good": (3, False)} and set(tables) == {"good"}
    with pytest.raises(Exception, match="no_such"):
        fulltext.within(spark, {"bad": lambda: spark.range(1).select("no_such")}, 30.0)


def test_ladder():
    asked = literature.ladder(["A1", "B2", "C3"], "B cell", {"A1": ["alpha one", "A-1"]})
    assert asked == [
        '"A1" AND "B2" AND "C3"', '"A1" AND "B2"', '"A1" AND "C3"', '"B2" AND "C3"', '"A1" AND ("cell" OR cells OR cellular)', '"B2" AND ("cell" OR cells OR cellular)', '"C3" AND ("cell" OR cells OR cellular)',
        '"A1" OR "alpha one" OR "A 1"', '"B cell"', '"B cell" AND "marker"', 'mesh: "B Lymphocytes"', 'mesh: "B Lymphocytes" AND "A1"',
    ]
    assert literature.ladder(["X", "X", ""]) == ['"X" AND "X"', '"X" AND ("cell" OR cells OR cellular)']
    for q in asked:
        fulltext.parse(q)


def test_runs(spark, index):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    types = [literature.Asked("beta cell", ["insulin", "pancreas"], ["islets"], {"insulin": ["beta"]}), literature.Asked("no one", ["zzz"])]
    every, figures = literature.runs(index, docs, types, context=("immune", "the pancreas"), most_chars=60)
    f = {(r.arm, r.type): r for r in figures.collect()}
    assert set(f) == {(a, t.name) for a in literature.ARMS for t in types} - {("rag_curated", "no one"), ("rag_curated_alias", "no one")}
    assert f["rag_markers", "no one"].n_pooled == 0 and f["rag_markers", "no one"].caption == ""
    assert f["rag_markers_alias", "beta cell"].n_pooled >= f["rag_markers", "beta cell"].n_pooled > 0
    assert "Beta cells" in f["rag_name", "beta cell"].caption and "Beta cells" not in f["rag_name_stripped", "beta cell"].caption
    assert all(len(r.caption) <= 60 + 3 and r.n_timeouts == 0 for r in f.values())
    best = {(r.arm, r.place): r for r in every.where("type = 'beta cell'").collect()}
    assert best["rag_markers", 1].doc_id in (1, 4, 5) and best["rag_markers", 1].coverage == 1.0
    _, slow = literature.runs(index, docs, types[:1], arms=["rag_curated"], seconds=60.0)
    assert [(r.n_timeouts, r.n_pooled) for r in slow.collect()] == [(0, f["rag_curated", "beta cell"].n_pooled)]


def test_severity_runs(spark, index):
    articles = spark.createDataFrame(DOCS, SCHEMA)
    levels = spark.createDataFrame([("s", f"l{k}", k) for k in range(4)] + [("alone", "x", 0)], "scale string, level string, place int")
    core, tiers = {"s": ("insulin", "pancreas")}, (("immune system",), ("no such phrase",), ("beta",), ("insulin insulin",))
    docs, figures = literature.severity_runs(index, articles, levels, core, tiers, ("islets",), context=("cells",), most_chars=40)
    rows = docs.collect()
    hits = {"insulin": {1, 4, 5}, "pancreas": {1, 4, 5}, "immune system": {2}, "no such phrase": set(), "beta": {1, 2, 4}, "insulin insulin": {5}, "islets": {1, 4}}
    asked = {("s", f"l{k}"): [*core["s"], *tiers[k]] for k in range(4)} | {("alone", "x"): ["islets", "immune system"]}
    for key, terms in asked.items():
        mine = [r for r in rows if (r.scale, r.level) == key]
        want = {d: sum(d in hits[t] for t in terms) for t in terms for d in hits[t]}
        assert {r.doc_id: r.hits for r in mine} == want and all(r.coverage == pytest.approx(want[r.doc_id] / len(terms)) for r in mine)
        assert sorted(r.place for r in mine) == list(range(1, len(mine) + 1)) and [r.score for r in sorted(mine, key=lambda r: r.place)] == sorted((r.score for r in mine), reverse=True)
    told = {(r.scale, r.level): r for r in figures.collect()}
    assert set(told) == set(asked) and told["s", "l3"].tier == 3 and told["alone", "x"].tier == 0 and all(len(r.caption) <= 41 and r.n_timeouts == 0 for r in told.values())
    nothing = literature.severity_runs(index, articles, levels, {"s": ("zzz",)}, (("zzy",),), ("zzx",))[1].collect()
    assert len(nothing) == 5 and all(r.n_pooled == 0 and r.caption == "" for r in nothing)
    slow = literature.severity_runs(index, articles, levels, core, tiers, ("islets",), context=("cells",), most_chars=40, seconds=120.0)[0].collect()
    assert sorted(map(tuple, slow)) == sorted(map(tuple, rows))
    with pytest.raises(ValueError):
        literature.severity_runs(index, articles, levels.union(levels.limit(1)), core, tiers)


def test_words_in_order_move_as_texts(spark, tmp_path):
    """A repeated document is one; texts are dealt by document before they are split, and words aren't dealt again."""
    from donorlake.plans import catalogue

    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (1, "c  a")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["distinct_in_order"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, "", 1), (1, "a", 1), (1, "b", 0), (1, "c", 0), (3, "", 0)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert plan.index("Generate") < plan.index("Exchange")  # the exchange lies below


def test_ranks_of_all_hits_come_from_ranges(spark):
    """Ranks over many ranges, ties by document, equal those of one window; no window holds a whole query."""
    scored = spark.range(3000).select(F.when(F.col("id") % 7 < 5, "often").otherwise("seldom").alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") * 37 % 11).cast("double").alias("score"))
    got = {(r.query_id, r.doc_id): r["rank"] for r in fulltext.ranked(scored).collect()}
    want = {}
    for q in ("often", "seldom"):
        rows = sorted((-(i * 37 % 11), i) for i in range(3000) if ("often" if i % 7 < 5 else "seldom") == q)
        want |= {(q, i): k + 1 for k, (_, i) in enumerate(rows)}
    assert got == want
    assert {(r.query_id, r.doc_id): r["rank"] for r in fulltext.ranked(scored, 20).collect()} == {k: v for k, v in want.items() if v <= 20}
    assert "_part" in fulltext.ranked(scored)._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_dealt_by_document(spark, monkeypatch):
    """Tasks that count hits grow in number with the index."""
    docs = spark.createDataFrame([(i, "the", "the of the", "x") for i in range(40)], "doc_id long, title string, abstract string, mesh string")
    index = fulltext.Index.create(spark)
    index.add(docs)
    monkeypatch.setattr(fulltext, "TASK_WORDS", 10)
    asked = []
    frame, real = type(docs), docs.__class__.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: asked.append(a) or real(self, *a))
    assert fulltext.search(index, fulltext.clauses(spark, {"q": '"of the"'})).count() == 40
    assert (index.n_words // 10, "doc_id") in asked
