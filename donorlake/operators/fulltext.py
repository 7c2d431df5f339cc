"""Full-text search: a stored positional index, a query language, and search under a time budget.

An index is a folder.  ``postings/segment=S/bucket=B`` holds a row for each place
where a term stands, with its document and that document's length.  Rows lie in
the order of term, document and place, so columns are runs or, in Parquet's
delta encoding, small steps; a term's bucket follows from its hash, so a search
reads the buckets of its terms only, and of these the row groups of its terms.  Additions
are segments of their own until they are merged; a numbered manifest, created
exclusively and last, names the segments that count.

Places tell the field: ``FIELD_SIZE`` times the field's number, plus the place
in the field, so no phrase runs across fields and a column filter is a range.

The language: words and quoted phrases; ``AND``, ``OR``, ``NOT`` (capitals),
binding in the order NOT, AND, OR, each from left to right; two expressions side
by side are joined by AND; parentheses; ``field:`` before a phrase or a
parenthesis.  A phrase matches where its words stand in a row in one field; one
without letters or digits matches nothing.  A query becomes rows of nodes and
leaves, so any number of queries is searched by the same joins.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import lowered
from ..sources import shared, sinks
from .retrieve import K1, B

FIELDS = ("title", "abstract", "mesh")
#: Places of a field; a field with more words than this is an error.
FIELD_SIZE = 1 << 40
BUCKETS = 64
#: Query terms up to which buckets and terms are literals in the scan's filter; beyond, they are joined.
MOST_TERMS = 5_000
#: Words of the index behind each task that counts hits.
TASK_WORDS = 2_000_000
POSTINGS = "term string, doc_id long, at long, len long, segment string, bucket int"
_WORD = "([a-z0-9]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(_WORD), 1)


# the query language

@dataclass
class Node:
    """``op`` is AND, OR, NOT or LEAF; a leaf has words and perhaps a field."""

    op: str
    children: tuple = ()
    words: tuple[str, ...] = ()
    field: str | None = None


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|(\w+)\s*:|([^\s"():]+))')


def _tokens(query: str) -> list[tuple[str, str]]:
    out, at, query = [], 0, query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"syntax error at {query[at:]!r}")
        quoted, bracket, field, word = m.groups()
        if quoted is not None:
            out.append(("phrase", quoted.replace('""', '"')))
        elif bracket:
            out.append((bracket, bracket))
        elif field is not None:
            out.append(("field", field))
        else:
            out.append(("op", word) if word in ("AND", "OR", "NOT") else ("phrase", word))
        at = m.end()
    return out


def parse(query: str, fields: tuple[str, ...] = FIELDS) -> Node:
    """The query's tree; ValueError for what isn't in the language."""
    tokens = _tokens(query)

    def peek():
        return tokens[0] if tokens else ("end", "")

    def binary(op: str, below, implicit: bool = False) -> Node:
        node = below()
        while peek() == ("op", op) or implicit and peek()[0] in ("phrase", "(", "field"):
            if peek() == ("op", op):
                tokens.pop(0)
            node = Node(op, (node, below()))
        return node

    def either() -> Node:
        return binary("OR", lambda: binary("AND", lambda: binary("NOT", one), implicit=True))

    def one(field: str | None = None) -> Node:
        kind, text = tokens.pop(0) if tokens else ("end", "")
        if kind == "phrase":
            return Node("LEAF", words=tuple(re.findall("[a-z0-9]+", text.replace("\u0130", "i").lower())), field=field)
        if kind == "(":
            node = either()
            if not tokens or tokens.pop(0)[0] != ")":
                raise ValueError(f"parenthesis not closed: {query!r}")
            return within(node, field)
        if kind == "field":
            if text not in fields:
                raise ValueError(f"no such field: {text}")
            if field is not None:
                raise ValueError(f"a field of a field: {query!r}")
            return one(text)
        raise ValueError(f"syntax error: a phrase is missing in {query!r}")

    def within(node: Node, field: str | None) -> Node:
        if field is None:
            return node
        return Node(node.op, tuple(within(c, field) for c in node.children), node.words, node.field or field)

    tree = either()
    if tokens:
        raise ValueError(f"syntax error at {tokens[0][1]!r} in {query!r}")
    return tree


NODES = "query_id string, node int, parent int, slot int, op string, depth int, words array<string>, field string, counts boolean"


def clauses(spark: SparkSession, queries: Mapping[str, str]) -> DataFrame:
    """Rows of nodes of all queries (NODES); node 0 is the root, ``counts`` says whether a leaf adds to the score (none below the right side of NOT does)."""
    rows, last = [], {}

    def add(query_id: str, node: Node, parent: int | None, slot: int, depth: int, counts: bool) -> None:
        number = last[query_id] = last.get(query_id, -1) + 1
        rows.append((query_id, number, parent, slot, node.op, depth, list(node.words), node.field, counts))
        for k, child in enumerate(node.children):
            add(query_id, child, number, k, depth + 1, counts and not (node.op == "NOT" and k == 1))

    for query_id, text in queries.items():
        add(query_id, parse(text), None, 0, 0, True)
    return spark.createDataFrame(rows, NODES)


# the stored index

def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def word_lists(articles: DataFrame) -> DataFrame:
    """(doc_id, w0, w1, ...): the words of each field of ``articles(doc_id, title, abstract, mesh)``."""
    return articles.select(F.col("doc_id").cast("long").alias("doc_id"), *(words(F.col(c)).alias(f"w{i}") for i, c in enumerate(FIELDS)))


def postings(lists: DataFrame) -> DataFrame:
    """(term, doc_id, at, len) of ``word_lists``."""
    long = lists.select("doc_id", *(F.size(f"w{i}").alias(f"s{i}") for i in range(len(FIELDS))), F.posexplode(F.concat(*(f"w{i}" for i in range(len(FIELDS))))).alias("k", "term"))
    at, ahead = None, F.lit(0)
    for i in range(len(FIELDS)):
        here = F.lit(i * FIELD_SIZE) + (F.col("k") - ahead)
        at = F.when(F.col("k") < ahead + F.col(f"s{i}"), here) if at is None else at.when(F.col("k") < ahead + F.col(f"s{i}"), here)
        ahead = ahead + F.col(f"s{i}")
    return long.select("term", "doc_id", at.alias("at"), ahead.cast("long").alias("len"))


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len) of postings."""
    return rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))


@dataclass
class Index:
    """A stored index: its folder and the state that its last manifest tells."""

    spark: SparkSession
    path: str
    buckets: int
    segments: list[str]
    n_docs: int
    n_filled: int
    n_words: int
    version: int

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> Index:
        """A new, empty index; an error where the folder has one."""
        made = cls(spark, path or shared.folder(spark, "index"), buckets, [], 0, 0, 0, 0)
        made._publish([], 0, 0, 0)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.json(f"{path}/manifests/*.json", schema="version long, buckets int, segments array<string>, n_docs long, n_filled long, n_words long")
        last = rows.orderBy(F.desc("version")).first()
        return cls(spark, path, last["buckets"], list(last["segments"]), last["n_docs"], last["n_filled"], last["n_words"], last["version"])

    def _publish(self, segments: list[str], n_docs: int, n_filled: int, n_words: int) -> None:
        """The next manifest; FileExistsError if another writer was first."""
        version = self.version + 1
        sinks.manifest(self.spark, f"{self.path}/manifests/{version:09d}.json", {"version": version, "buckets": self.buckets, "segments": segments, "n_docs": n_docs, "n_filled": n_filled, "n_words": n_words}, indent=None)
        self.segments, self.n_docs, self.n_filled, self.n_words, self.version = segments, n_docs, n_filled, n_words, version

    def mean_length(self) -> float:
        """Words of a document that has any."""
        return self.n_words / self.n_filled if self.n_filled else 1.0

    def _write(self, rows: DataFrame) -> str:
        segment = uuid.uuid4().hex
        laid = rows.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        laid = laid.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id", "at")  # a frequent term spreads over tasks
        laid.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary#at", "false").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        return segment

    def add(self, articles: DataFrame) -> None:
        """One more segment; ValueError for a document that repeats or is there already, or has no doc_id.  A null field is empty."""
        lists = shared.written(word_lists(articles), "index-words")  # texts are split once; the ranges below read them twice
        docs = lists.select("doc_id", sum((F.size(f"w{i}") for i in range(len(FIELDS))), F.lit(0)).cast("long").alias("len"))
        segment = uuid.uuid4().hex
        docs.write.parquet(f"{self.path}/docs/segment={segment}")
        docs = self.spark.read.parquet(f"{self.path}/docs/segment={segment}")
        told = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("k"), F.count(F.when(F.col("len") > 0, 1)).alias("filled"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
        twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if told["k"] < told["n"] or not twice.isEmpty() or self.segments and not docs.join(self.documents(), "doc_id", "left_semi").isEmpty():
            raise ValueError("doc_id must be known, unique and new to the index")
        new = self._write(postings(lists))
        self._publish([*self.segments, f"{new}/{segment}"], self.n_docs + told["n"], self.n_filled + told["filled"], self.n_words + told["words"])

    def merge(self) -> None:
        """All segments as one; readers of the older manifest still find theirs."""
        if len(self.segments) < 2:
            return
        docs = uuid.uuid4().hex
        self.documents().write.parquet(f"{self.path}/docs/segment={docs}")
        new = self._write(self.rows().drop("segment", "bucket"))
        self._publish([f"{new}/{docs}"], self.n_docs, self.n_filled, self.n_words)

    def documents(self) -> DataFrame:
        """(doc_id, len)."""
        parts = [f"{self.path}/docs/segment={s.split('/')[1]}" for s in self.segments]
        return self.spark.read.schema("doc_id long, len long").parquet(*parts) if parts else self.spark.createDataFrame([], "doc_id long, len long")

    def rows(self, terms: DataFrame | None = None) -> DataFrame:
        """The postings, of ``terms(term)`` only if given: their buckets alone are read."""
        if not self.segments:
            return self.spark.createDataFrame([], POSTINGS)
        base = f"{self.path}/postings"
        every = self.spark.read.schema(POSTINGS).option("basePath", base).parquet(*(f"{base}/segment={s.split('/')[0]}" for s in self.segments))
        if terms is None:
            return every
        asked = terms.select("term", _bucket(F.col("term"), self.buckets).alias("bucket")).distinct()
        few = asked.limit(MOST_TERMS + 1).collect()
        if len(few) > MOST_TERMS:
            return every.join(asked, ["bucket", "term"], "left_semi")
        return every.where(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("term").isin(sorted(r.term for r in few)))


def search(index: Index, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the documents that satisfy each query of ``clauses``, best first.

    The score is BM25 over the query's phrases: how often one stands in the
    document, in how many documents it stands.  Ties by doc_id.
    """
    # equal phrases of any queries are looked up once
    phrase = F.xxhash64(F.concat_ws(" ", F.col("words")), F.coalesce("field", F.lit("")))
    keyed = nodes.where("op = 'LEAF' and size(words) > 0").select("query_id", "node", "counts", "depth", "parent", "slot", phrase.alias("p"))
    terms = nodes.where("op = 'LEAF' and size(words) > 0").select(phrase.alias("p"), "field", F.size("words").alias("k"), F.posexplode("words").alias("j", "term")).distinct()
    number = F.coalesce(*(F.when(F.col("field") == c, i) for i, c in enumerate(FIELDS)))
    ranged = terms.select("p", "k", "j", "term", F.coalesce(number * F.lit(FIELD_SIZE), F.lit(0)).alias("lo"), F.coalesce((number + 1) * F.lit(FIELD_SIZE), F.lit(len(FIELDS) * FIELD_SIZE)).alias("hi"))
    found = index.rows(terms).join(F.broadcast(ranged) if _few(ranged) else ranged, "term")
    found = found.where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    # rows of a frequent term lie in a few files; dealt by document, a task has a bounded part of them whatever the input
    parts = max(int(index.spark.conf.get("spark.sql.shuffle.partitions")), index.n_words // TASK_WORDS)
    found = found.repartition(parts, "doc_id")
    single = found.where("k = 1").groupBy("p", "doc_id").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("tf"))
    # a phrase stands where each of its words stands at its distance from one start
    starts = found.where("k > 1").groupBy("p", "k", "doc_id", (F.col("at") - F.col("j")).alias("start")).agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("n")).where("n = k")
    several = starts.groupBy("p", "doc_id").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("tf"))
    hits = shared.written(single.unionByName(several), "phrase-hits")
    df = hits.groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = index.mean_length()
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    asked = shared.written(keyed.join(df, "p"), "phrases-found")  # a row for each phrase of a query; hits of a frequent one aren't gathered in a task
    true = hits.join(F.broadcast(asked) if _few(asked) else asked, "p").select("query_id", "node", "parent", "slot", "depth", "doc_id", F.when(F.col("counts"), weight).otherwise(0.0).alias("w"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    inner = nodes.where("op <> 'LEAF'").select("query_id", "node", "parent", "slot", "depth", "op")
    up = true.select("query_id", "node", "parent", "slot", "depth", "doc_id")
    for depth in range(deepest, 0, -1):  # what holds at this depth decides what holds above it
        sides = up.where(F.col("depth") == depth).groupBy("query_id", F.col("parent").alias("node"), "doc_id").agg(F.max(F.col("slot") == 0).alias("left"), F.max(F.col("slot") == 1).alias("right"))
        holds = F.when(F.col("op") == "OR", F.col("left") | F.col("right")).when(F.col("op") == "AND", F.col("left") & F.col("right")).otherwise(F.col("left") & ~F.col("right"))
        new = sides.join(F.broadcast(inner) if _few(inner) else inner, ["query_id", "node"]).where(holds).select("query_id", "node", "parent", "slot", "depth", "doc_id")
        up = up.where(F.col("depth") < depth).unionByName(new)
    matched = up.where("node = 0").select("query_id", "doc_id").distinct()
    scored = matched.join(true.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score")), ["query_id", "doc_id"])
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """``scored(query_id, doc_id, score)`` with ``rank`` in each query, best first, ties by doc_id.

    Without a limit, rows are dealt by ranges of that order: a rank is the place
    in a range, behind the query's rows in the ranges before it, so no task has
    all rows of a query.
    """
    best = (F.desc("score"), F.col("doc_id"))
    if limit:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= limit)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = shared.written(scored.repartitionByRange(parts, "query_id", *best).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.groupBy("query_id", "_part").agg(F.count(F.lit(1)).alias("_n")).select("query_id", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = laid.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*best)))
    return placed.join(before, ["query_id", "_part"]).select("query_id", "doc_id", "score", (F.col("_before") + F.col("_k")).cast("int").alias("rank"))


def gathered(rows: DataFrame) -> DataFrame:
    """A table that may be small, written; broadcast where it is, so that what it is joined with isn't shuffled."""
    rows = shared.written(rows, "gathered")
    return F.broadcast(rows) if _few(rows) else rows


def _few(df: DataFrame) -> bool:
    return df.limit(MOST_TERMS + 1).count() <= MOST_TERMS


_stored: dict = {}


def stored(articles: DataFrame) -> Index:
    """The index of a table of files, built once in an application: again only if its files' names, sizes or times differ."""
    spark, jvm = articles.sparkSession, articles.sparkSession._jvm
    seen = []
    for parent in sorted({f.rpartition("/")[0] for f in articles.inputFiles()}):
        at = jvm.org.apache.hadoop.fs.Path(parent)
        seen += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    key = (spark.sparkContext.applicationId, articles._jdf.semanticHash(), tuple(seen))
    if key not in _stored:
        made = Index.create(spark)
        made.add(articles)
        _stored[key] = made
    return _stored[key]


# a time budget

def within(spark: SparkSession, searches: Mapping[str, Callable[[], DataFrame]], seconds: float, at_once: int = 4) -> tuple[dict[str, DataFrame], DataFrame]:
    """The results of each search that ends in ``seconds``, written, and (query_id, hits, timed_out) of all.

    Each runs under a job tag of its own; a timer cancels the tag's jobs, and
    the others go on.  Other errors are raised.
    """

    def run(query_id: str):
        tag, over, done = f"search-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def stop() -> None:
            over.set()
            while not done.wait(0.2):  # a search may be between two jobs
                spark.sparkContext.cancelJobsWithTag(tag)

        spark.sparkContext.addJobTag(tag)
        timer = threading.Timer(seconds, stop)
        timer.start()
        try:
            found = shared.written(searches[query_id](), "search")
            hits = found.count()
            return (query_id, 0, True, None) if over.is_set() else (query_id, hits, False, found)
        except Exception:
            if over.is_set():
                return query_id, 0, True, None
            raise
        finally:
            done.set()
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(run, searches))
    return {r[0]: r[3] for r in rows if r[3] is not None}, spark.createDataFrame([r[:3] for r in rows], "query_id string, hits long, timed_out boolean")
