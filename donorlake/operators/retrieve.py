"""Literature retrieval: an inverted index, a ladder of Boolean queries, BM25, re-ranking.

Search terms are one word each (equality in the index) or a phrase (words in a
row).  BM25 is its textbook form with k1 = 1.2 and b = 0.75 over title, abstract
and subject terms together; a larger score is better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import lowered
from ..sources.shared import written

K1, B = 1.2, 0.75
#: Words of a phrase that are looked up at once, and phrases up to which the texts aren't shuffled.
LEAD, MOST_PHRASES = 3, 200_000
#: Words that make any text one about cells (fixed values).
CELL_WORDS = ("cells", "cellular")


def body(articles: DataFrame) -> Column:
    return lowered(F.concat_ws(" ", "title", "abstract", "mesh"))


def postings(articles: DataFrame) -> DataFrame:
    """(term, doc_id, tf) over lower-case alphanumeric terms; a semi join on terms is pushed below the count."""
    terms = F.explode(F.regexp_extract_all(body(articles), F.lit("([a-z0-9]+)"), 1))
    return articles.select("doc_id", terms.alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(articles: DataFrame) -> DataFrame:
    """(doc_id, len): terms of each document, without the index and without a shuffle."""
    return articles.select("doc_id", F.size(F.regexp_extract_all(body(articles), F.lit("([a-z0-9]+)"), 1)).alias("len"))


def marker_queries(markers: DataFrame) -> DataFrame:
    """(type, query_id, level, clause, term) from ``markers(type, pos, marker, aliases, context)``: a query holds if each of its clauses has one of its terms.

    Level 1: the first three markers together; 2: each pair of the first five;
    3: each of the first eight with a word of the context; 4: any alias of a
    marker, at most four terms, only where it has one.  A query that repeats
    another's clauses is left out.
    """
    m = markers.where("pos <= 8")
    one = m.where("pos <= 3").select("type", F.lit("L1").alias("query_id"), F.lit(1).alias("level"), F.col("pos").alias("clause"), F.col("marker").alias("term"))
    a, b = m.where("pos <= 5").alias("a"), m.where("pos <= 5").alias("b")
    pair = a.join(b, F.col("a.type") == F.col("b.type")).where("a.pos < b.pos").select(F.col("a.type").alias("type"), F.concat_ws("-", F.lit("L2"), F.col("a.pos"), F.col("b.pos")).alias("query_id"), F.explode(F.array(F.struct(F.lit(1).alias("clause"), F.col("a.marker").alias("term")), F.struct(F.lit(2).alias("clause"), F.col("b.marker").alias("term")))).alias("x"))
    two = pair.select("type", "query_id", F.lit(2).alias("level"), "x.clause", "x.term")
    near = F.explode(F.concat(F.array(F.struct(F.lit(1).alias("clause"), F.col("marker").alias("term"))), F.transform(F.array("context", *map(F.lit, CELL_WORDS)), lambda t: F.struct(F.lit(2).alias("clause"), t.alias("term")))))
    three = m.select("type", F.concat_ws("-", F.lit("L3"), "pos").alias("query_id"), F.lit(3).alias("level"), near.alias("x")).select("type", "query_id", "level", "x.clause", "x.term")
    named = m.where(F.size("aliases") > 0)
    four = named.select("type", F.concat_ws("-", F.lit("L4"), "pos").alias("query_id"), F.lit(4).alias("level"), F.lit(1).alias("clause"), F.explode(F.slice(F.concat(F.array("marker"), "aliases"), 1, 4)).alias("term"))
    every = one.unionByName(two).unionByName(three).unionByName(four).withColumn("term", F.lower("term")).distinct()
    keyed = every.groupBy("type", "query_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "clause", "term"))), ",").alias("k"), F.min("level").alias("l"))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("type", "k").orderBy("l", "query_id"))).where("_n = 1")
    return every.join(first.select("type", "query_id"), ["type", "query_id"], "left_semi")


def search(index: DataFrame, lens: DataFrame | None, queries: DataFrame, n_docs: int, mean_len: float, keys: list[str], limit: int | None = None) -> DataFrame:
    """(keys..., doc_id, score, rank): documents that satisfy all clauses, scored by BM25 of the matched terms.

    Boolean search is a count of satisfied clauses per (query, document), so
    only postings of query terms are read and no document is looked at twice.
    An index with documents' lengths (``len``) needs no ``lens``.
    """
    terms = queries.select("term").distinct()
    hit = index.join(terms, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean_len))
    sized = hit if lens is None else hit.join(lens, "doc_id")
    scored = sized.join(df, "term").select("term", "doc_id", weight.alias("w"))
    need = queries.groupBy(*keys).agg(F.count_distinct("clause").alias("_need"))
    got = queries.select(*keys, "clause", "term").distinct().join(scored, "term").groupBy(*keys, "doc_id").agg(F.count_distinct("clause").alias("_have"), F.sum("w").alias("score"))
    found = got.join(need, keys).where("_have = _need").select(*keys, "doc_id", F.round("score", 6).alias("score"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    ranked = found.withColumn("rank", k)
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def term_counts(articles: DataFrame, terms: list[str]) -> tuple[DataFrame, int, float]:
    """(term, doc_id, tf, len) of a few terms, the number of documents, and the mean length of those with words: what ``search`` needs, from one pass over the texts.

    Texts are not shuffled and no index is stored; a document leaves its length
    and its words among ``terms``.  ValueError for a doc_id that repeats or is null.
    """
    words = F.regexp_extract_all(body(articles), F.lit("([a-z0-9]+)"), 1)
    asked = F.filter("_w", lambda w: w.isin(sorted(set(terms))))
    split = articles.select("doc_id", words.alias("_w"))
    docs = written(split.select("doc_id", F.size("_w").cast("long").alias("len"), asked.alias("found")), "term-counts")
    told = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("mean")).first()
    if told["known"] < told["n"] or not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("doc_id must be known and unique")
    each = docs.select("doc_id", "len", "found", F.explode(F.array_distinct("found")).alias("term"))
    tf = F.size(F.filter("found", lambda w: w == F.col("term"))).cast("long")
    return each.select("term", "doc_id", tf.alias("tf"), "len"), told["n"], told["mean"] or 1.0


def pooled_hits(found: DataFrame, *by: str) -> DataFrame:
    """Per document: queries that found it, best score, sum of reciprocal ranks."""
    return found.groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"), F.sum(1.0 / F.col("rank")).alias("score_agg"), F.array_sort(F.collect_set("query_id")).alias("queries"))


def coverage(text: Column, terms: Column) -> Column:
    """Share of terms (lower case, of letters and digits) that a text has as whole words; no terms: 0."""
    words = F.regexp_extract_all(lowered(text), F.lit("([a-z0-9]+)"), 1)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.array_contains(words, t))) / F.size(terms))


def reranked(pool: DataFrame, cover: str, context: str, keep: int, *by: str) -> DataFrame:
    """Score 10 coverage + 2 context + sum of reciprocal ranks + 0.01 best score, the ``keep`` best, ties by document."""
    score = F.round(10 * F.col(cover) + 2 * F.col(context).cast("int") + F.col("score_agg") + 0.01 * F.col("best"), 6)
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    return pool.withColumn("score", score).withColumn("place", k).where(F.col("place") <= keep)


def retrieval_stats(pool: DataFrame, cover: str, *by: str) -> DataFrame:
    c = F.col(cover)
    return pool.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(c >= 0.5, 1)).alias("n_cov_half"), F.count(F.when(c >= 0.25, 1)).alias("n_cov_quarter"), F.avg(c).alias("mean_coverage"))


def severity_tier(position: Column, n: Column, tiers: int = 4) -> Column:
    """The tier (from 0) of a place among ``n`` ordered levels, half-even rounded; a scale of one level is in the first."""
    return F.bround(position / F.greatest(n - 1, F.lit(1)).cast("double") * (tiers - 1)).cast("int")


def caption_budget(docs: DataFrame, text: str, order: list[str], most: int, *by: str) -> DataFrame:
    """(by..., caption): texts in order until ``most`` characters are used, the last one cut, empty ones left out; joined by spaces that don't count."""
    rows = docs.where(F.length(F.coalesce(F.col(text), F.lit(""))) > 0)
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("_b", before).where(F.col("_b") < most).withColumn("_t", F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("_b")).cast("int")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    listed = cut.withColumn("_p", place).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("l"))
    return listed.select(*by, F.array_join(F.transform("l", lambda x: x["_t"]), " ").alias("caption"))


def without_sentences(text: Column, phrase: str) -> Column:
    """A text without the sentences that name the phrase (or its plural), any case."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\x01")
    pattern = r"(?i)\b" + r"\s+".join(phrase.split()) + r"s?\b"
    return F.array_join(F.filter(F.split(marked, "\x01"), lambda s: ~s.rlike(pattern)), " ")


def first_of_each(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    return rows.groupBy(*by, value).agg(F.min(order).alias("pos"))


def clean_aliases(names: DataFrame, longest: int = 40) -> DataFrame:
    """(gene, aliases) of ``names(gene, pos, alias)``: in order, once each, without the gene itself and over-long names."""
    good = names.where((F.col("alias") != F.col("gene")) & (F.length("alias") <= longest))
    first = first_of_each(good, "alias", "pos", "gene")
    listed = first.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("pos", "alias"))).alias("l"))
    return listed.select("gene", F.transform("l", lambda x: x["alias"]).alias("aliases"))


#: Retrieval arms (fixed values): whose markers are asked for, and whether by type name or with aliases; only ``rag_name`` keeps sentences with the type's name.
ARMS = ("rag_markers", "rag_markers_alias", "rag_name", "rag_name_stripped", "rag_curated", "rag_curated_alias")


def alias_coverage(text: Column, terms: Column) -> Column:
    """Share of ``terms``, an array of arrays (a marker and its aliases, lower case, of letters and digits), of which a text has one as a whole word; no terms: 0."""
    words = F.regexp_extract_all(lowered(text), F.lit("([a-z0-9]+)"), 1)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.arrays_overlap(words, t))) / F.size(terms))


def phrase_hits(articles: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., phrase, doc_id): articles in which all words of a phrase stand in a row.

    Texts are split once and stay where they are: each place is looked up by a
    hash of its next words (LEAD at most), and where that is a phrase's the words
    are compared.  Only beyond MOST_PHRASES phrases the places are dealt by hash.
    """
    words = F.regexp_extract_all(lowered("phrase"), F.lit("([a-z0-9]+)"), 1)
    asked = phrases.select(*keys, "phrase", words.alias("_w")).where(F.size("_w") > 0)
    wanted = asked.select("_w").distinct()
    told = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_w")).alias("longest"), F.array_sort(F.collect_set(F.least(F.size("_w"), F.lit(LEAD)))).alias("leads")).first()
    led = lambda words, at, n: F.xxhash64(*(F.get(words, at + k) for k in range(n)))
    leads = told["leads"] or [1]  # 1 to LEAD
    by_size = F.coalesce(*(F.when(F.size("_w") == n, led("_w", F.lit(0), n)) for n in leads if n < LEAD), led("_w", F.lit(0), LEAD))
    wanted = wanted.select("_w", by_size.alias("_h"))
    few = told["n"] <= MOST_PHRASES
    texts = articles.select("doc_id", F.regexp_extract_all(body(articles), F.lit("([a-z0-9]+)"), 1).alias("_t"))
    places = texts.select("doc_id", "_t", F.posexplode("_t").alias("_i", "_first"))
    next_words = F.slice("_t", F.col("_i") + 1, F.lit(told["longest"] or 1))
    keyed = places.select("doc_id", "_t", "_i", F.explode(F.array(*(led("_t", F.col("_i"), n) for n in leads))).alias("_h"))
    if few:
        got = keyed.join(F.broadcast(wanted), "_h").where(F.slice("_t", F.col("_i") + 1, F.size("_w")) == F.col("_w"))
    else:  # a dealt row has no whole text
        got = keyed.select("doc_id", "_h", next_words.alias("_t")).join(wanted, "_h").where(F.slice("_t", F.lit(1), F.size("_w")) == F.col("_w"))
    hits = got.select("_w", "doc_id")
    return asked.join(hits.distinct(), "_w").select(*keys, "phrase", "doc_id")


def excerpts(docs: DataFrame, order: list[str], *by: str, most_docs: int = 12, most_chars: int = 6000, most_abstract: int = 400) -> DataFrame:
    """(by..., excerpt): ``- title. abstract`` of the first documents, abstracts cut, whole entries until the budget is used; a missing part is empty."""
    w = Window.partitionBy(*by).orderBy(*order)
    entry = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce(F.substring("abstract", 1, most_abstract), F.lit("")))
    rows = docs.select(*by, F.row_number().over(w).alias("_k"), entry.alias("_e")).where(F.col("_k") <= most_docs)
    used = F.sum(F.length("_e")).over(Window.partitionBy(*by).orderBy("_k")) - F.length("_e")
    kept = rows.withColumn("_u", used).where(F.col("_u") < most_chars)
    listed = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", "_e"))).alias("l"))
    return listed.select(*by, F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), F.trim(x["_e"]))), "\n").alias("excerpt"))
