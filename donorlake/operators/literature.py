"""Retrieval arms as runs: a ladder of queries for each type, search, pooling, re-ranking, captions, figures.

Markers, names and aliases are a few rows for each type and stand on the driver;
everything that reads documents is a job over the stored index and the pooled
documents.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_unique
from ..sources import shared
from . import fulltext, retrieve
from .retrieve import ARMS

#: Words of the two contexts (fixed values).
IMMUNE_CONTEXT = ("lymphocyte", "leukocyte", "immune", "immunity", "pbmc", "peripheral blood", "bone marrow", "spleen", "cytotoxic", "antibody", "myeloid", "hematopoietic", "cytokine", "lineage")
NEURAL_CONTEXT = (
    "neuron", "neuronal", "cortex", "cortical", "brain", "synaptic", "synapse", "glia", "glial", "astrocyte", "oligodendrocyte", "microglia", "interneuron",
    "pyramidal", "myelin", "axon", "dendrite", "neurotransmitter", "forebrain", "hippocampus", "alzheimer", "dementia",
)
#: Subject headings of cell types (fixed values).
MESH_HINTS = {
    "B cell": "B-Lymphocytes",
    "CD4-positive, alpha-beta T cell": "CD4-Positive T-Lymphocytes",
    "CD8-positive, alpha-beta T cell": "CD8-Positive T-Lymphocytes",
    "classical monocyte": "Monocytes",
    "intermediate monocyte": "Monocytes",
    "non-classical monocyte": "Monocytes",
    "monocyte": "Monocytes",
    "macrophage": "Macrophages",
    "erythrocyte": "Erythrocytes",
    "natural killer cell": "Killer Cells, Natural",
    "mature NK T cell": "Natural Killer T-Cells",
    "neutrophil": "Neutrophils",
    "plasma cell": "Plasma Cells",
    "platelet": "Blood Platelets",
    "hematopoietic precursor cell": "Hematopoietic Stem Cells",
    "naive thymus-derived CD4-positive, alpha-beta T cell": "CD4-Positive T-Lymphocytes",
}

#: Words of four stages of a disease, from low to high, and of the scales that grade it (fixed values).
SEVERITY_TERMS = (
    ("cognitively normal", "healthy aging", "non-demented control", "neuropathology-free", "normal aging brain"),
    ("mild cognitive impairment", "prodromal Alzheimer", "early-stage Alzheimer", "incipient pathology"),
    ("moderate Alzheimer disease", "established Alzheimer pathology", "intermediate neurofibrillary"),
    ("severe Alzheimer disease", "advanced Alzheimer pathology", "end-stage dementia", "high neuropathologic change"),
)
CORE_TERMS = {
    "adnc": ("Alzheimer disease neuropathologic change", "amyloid plaque", "neurofibrillary tangle", "tau pathology", "neuritic plaque"),
    "braak": ("neurofibrillary tangle", "tau hyperphosphorylation", "Braak staging", "transentorhinal cortex", "tau propagation"),
    "cerad": ("neuritic plaque", "CERAD", "senile plaque density", "amyloid deposition cortex"),
    "cognitive": ("cognitive decline", "memory impairment", "dementia severity", "cognitive trajectory aging"),
    "cps": ("cortical pathology burden", "amyloid beta cortical", "tau cortical", "global neuropathology"),
    "thal": ("Thal phase", "amyloid phase", "beta-amyloid deposition", "diffuse plaque", "amyloid spread"),
    "rosmap": ("Alzheimer disease neuropathology", "amyloid plaque", "neurofibrillary tangle", "tau pathology", "microglial activation Alzheimer"),
}
OTHER_CORE = ("Alzheimer disease neuropathology",)


def quoted(term: str) -> str:
    """The term as a phrase of the query language, without what would break it."""
    return '"' + " ".join(re.findall("[A-Za-z0-9]+", term)) + '"'


def ladder(markers: Sequence[str], name: str | None = None, aliases: Mapping[str, Sequence[str]] | None = None, context: str = "cell", hints: Mapping[str, str] = MESH_HINTS) -> list[str]:
    """Queries for a type, from narrow to wide, each once: the first three markers; pairs of the first five; each of these in context; their aliases; the name and its subject heading."""
    some = [m for m in markers if m][:8]
    five = some[:5]
    steps = [" AND ".join(map(quoted, some[:3]))] if len(some) > 2 else []
    steps += [f"{quoted(a)} AND {quoted(b)}" for k, a in enumerate(five) for b in five[k + 1 :]]
    steps += [f"{quoted(m)} AND ({' OR '.join([quoted(context), *retrieve.CELL_WORDS])})" for m in five]
    for m in five:
        names = [m, *(aliases or {}).get(m, [])][:4]
        if len(names) > 1:
            steps.append(" OR ".join(map(quoted, names)))
    if name:
        steps += [quoted(name), f"{quoted(name)} AND {quoted('marker')}"]
        if name in hints:
            heading = f"mesh: {quoted(hints[name])}"
            steps += [heading] + ([f"{heading} AND {quoted(some[0])}"] if some else [])
    return list(dict.fromkeys(steps))


@dataclass
class Asked:
    """What is known of a type: train markers, curated ones, aliases of markers."""

    name: str
    markers: Sequence[str]
    curated: Sequence[str] = ()
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def of(self, arm: str) -> tuple[Sequence[str], Mapping[str, Sequence[str]]]:
        return self.curated if arm.startswith("rag_curated") else self.markers, self.aliases if arm.endswith("alias") else {}


def arm_queries(types: Sequence[Asked], arms: Sequence[str] = ARMS, hints: Mapping[str, str] = MESH_HINTS, context: str = "cell") -> dict[str, str]:
    """{"arm|number of the type|number": query}; a type without markers has none in that arm."""
    out = {}
    for arm in arms:
        for k, t in enumerate(types):
            markers, aliases = t.of(arm)
            if markers:
                for i, q in enumerate(ladder(markers, t.name if arm.startswith("rag_name") else None, aliases, context, hints)):
                    out[f"{arm}|{k}|{i:02d}"] = q
    return out


def phrase_share(text: Column, terms: Column) -> Column:
    """Share of ``terms``, arrays of names in lower case, of which a text has one as whole words in a row; no terms: 0."""
    padded = F.concat(F.lit(" "), F.array_join(fulltext.words(text), " "), F.lit(" "))
    has = F.filter(terms, lambda names: F.exists(names, lambda n: padded.contains(F.concat(F.lit(" "), n, F.lit(" ")))))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(has) / F.size(terms))


def without_named(text: Column, pattern: Column) -> Column:
    """A text without the sentences that match; a null pattern leaves it as it is."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\x01"), "\x01")
    return F.when(pattern.isNull(), text).otherwise(F.trim(F.array_join(F.filter(sentences, lambda s: ~F.regexp_like(s, pattern)), " ")))


def _plain(term: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", term.lower()))


def placed(pooled: DataFrame, articles: DataFrame, facts: DataFrame, keys: Sequence[str], context: Sequence[str]) -> DataFrame:
    """Pooled documents with their texts, coverage of ``terms`` and of the context, score, place among the ``keys`` (ties by doc_id) and n_pooled.

    ``facts`` has a row for each key, with ``terms``, an array of arrays of names.
    """
    text = F.concat_ws(" ", "title", "abstract", "mesh")
    told = shared.written(fulltext.gathered(pooled).join(articles.select("doc_id", "title", "abstract", "mesh"), "doc_id"), "pooled-texts").join(facts, list(keys))
    vocabulary = F.array(*(F.array(F.lit(_plain(w))) for w in context)) if context else F.expr("cast(array() as array<array<string>>)")
    told = told.withColumns({"coverage": phrase_share(text, F.col("terms")), "context": phrase_share(text, vocabulary)})
    score = F.round(10 * F.col("coverage") + 2 * F.col("context") + F.col("score_agg") + 0.01 * F.col("best"), 6)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return told.withColumn("score", score).withColumn("place", place).withColumn("n_pooled", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def runs(index: fulltext.Index, articles: DataFrame, types: Sequence[Asked], arms: Sequence[str] = ARMS, per_query: int = 40, pool: int = 60, most_chars: int = 1200, context: Sequence[str] = IMMUNE_CONTEXT, hints: Mapping[str, str] = MESH_HINTS, near: str = "cell", seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The arms' documents (arm, type, place, doc_id, hits, coverage, context, score, title, abstract) and figures (arm, type, ..., caption).

    All queries of all arms are one search; with ``seconds`` each is a job of
    its own under that budget, and those that it stops have no hits and are
    counted.  Documents are pooled over a type's queries, scored by 10 coverage
    + 2 context + sum of reciprocal ranks + 0.01 best score, ties by doc_id.
    The caption has the best documents' texts up to ``most_chars``, without the
    sentences that name the type in all arms but ``rag_name``.
    """
    spark = articles.sparkSession
    queries = arm_queries(types, arms, hints, near)
    if seconds is None:
        found = fulltext.search(index, fulltext.clauses(spark, queries), per_query)
        slow = spark.createDataFrame([], "query_id string, hits long, timed_out boolean")
    else:
        tables, slow = fulltext.within(spark, {q: (lambda q=q: fulltext.search(index, fulltext.clauses(spark, {q: queries[q]}), per_query)) for q in queries}, seconds)
        found = spark.createDataFrame([], "query_id string, doc_id long, score double, rank int")
        for t in tables.values():
            found = found.unionByName(t.select(found.columns))
    arm, number = F.split_part("query_id", F.lit("|"), F.lit(1)), F.split_part("query_id", F.lit("|"), F.lit(2)).cast("int")
    facts = []
    for a in arms:
        for k, t in enumerate(types):
            markers, aliases = t.of(a)
            terms = [[_plain(x) for x in (m, *aliases.get(m, ()))] for m in markers]
            name = re.findall("[A-Za-z0-9]+", t.name)
            pattern = None if a == "rag_name" or not name else r"(?i)\b" + r"\s+".join(f"{w}s?" for w in name) + r"\b"
            facts.append((a, k, t.name, terms, pattern, sum(q.startswith(f"{a}|{k}|") for q in queries)))
    facts = F.broadcast(spark.createDataFrame(facts, "arm string, k int, type string, terms array<array<string>>, pattern string, n_queries int"))  # a row for each arm and type
    pooled = retrieve.pooled_hits(found.withColumns({"arm": arm, "k": number}), "arm", "k").drop("queries")
    docs = placed(pooled, articles, facts, ["arm", "k"], context).where(F.col("place") <= pool)
    fragment = F.trim(without_named(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit(""))), F.col("pattern")))
    captions = retrieve.caption_budget(docs.withColumn("fragment", fragment), "fragment", ["place"], most_chars, "arm", "k")
    c = F.col("coverage")
    figures = docs.groupBy("arm", "k").agg(F.max("n_pooled").alias("n_pooled"), F.count(F.lit(1)).alias("n_returned"), F.count(F.when(c >= 0.5, 1)).alias("n_cov_half"), F.count(F.when(c >= 0.25, 1)).alias("n_cov_quarter"), F.avg(c).alias("mean_coverage"))
    stopped = slow.where("timed_out").groupBy(arm.alias("arm"), number.alias("k")).agg(F.count(F.lit(1)).alias("n_timeouts"))
    figures = facts.select("arm", "k", "type", "n_queries").where("n_queries > 0").join(figures, ["arm", "k"], "left").join(stopped, ["arm", "k"], "left").join(captions, ["arm", "k"], "left")
    figures = figures.na.fill(0, ["n_timeouts", "n_pooled", "n_returned", "n_cov_half", "n_cov_quarter", "mean_coverage"]).na.fill("", ["caption"])
    return docs.select("arm", "type", "place", "doc_id", "hits", "coverage", "context", "score", "title", "abstract"), figures.drop("k")


def severity_runs(
    index: fulltext.Index,
    articles: DataFrame,
    levels: DataFrame,
    core: Mapping[str, Sequence[str]] = CORE_TERMS,
    tiers: Sequence[Sequence[str]] = SEVERITY_TERMS,
    other: Sequence[str] = OTHER_CORE,
    per_query: int = 25,
    pool: int = 20,
    most_chars: int = 1200,
    context: Sequence[str] = NEURAL_CONTEXT,
    seconds: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents (scale, level, tier, place, doc_id, hits, coverage, context, score, title, abstract) and figures (scale, level, tier, ..., caption) of ordered levels.

    ``levels(scale, level, place)``, places from 0 in each scale; a repeated
    (scale, level) is an error.  A level's tier is its place in thirds of its
    scale, half-even rounded; its terms are those of the scale (``other``
    where ``core`` lacks it) and of the tier.  Each distinct term is searched
    once, as a phrase, however many levels share it; with ``seconds`` each is
    a job of its own under that budget.  Score, places and captions as in
    ``runs``; a level that finds nothing has figures and an empty caption.
    """
    spark = articles.sparkSession
    own = [(k, list(v)) for k, v in core.items()]
    n = F.count(F.lit(1)).over(Window.partitionBy("scale"))
    tier = retrieve.severity_tier(F.col("place"), n, len(tiers))
    byscale = F.broadcast(spark.createDataFrame(own, "scale string, core array<string>"))  # a row for each scale that has terms
    bytier = F.element_at(F.array(*(F.array(*map(F.lit, t)) for t in tiers)), F.col("tier") + 1)
    terms = F.array_distinct(F.concat(F.coalesce("core", F.array(*map(F.lit, other))), bytier))
    asked = require_unique(levels.select("scale", "level", "place"), "scale", "level").withColumn("tier", tier).join(byscale, "scale", "left").select("scale", "level", "tier", terms.alias("asked"))
    names = list(dict.fromkeys(t for group in (*core.values(), other, *tiers) for t in group))
    queries = {t: quoted(t) for t in names}
    if seconds is None:
        found = fulltext.search(index, fulltext.clauses(spark, queries), per_query)
        slow = spark.createDataFrame([], "query_id string, hits long, timed_out boolean")
    else:
        tables, slow = fulltext.within(spark, {q: (lambda q=q: fulltext.search(index, fulltext.clauses(spark, {q: queries[q]}), per_query)) for q in queries}, seconds)
        found = spark.createDataFrame([], "query_id string, doc_id long, score double, rank int")
        for t in tables.values():
            found = found.unionByName(t.select(found.columns))
    each = asked.select("scale", "level", F.explode("asked").alias("query_id"))
    pooled = retrieve.pooled_hits(each.join(found, "query_id"), "scale", "level").drop("queries")
    plain = F.transform("asked", lambda t: F.array(F.array_join(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1), " ")))
    facts = asked.select("scale", "level", "tier", plain.alias("terms"), F.size("asked").alias("n_queries"))
    docs = placed(pooled, articles, facts, ["scale", "level"], context).where(F.col("place") <= pool)
    entry = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit(""))))
    captions = retrieve.caption_budget(docs.withColumn("entry", entry), "entry", ["place"], most_chars, "scale", "level")
    figures = docs.groupBy("scale", "level").agg(F.max("n_pooled").alias("n_pooled"), F.count(F.lit(1)).alias("n_returned"), F.avg("coverage").alias("mean_coverage"))
    stopped = each.join(slow.where("timed_out"), "query_id").groupBy("scale", "level").agg(F.count(F.lit(1)).alias("n_timeouts"))
    keys = ["scale", "level"]
    figures = facts.drop("terms").join(figures, keys, "left").join(stopped, keys, "left").join(captions, keys, "left")
    figures = figures.na.fill(0, ["n_timeouts", "n_pooled", "n_returned", "mean_coverage"]).na.fill("", ["caption"])
    return docs.select("scale", "level", "tier", "place", "doc_id", "hits", "coverage", "context", "score", "title", "abstract"), figures
