"""Queries over the stored index: expressions, a budgeted ladder, retrieval arms; their SQL evaluates the same trees on padded texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import fulltext, literature, report
from ..operators.retrieve import ARMS
from ..sources import cohort
from .registry import query

#: Nested expressions; the corpus has invented words, and sources in the place of subject headings.
EXPRESSIONS = {
    "and": "ation AND thth",
    "precedence": "hend OR ation AND thth",
    "brackets": "(hend OR ation) AND thth",
    "not_first": "the AND ation NOT thth",
    "side_by_side": 'the ation "of the"',
    "field": "mesh: src3 AND (ation OR title: the)",
    "field_of_all": "mesh: (src1 OR src2) AND NOT_A_WORD OR abstract: \"and the\"",
    "deep": '((er OR la) AND (thing OR ("to the" NOT "in the"))) NOT (mesh: src0 OR hend)',
    "nothing": '"" OR zzzzzz',
    "twice": '"the" AND "THE"',
}
TYPES = [
    literature.Asked("thth erer", ["ation", "thth", "hend"], ["la", "ou"], {"ation": ["thing"], "hend": ["erer", "to the"]}),
    literature.Asked("la ou", ["la", "ou"], ["hend"], {"ou": ["oui"]}),
]
CONTEXT = ("er", "tion", "of the")
HINTS = {"thth erer": "src3"}
QUERIES = literature.arm_queries(TYPES, ARMS, HINTS, "er")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _searched(queries: dict[str, str]) -> str:
    """CTEs up to ``ranked(q, doc_id, score, rank)`` of the queries."""
    leaves: dict[tuple, int] = {}
    uses, tests = [], []

    def condition(q: str, node: fulltext.Node, counts: bool = True) -> str:
        if node.op == "LEAF":
            if not node.words:
                return "false"
            k = leaves.setdefault((node.words, node.field), len(leaves))
            uses.append(f"({_text(q)}, {k}, {str(counts).lower()})")
            return f"list_contains(ls, {k})"
        a, b = condition(q, node.children[0], counts), condition(q, node.children[1], counts and node.op != "NOT")
        return f"({a} AND NOT {b})" if node.op == "NOT" else f"({a} {node.op} {b})"

    for q, text in queries.items():
        tests.append(f"SELECT {_text(q)} AS q, doc_id FROM has WHERE {condition(q, fulltext.parse(text))}")
    padded = ", ".join(f"'  ' || array_to_string(regexp_extract_all(lower(coalesce({f}, '')), '[a-z0-9]+'), '  ') || '  ' AS {f}_" for f in fulltext.FIELDS)
    size = " + ".join(f"len(regexp_extract_all(lower(coalesce({f}, '')), '[a-z0-9]+'))" for f in fulltext.FIELDS)
    values = ", ".join(f"({k}, {_text(' ' + '  '.join(w) + ' ')}, {_text(f or '')})" for (w, f), k in leaves.items())
    count = " + ".join(f"CASE WHEN field IN ('', '{f}') THEN (length({f}_) - length(replace({f}_, p, ''))) // length(p) ELSE 0 END" for f in fulltext.FIELDS)
    return f"""tok AS (SELECT *, {padded}, {size} AS len FROM articles), leaf AS (SELECT * FROM (VALUES {values}) t(leaf, p, field)),
lh AS (SELECT * FROM (SELECT leaf, doc_id, len, {count} AS tf FROM tok, leaf) WHERE tf > 0),
has AS (SELECT doc_id, list(leaf) AS ls FROM lh GROUP BY doc_id), uses AS (SELECT * FROM (VALUES {', '.join(uses)}) t(q, leaf, counts)),
ldf AS (SELECT leaf, count(*) AS df FROM lh GROUP BY leaf), ln_ AS (SELECT count(*) AS n, avg(len) FILTER (len > 0) AS mean FROM tok),
lw AS (SELECT leaf, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) AS w FROM lh JOIN ldf USING (leaf), ln_),
sat AS ({' UNION ALL '.join(tests)}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT q, doc_id, round(sum(CASE WHEN counts THEN w ELSE 0 END), 6) AS score FROM sat JOIN uses USING (q) JOIN lw USING (leaf, doc_id) GROUP BY ALL))"""


@query(f"{cohort.sql('articles')}, {_searched(EXPRESSIONS)} SELECT q AS query_id, doc_id, round(score, 4) AS score, rank FROM ranked")
def fulltext_expressions(spark, root):
    """All documents that satisfy nested expressions."""
    found = fulltext.search(fulltext.stored(cohort.articles(spark, root)), fulltext.clauses(spark, EXPRESSIONS))
    return found.select("query_id", "doc_id", (F.round("score", 4) + 0.0).alias("score"), "rank")


_LADDER = {f"{i:02d}": q for i, q in enumerate(literature.ladder(TYPES[0].markers, TYPES[0].name, TYPES[0].aliases, "er", HINTS))}


@query(f"{cohort.sql('articles')}, {_searched(_LADDER)} SELECT q AS query_id, count(doc_id) AS hits, false AS timed_out FROM (VALUES {', '.join(f'({_text(q)})' for q in _LADDER)}) t(q) LEFT JOIN ranked USING (q) GROUP BY q")
def budgeted_ladder(spark, root):
    """Every query of a type's ladder as a job with a time budget of its own, and what became of it."""
    index = fulltext.stored(cohort.articles(spark, root))
    _, told = fulltext.within(spark, {q: (lambda text=text: fulltext.search(index, fulltext.clauses(spark, {"q": text}))) for q, text in _LADDER.items()}, 600.0)
    return told


def _runs_sql() -> str:
    facts, terms = [], []
    for a in ARMS:
        for k, t in enumerate(TYPES):
            markers, aliases = t.of(a)
            n = sum(q.startswith(f"{a}|{k}|") for q in QUERIES)
            name = t.name.split()
            facts.append(f"('{a}', {k}, {_text(t.name)}, {len(markers)}, {'NULL' if a == 'rag_name' else _text('(?i)' + chr(92) + 'b' + (chr(92) + 's+').join(w + 's?' for w in name) + chr(92) + 'b')}, {n})")
            terms += [f"('{a}', {k}, {i}, {_text(' ' + x.lower() + ' ')})" for i, m in enumerate(markers) for x in (m, *aliases.get(m, ()))]
    context = " + ".join(f"contains(b, {_text(' ' + c + ' ')})::INT" for c in CONTEXT)
    return f"""{cohort.sql('articles')}, {_searched(QUERIES)},
facts AS (SELECT * FROM (VALUES {', '.join(facts)}) t(arm, k, type, n_markers, pattern, n_queries)), terms AS (SELECT * FROM (VALUES {', '.join(terms)}) t(arm, k, i, x)),
pool AS (SELECT split_part(q, '|', 1) AS arm, CAST(split_part(q, '|', 2) AS INTEGER) AS k, doc_id, count(*) AS hits, max(score) AS best, sum(1.0 / rank) AS agg FROM ranked WHERE rank <= 20 GROUP BY ALL),
body AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(concat_ws(' ', title, abstract, mesh)), '[a-z0-9]+'), ' ') || ' ' AS b FROM articles),
cov AS (SELECT arm, k, doc_id, count(DISTINCT i) AS c FROM pool JOIN terms USING (arm, k) JOIN body USING (doc_id) WHERE contains(b, x) GROUP BY ALL),
told AS (SELECT pool.*, type, title, abstract, pattern, n_queries, coalesce(c, 0) / n_markers AS coverage, ({context}) / {len(CONTEXT)} AS context FROM pool JOIN facts USING (arm, k) JOIN body USING (doc_id) LEFT JOIN cov USING (arm, k, doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY arm, k ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY arm, k) AS n_pooled FROM (SELECT *, round(10 * coverage + 2 * context + agg + 0.01 * best, 6) AS score FROM told)),
docs AS (SELECT *, title || '. ' || abstract AS t FROM placed WHERE place <= 10),
frag AS (SELECT *, trim(CASE WHEN pattern IS NULL THEN t ELSE array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(s, pattern)), ' ') END) AS f FROM docs),
used AS (SELECT *, coalesce(sum(length(f)) OVER (PARTITION BY arm, k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM frag WHERE length(f) > 0),
cap AS (SELECT arm, k, string_agg(substr(f, 1, CAST(400 - u AS BIGINT)), ' ' ORDER BY place) AS caption FROM used WHERE u < 400 GROUP BY ALL)"""


@query(_runs_sql() + " SELECT arm, type, CAST(place AS INTEGER) AS place, doc_id, hits, round(coverage, 6) AS coverage, round(context, 6) AS context, round(score, 4) AS score FROM docs")
def retrieval_arms(spark, root):
    """The documents that each of six arms retrieves for each type."""
    docs, _ = _runs(spark, root)
    return docs.select("arm", "type", "place", "doc_id", "hits", r6("coverage").alias("coverage"), r6("context").alias("context"), (F.round("score", 4) + 0.0).alias("score"))


@query(_runs_sql() + """ SELECT facts.arm, facts.type, facts.n_queries, 0::BIGINT AS n_timeouts, coalesce(max(n_pooled), 0) AS n_pooled, count(docs.doc_id) AS n_returned, count(*) FILTER (coverage >= 0.5) AS n_cov_half, count(*) FILTER (coverage >= 0.25) AS n_cov_quarter, round(coalesce(avg(coverage), 0), 6) AS mean_coverage, coalesce(max(caption), '') AS caption
FROM facts LEFT JOIN docs USING (arm, k) LEFT JOIN cap USING (arm, k) WHERE facts.n_queries > 0 GROUP BY facts.arm, facts.type, facts.n_queries""")
def retrieval_arm_figures(spark, root):
    """Figures and caption of each arm and type."""
    _, figures = _runs(spark, root)
    return figures.withColumn("mean_coverage", r6("mean_coverage"))


def _runs(spark, root):
    articles = cohort.articles(spark, root)
    return literature.runs(fulltext.stored(articles), articles, TYPES, per_query=20, pool=10, most_chars=400, context=CONTEXT, hints=HINTS, near="er")


_CORE = {"one": ("ation", "of the", "thth"), "two": ("hend", "la")}
_TIERS = (("er", "to the"), ("ou",), ("thing", "in the"), ("erer", "and the", "er"))
_OTHER = ("the",)
_TERMS = {t: literature.quoted(t) for t in dict.fromkeys(t for g in (*_CORE.values(), _OTHER, *_TIERS) for t in g)}


def _severity_sql() -> str:
    core = ", ".join(f"({_text(k)}, [{', '.join(map(_text, v))}])" for k, v in _CORE.items())
    tiers = ", ".join(f"({k}, [{', '.join(map(_text, t))}])" for k, t in enumerate(_TIERS))
    context = " + ".join(f"contains(b, {_text(' ' + c + ' ')})::INT" for c in CONTEXT)
    return f"""{cohort.sql('articles')}, {_searched(_TERMS)},
lab AS (SELECT * FROM (SELECT 'one' AS scale, mesh AS level FROM articles UNION SELECT 'two', lang FROM articles UNION SELECT 'else', 'only' FROM articles) WHERE level IS NOT NULL),
lv AS (SELECT *, row_number() OVER (PARTITION BY scale ORDER BY coalesce(TRY_CAST(regexp_extract(level, '[0-9]+$') AS BIGINT), 1000000), level) - 1 AS place, count(*) OVER (PARTITION BY scale) AS n FROM lab),
tr AS (SELECT scale, level, CAST(round_even(place / greatest(n - 1, 1) * 3, 0) AS INTEGER) AS tier FROM lv),
asked AS (SELECT tr.*, list_distinct(coalesce(c.c, [{', '.join(map(_text, _OTHER))}]) || t.t) AS asked FROM tr LEFT JOIN (VALUES {core}) c(scale, c) USING (scale) JOIN (VALUES {tiers}) t(tier, t) USING (tier)),
each_ AS (SELECT scale, level, unnest(asked) AS q FROM asked),
pool AS (SELECT scale, level, doc_id, count(*) AS hits, max(score) AS best, sum(1.0 / rank) AS agg FROM each_ JOIN ranked USING (q) WHERE rank <= 25 GROUP BY ALL),
body AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(concat_ws(' ', title, abstract, mesh)), '[a-z0-9]+'), ' ') || ' ' AS b FROM articles),
told AS (SELECT pool.*, tier, len(list_filter(asked, lambda x: contains(b, ' ' || x || ' '))) / len(asked) AS coverage, ({context}) / {len(CONTEXT)} AS context, title, abstract FROM pool JOIN asked USING (scale, level) JOIN body USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY scale, level ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY scale, level) AS n_pooled FROM (SELECT *, round(10 * coverage + 2 * context + agg + 0.01 * best, 6) AS score FROM told)),
docs AS (SELECT *, trim(title || '. ' || abstract) AS f FROM placed WHERE place <= 10),
used AS (SELECT *, coalesce(sum(length(f)) OVER (PARTITION BY scale, level ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM docs WHERE length(f) > 0),
cap AS (SELECT scale, level, string_agg(substr(f, 1, CAST(600 - u AS BIGINT)), ' ' ORDER BY place) AS caption FROM used WHERE u < 600 GROUP BY ALL)"""


def _severity(spark, root):
    articles = cohort.articles(spark, root)
    scales = {"one": F.col("mesh"), "two": F.col("lang"), "else": F.lit("only")}
    ordered = [report.level_order(articles.select(label.alias("level")), "level", []).select(F.lit(scale).alias("scale"), "level", "place") for scale, label in scales.items()]
    levels = ordered[0].unionByName(ordered[1]).unionByName(ordered[2])
    return literature.severity_runs(fulltext.stored(articles), articles, levels, _CORE, _TIERS, _OTHER, pool=10, most_chars=600, context=CONTEXT)


@query(_severity_sql() + " SELECT scale, level, tier, CAST(place AS INTEGER) AS place, doc_id, hits, round(coverage, 6) AS coverage, round(context, 6) AS context, round(score, 4) AS score FROM docs")
def severity_tiers(spark, root):
    """The documents that each level of three scales retrieves by the terms of its scale and of its tier."""
    docs, _ = _severity(spark, root)
    return docs.select("scale", "level", "tier", "place", "doc_id", "hits", r6("coverage").alias("coverage"), r6("context").alias("context"), (F.round("score", 4) + 0.0).alias("score"))


@query(_severity_sql() + """ SELECT asked.scale, asked.level, asked.tier, len(asked) AS n_queries, 0::BIGINT AS n_timeouts, coalesce(max(n_pooled), 0) AS n_pooled, count(docs.doc_id) AS n_returned, round(coalesce(avg(coverage), 0), 6) AS mean_coverage, coalesce(max(caption), '') AS caption
FROM asked LEFT JOIN docs USING (scale, level) LEFT JOIN cap USING (scale, level) GROUP BY asked.scale, asked.level, asked.tier, len(asked)""")
def severity_captions(spark, root):
    """Figures and caption of each level."""
    return _severity(spark, root)[1].withColumn("mean_coverage", r6("mean_coverage"))
