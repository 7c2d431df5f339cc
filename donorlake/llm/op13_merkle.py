"""Merkle manifest of a table: a tree of digests for each source, and one over the sources.

Nodes are rows (tree, i, digest).  A level is made by self-joins: a node's
siblings have computed indices (i XOR 1 in a binary tree, else the run's first
index plus the other slots), so each of them is one equijoin on (tree, index).
The rows of slot zero then know their whole run and emit the parents.  The
joined rows keep what stands left and right of each node; handed down from the
root, level by level, these are the proofs.

Every level is a written table, of a third of the rows of the one below.  No
source is gathered in a task: leaves are put in order by ranges of (source,
doc_id, digest), and a leaf's index is its place in its range plus the sum of
its source's rows in earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows (two numbers, a name) up to which the table of runs is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: ``monotonically_increasing_id``: the partition above this bit, the place below.
_PART_BIT = 33


def encoded(value: Column) -> Column:
    """``-`` for null, else count of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _runs(rows: DataFrame, group: str) -> DataFrame:
    """For each range and group of ``rows(group, at)`` in order: the first place there, rows in earlier ranges, rows in all, and the group's number in ascending order (null first)."""
    runs = rows.groupBy(F.shiftright("at", _PART_BIT).alias("part"), group).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    runs = common.materialize(runs, "merkle-runs")
    mine = Window.partitionBy(group)
    runs = runs.withColumn("ahead", F.coalesce(F.sum("rows").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("rows").over(mine))
    # groups by the range where they begin; a row for each range at most stands in the one window without a key
    begun = runs.where("ahead = 0").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1)
    before = begun.groupBy("part").agg(F.count("*").alias("groups"))
    before = before.select("part", F.coalesce(F.sum("groups").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = begun.join(before, "part").select(F.col(group).alias("_group"), (F.col("before") + F.col("place")).alias("tree"))
    return runs.join(number, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def ordered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``tree`` (number of the group in ascending order), ``i`` (index in the group, by ``order``) and ``n`` (its rows)."""
    spark = rows.sparkSession
    keys = [group, *order]
    dealt = rows.repartitionByRange(common.shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = common.materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-ordered")
    runs = common.materialize(_runs(placed, group), "merkle-run-places").select(F.col("part").alias("_part"), F.col(group).alias("_group"), "first", "ahead", "n", "tree")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    found = placed.join(runs, (F.shiftright("at", _PART_BIT) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("i", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "first", "ahead", "_part", "_group")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(tree, i, n, d)`` of trees with more than one node, with the digests ``left`` and ``right`` of each in its run (empty: none)."""
    slot = F.pmod("i", F.lit(arity))
    rows = nodes.where("n > 1")
    other = rows.select("tree", "i", "d")
    for k in range(1, arity):
        index = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("i") - slot + F.pmod(slot + k, F.lit(arity))
        side = other.select(F.col("tree").alias("_tree"), F.col("i").alias("_i"), F.col("d").alias(f"d{k}"))
        rows = rows.join(side, (F.col("tree") == F.col("_tree")) & (index == F.col("_i")), "left").drop("_tree", "_i")
    sibling = lambda at: F.coalesce(*(F.when(F.pmod(slot + k, F.lit(arity)) == at, F.col(f"d{k}")) for k in range(1, arity)))
    left = F.concat(*(F.when(F.lit(at) < slot, F.coalesce(sibling(at), F.lit(""))).otherwise("") for at in range(arity)))
    right = F.concat(*(F.when(F.lit(at) > slot, F.coalesce(sibling(at), F.lit(""))).otherwise("") for at in range(arity)))
    return rows.withColumn("left", left).withColumn("right", right).drop(*(f"d{k}" for k in range(1, arity)))


def levels(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The written levels (tree, i, n, d, left, right) of all trees over ``leaves(tree, i, n, d)``, lowest first, and (tree, d, height) of their roots; extra columns stay in the lowest."""
    made, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots = nodes.where("n = 1").select("tree", "d", F.lit(0).alias("height"))
    while most > 1:
        made.append(common.materialize(with_siblings(nodes, arity), "merkle-level"))
        up = made[-1].where(F.pmod("i", F.lit(arity)) == 0)
        nodes = up.select("tree", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest(F.col("d"), F.col("right")).alias("d"))
        most = -(-most // arity)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "d", F.lit(len(made)).alias("height")))
    return made, common.materialize(roots, "merkle-roots")


_NONE = "cast(array() as array<struct<left:string,right:string>>)"


def handed_down(made: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves of trees of more than one node with ``path``: siblings (left, right) from the leaf to the end of ``tops(tree, height, path, ...)``, whose other columns come along."""
    keep = [c for c in tops.columns if c not in ("tree", "height", "path")]
    above = None
    for k in range(len(made) - 1, -1, -1):
        ends = tops.where(F.col("height") == k + 1).select("tree", F.lit(0).cast("long").alias("i"), "path", *keep)
        above = (ends if above is None else ends.unionByName(above)).select(F.col("tree").alias("_tree"), F.col("i").alias("_i"), F.col("path").alias("_path"), *keep)
        rows = made[k].join(above, (F.col("tree") == F.col("_tree")) & (F.expr(f"i div {arity}") == F.col("_i")))
        rows = rows.withColumn("path", F.concat(F.array(F.struct("left", "right")), F.col("_path"))).drop("_tree", "_i", "_path")
        above = rows.select("tree", "i", "path", *keep) if k else rows
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, as one text of digests."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def leaves(docs: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, ...) of ``docs``; ``keep`` are further columns."""
    rows = docs.select(*COLUMNS)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest(*(encoded(F.col(c)) for c in COLUMNS)).alias("leaf"), *(c.alias(n) for n, c in (keep or {}).items()))


def manifest(docs: DataFrame, arity: int = ARITY, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, ...): the digests of each row of ``docs`` and its proof.

    Leaves stand by doc_id in their source (null first), rows of one doc_id by
    digest; rows that are equal in all columns are leaves of their own with
    equal digests.  Sources stand in the order of their UTF-8 bytes, null
    first; null values have their own mark in the digest.  Columns besides
    ``COLUMNS`` are ignored; an empty table gives no rows.  ``keep`` are
    further columns made from a row of ``docs``.
    """
    rows = common.materialize(leaves(docs, keep), "merkle-leaves")
    low = common.materialize(ordered(rows, "source", "doc_id", "leaf").withColumn("d", F.col("leaf")), "merkle-leaves")
    made, subroots = levels(low, arity)
    trees = subroots.count()
    high = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").cast("long").alias("i"), F.lit(trees).cast("long").alias("n"), "d", "height")
    upper, roots = levels(high, arity)
    root = roots.select("tree", "height", F.expr(_NONE).alias("path"), F.col("d").alias("root"))
    if upper:
        tops = handed_down(upper, root, arity)
    else:
        tops = high.join(root.drop("height"), "tree")
    tops = common.materialize(tops.select(F.col("i").alias("tree"), "height", "path", F.col("d").alias("subroot"), "root"), "merkle-subroots")
    out = ["doc_id", "source", "leaf", "subroot", "root", "path", *(keep or {})]
    single = low.where("n = 1").join(tops.where("height = 0").drop("height"), "tree").select(*out)
    return single.unionByName(handed_down(made, tops, arity).select(*out)) if made else single


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of all documents, and the check of each with half of them tampered (see manifest for nulls, ties and empty tables)."""
    docs = common.read_table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.when(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    shown = digest(*(encoded(tampered if c == "text" else F.col(c)) for c in COLUMNS))
    made = manifest(docs, ARITY, {"shown": shown}).withColumn("folded_root", folded(F.col("shown"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels of the trees over leaves(tree, i, n, d), and (tree, i, n, path) of the leaves."""
    return f"""
{name} AS (
  SELECT 0 AS h, tree, i, n, d FROM {leaves}
  UNION ALL
  SELECT h + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY h, tree, i // 3, n
), {name}_sides AS (
  SELECT h, tree, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sides
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY h, tree, i // 3 ORDER BY i)
), {name}_paths AS (
  SELECT x.tree, x.i, list(s.sides ORDER BY s.h) FILTER (WHERE s.h IS NOT NULL) AS path
  FROM {leaves} x LEFT JOIN {name}_sides s ON s.tree = x.tree AND s.i = x.i // CAST(3 ** s.h AS BIGINT) GROUP BY x.tree, x.i
)"""


def _leaf_sql(text: str) -> str:
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: The same in SQL: levels by recursion, paths by climbing; DuckDB has no crc32, so it is a fold over eight steps of each digit of doc_id.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT *, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1),
    lambda k: [CAST(ascii(coalesce(CAST(doc_id AS VARCHAR), '')[k]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) AS c FROM documents
), rows_ AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql("CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS shown FROM crc
), low AS (
  SELECT *, leaf AS d, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM rows_
), {_tree_sql('one', 'low')}, high AS (
  SELECT 0 AS tree, tree AS i, (SELECT count(DISTINCT tree) FROM low) AS n, d FROM one WHERE n = 1
), {_tree_sql('all_', 'high')}, found AS (
  SELECT low.doc_id, leaf, shown, high.d AS subroot, (SELECT d FROM all_ WHERE n = 1) AS root,
         list_concat(coalesce(one_paths.path, []), coalesce(all__paths.path, [])) AS path
  FROM low JOIN one_paths ON one_paths.tree = low.tree AND one_paths.i = low.i JOIN high ON high.i = low.tree JOIN all__paths ON all__paths.i = low.tree
), ended AS (
  SELECT *, list_reduce(list_prepend(shown, path), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root FROM found
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ended
"""
