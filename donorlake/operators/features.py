"""Donor features: composition, pseudobulk, pooled embeddings; prototypes and similarity scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composition(obs: DataFrame, vocabulary: DataFrame | None = None, kind: str = "cell_type") -> DataFrame:
    """(donor_id, type, fraction) of a donor's cells, zeros left out.

    With a vocabulary (the train types) other types vanish and fractions may sum
    to less than 1: they are shares of all of the donor's cells.
    """
    counts = obs.groupBy("donor_id", F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("donor_id").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "donor_id").select("donor_id", "type", (F.col("n") / F.col("total")).alias("fraction"))
    return shares.join(vocabulary, "type", "left_semi") if vocabulary is not None else shares


def composition_wide(obs: DataFrame, types: list[str]) -> DataFrame:
    """A column per type of a frozen vocabulary, zeros filled in."""
    return obs.groupBy("donor_id").agg(*(F.avg(F.when(F.col("cell_type") == t, 1.0).otherwise(0.0)).alias(t) for t in types))


#: Types that become columns at most; more are an error.
MOST_TYPES = 2_000


def train_types(obs: DataFrame, split: DataFrame, kind: str = "cell_type") -> list[str]:
    """The known types of train donors' cells, in their order: the columns of ``composition_wide``, in which types that only test donors have don't count."""
    rows = obs.join(split.where("not is_test").select("donor_id"), "donor_id", "left_semi").where(F.col(kind).isNotNull()).select(kind).distinct().limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types")
    return sorted(r[0] for r in rows)


def composition_region(obs: DataFrame) -> DataFrame:
    """Fractions of type@region; no rows where there are fewer than two regions."""
    two = obs.agg(F.count_distinct("region").alias("n")).where("n >= 2")
    keyed = obs.withColumn("cell_type", F.concat_ws("@", "cell_type", "region"))
    return composition(keyed).join(two.select(F.lit(True).alias("_ok")), F.lit(True), "left_semi")


def pseudobulk(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """(donor_id, gene, mean) over all of the donor's cells, zeros included; genes a donor lacks have no row."""
    sizes = obs.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n_cells"))
    sums = expr.join(obs.select("cell_id", "donor_id"), "cell_id").groupBy("donor_id", "gene").agg(F.sum("value").alias("s"))
    return sums.join(sizes, "donor_id").select("donor_id", "gene", (F.col("s") / F.col("n_cells")).alias("mean"))


def pooled(emb: DataFrame, by: list[str] = ["donor_id"], q: float | None = None) -> DataFrame:  # noqa: B006
    """(by..., dim, value): mean or exact quantile of each dimension over the group's cells."""
    flat = emb.select(*by, F.posexplode("embedding").alias("dim", "x"))
    agg = F.avg("x") if q is None else F.percentile("x", F.lit(q))
    return flat.groupBy(*by, "dim").agg(agg.alias("value"))


def as_vectors(flat: DataFrame, *by: str) -> DataFrame:
    """(by..., embedding) of (by..., dim, value)."""
    listed = flat.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("l"))
    return listed.select(*by, F.transform("l", lambda x: x["value"]).alias("embedding"))


def attention_pooled(emb: DataFrame, v: list[list[float]], w: list[float], by: str = "donor_id") -> DataFrame:
    """Gated-attention forward pass with given weights: softmax over a donor's cells of wᵀ tanh(V h)."""
    h = F.col("embedding")

    def dot(weights: list[float]) -> Column:
        return F.aggregate(F.zip_with(h, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    score = reduce(lambda a, b: a + b, [F.lit(c) * F.tanh(dot(row)) for c, row in zip(w, v)])
    scored = emb.select(by, "cell_id", "embedding", F.exp(score).alias("a"))
    flat = scored.select(by, "a", F.posexplode("embedding").alias("dim", "x"))
    return flat.groupBy(by, "dim").agg((F.sum(F.col("a") * F.col("x")) / F.sum("a")).alias("value"))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """(label, code): sorted distinct labels from 0."""
    from pyspark.sql import Window

    return df.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def zero_shot(emb: DataFrame, bank: DataFrame) -> DataFrame:
    """(cell_id, predicted): the class of ``bank(class, vector)`` with the largest cosine, ties to the smaller class.

    The bank has a row per class and becomes one array literal of one row, so
    each cell is scored in place.
    """
    one = bank.agg(F.array_sort(F.collect_list(F.struct(F.col("class").alias("class"), F.col("vector").alias("vector")))).alias("bank"))
    scored = emb.join(F.broadcast(one)).select("cell_id", F.transform("bank", lambda c: F.struct(F.round(cosine(F.col("embedding"), c["vector"]), 9).alias("s"), c["class"].alias("c"))).alias("l"))
    best = F.array_max(F.transform("l", lambda x: x["s"]))
    return scored.select("cell_id", F.filter("l", lambda x: x["s"] == best)[0]["c"].alias("predicted"), best.alias("similarity"))


def onehot_prototypes(df: DataFrame, label: str, dim: int = 0) -> DataFrame:
    """(label, vector): unit vectors over the sorted labels, at least ``dim`` long."""
    codes = encode_labels(df, label)
    n = codes.agg(F.count(F.lit(1)).alias("n"))  # one row
    return codes.join(F.broadcast(n)).select(label, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n").cast("int"), F.lit(dim)) - 1), lambda i: F.when(i == F.col("code"), 1.0).otherwise(0.0)).alias("vector"))


def random_prototypes(df: DataFrame, label: str, dim: int, seed: int) -> DataFrame:
    """Unit vectors of keyed-hash coordinates in (-1, 1)."""
    from ..functions.scalar import keyed

    raw = df.select(label).distinct().select(label, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: keyed(F.concat_ws("#", F.col(label).cast("string"), i.cast("string")), seed) / F.lit(2.0**31) - 1).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.select(label, F.transform("v", lambda x: x / norm).alias("vector"))


def soft_ordinal(levels: DataFrame, tau: float) -> DataFrame:
    """(a, b, weight): softmax over levels b of -|a - b| / tau; levels below 0 take no part."""
    from pyspark.sql import Window

    known = levels.select("level").distinct().where("level >= 0")
    grid = known.select(F.col("level").alias("a")).join(F.broadcast(known.select(F.col("level").alias("b"))))  # a row per level
    e = F.exp(-F.abs(F.col("a") - F.col("b")) / tau)
    return grid.select("a", "b", (e / F.sum(e).over(Window.partitionBy("a"))).alias("weight"))


def infonce(rows: DataFrame, temperature: float, *by: str) -> DataFrame:
    """(by..., loss): symmetric cross entropy of the cosine matrix of each training batch (by..., i, x, y); a batch has some hundreds of rows."""
    left, right = rows.select(*by, "i", "x"), rows.select(*by, F.col("i").alias("j"), "y")
    pairs = left.join(right, list(by)) if by else left.join(right)
    s = pairs.select(*by, "i", "j", (cosine(F.col("x"), F.col("y")) / temperature).alias("s"))
    row = s.groupBy(*by, F.col("i").alias("k")).agg(F.log(F.sum(F.exp("s"))).alias("r"))
    col = s.groupBy(*by, F.col("j").alias("k")).agg(F.log(F.sum(F.exp("s"))).alias("c"))
    own = s.where("i = j").select(*by, F.col("i").alias("k"), "s")
    return own.join(row, [*by, "k"]).join(col, [*by, "k"]).groupBy(*by).agg(F.avg((F.col("r") + F.col("c")) / 2 - F.col("s")).alias("loss"))
