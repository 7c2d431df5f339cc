"""Column expressions: keyed hashing, rounding, text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed(key: Column | str, seed: Column | int | str) -> Column:
    """A 32-bit number from md5 of ``key|seed``: any engine with md5 draws the same."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string"))), 1, 8), 16, 10).cast("bigint")


def lowered(text: Column | str) -> Column:
    """Lower case letter by letter: a dotted capital I (U+0130) is an i, not an i and a mark that would split its word."""
    return F.lower(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\u0130"), F.lit("i")))


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def phrase(text: Column) -> Column:
    """Alphanumeric tokens joined by a space, quoted; nothing left: two quotes."""
    return F.concat(F.lit('"'), F.array_join(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1), " "), F.lit('"'))


def safe_key(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w.-]+", "_")


def title_token_member(text: Column, token: str) -> Column:
    return F.coalesce(F.array_contains(F.split(text, " "), token), F.lit(False))


def contains_ci(text: Column, part: str) -> Column:
    return F.coalesce(F.lower(text).contains(part.lower()), F.lit(False))


def covariate(values: Column, kind: str) -> Column:
    """``number``: cast or null; ``e4``: how many 4s a genotype has."""
    if kind == "number":
        return F.expr("try_cast(_v as double)") if values is None else values.try_cast("double")
    return F.when(values.isNotNull(), F.length(F.regexp_replace(values, "[^4]", ""))).cast("double")


def trailing_integer(text: Column) -> Column:
    """The integer at the end of a label, a million where there is none."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)$", 1).try_cast("int"), F.lit(1_000_000))
