"""Captions from expression and markers, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_unique
from .markers import top_expressed

#: Names of settings that hold a secret; a separator and a value follow: 12 or more signs in quotes, or 16 or more without.
SECRET_NAMES = ("access key", "api key", "auth token", "client secret", "passwd", "password", "private key", "secret", "token")
_NAMES = "|".join(n.replace(" ", "[-_. ]?") for n in SECRET_NAMES)
_VALUES = "|".join([r"\x22[^\x22\s]{12,}\x22", r"\x27[^\x27\s]{12,}\x27", r"[A-Za-z0-9+/_.~-]{16,}"])

#: A named secret, a key or a token (fixed values: the published shapes of such strings).
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "hub_token": r"\bhf_[A-Za-z0-9]{20,}\b",
    "git_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "api_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "assignment": rf"(?i)(?:^|[^A-Za-z0-9])(?:{_NAMES})[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}(?:{_VALUES})",
}
BARE_HEX = r"\b[a-f0-9]{40}\b"
#: Signs that excuse a bare hex string in the 80 characters before it: parts of cache and object paths, or a field whose name says that it is an identifier (fixed values).
SAFE_PATHS = ("snapshots/", ".lock", "models--", ".no_exist/", "hf_cache/", "blobs/", ".git/", "pack-", "objects/")
SAFE_NAMES = ("sha", "hash", "rev", "ref", "snapshot", "commit", "git", "version")
SAFE_FIELD = r"(?i)(?:" + "|".join(SAFE_NAMES) + r")\w*[\x22\x27\s]*[:=]"
HEX_CONTEXT = 80


def gene_list(values: DataFrame, n: int, *by: str) -> DataFrame:
    """(by..., genes) of ranked rows, joined by comma and space."""
    listed = values.where(F.col("rank") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "gene"))).alias("l"))
    return listed.select(*by, F.array_join(F.transform("l", lambda x: x["gene"]), ", ").alias("genes"))


def cell_caption(genes: Column, label: Column | None = None, tissue: str = "blood") -> Column:
    """What a cell is (its label, where one is given and known) and the genes that it expresses most."""
    what = F.lit(f"A cell from human {tissue}.")
    if label is not None:
        what = F.coalesce(F.concat(F.lit("A "), label, F.lit(f" cell from human {tissue}.")), what)
    return F.concat(what, F.lit(" Highly expressed genes: "), F.coalesce(genes, F.lit("none detected")), F.lit("."))


def own_gene_captions(expr: DataFrame, obs: DataFrame, n: int, with_label: bool, tissue: str = "blood") -> DataFrame:
    """(cell_id, caption): a cell without expressed genes says so."""
    genes = gene_list(top_expressed(expr, n), n, "cell_id")
    rows = obs.select("cell_id", "cell_type").join(genes, "cell_id", "left")
    return rows.select("cell_id", cell_caption(F.col("genes"), F.col("cell_type") if with_label else None, tissue).alias("caption"))


def class_captions(markers: DataFrame, n: int) -> DataFrame:
    """(class, caption) in prose from ranked markers."""
    return gene_list(markers, n, "class").select("class", F.concat(F.col("class"), F.lit(" cells are marked by the expression of "), "genes", F.lit(".")).alias("caption"))


def build_captions(mode: str, obs: DataFrame, expr: DataFrame | None = None, captions: DataFrame | None = None, n: int = 10, with_label: bool = True, tissue: str = "blood") -> DataFrame:
    """(cell_id, caption) by mode: ``own_genes`` needs expr; ``type_markers`` and ``type_text`` need captions(class, caption)."""
    if mode == "own_genes":
        if expr is None:
            raise ValueError("own_genes needs expression")
        return own_gene_captions(expr, obs, n, with_label, tissue)
    if mode not in ("type_markers", "type_text"):
        raise ValueError(f"unknown mode: {mode}")
    if captions is None:
        raise ValueError(f"{mode} needs captions")
    named = captions.select(F.col("class").alias("cell_type"), F.col("caption"))
    return obs.select("cell_id", "cell_type").join(named, "cell_type", "left").select("cell_id", F.coalesce("caption", F.lit("No description.")).alias("caption"))


def copied_captions(classes: DataFrame, captions: DataFrame, missing: str = "fail") -> DataFrame:
    """Captions of the classes; a class without one is an error, or with ``missing="name"`` is captioned by its name."""
    got = classes.select("class").join(captions, "class", "left")
    if missing == "fail" and not got.where("caption is null").isEmpty():
        raise ValueError("classes without caption")
    return got.withColumn("caption", F.coalesce("caption", "class"))


def caption_genes(caption: Column) -> Column:
    """The genes of a caption: between "expression of" (or a colon) and the next point or newline, trimmed, empty ones left out."""
    found = F.regexp_extract(caption, r"(?:expression of|genes:)\s*([^.\n]*)", 1)
    return F.filter(F.transform(F.split(found, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def strip_label(text: Column, label: str) -> tuple[Column, Column]:
    """The text with a label replaced by "this cell type", and whether it was there, any case."""
    import re

    pattern = "(?i)" + re.escape(label)
    return F.regexp_replace(text, pattern, "this cell type"), text.rlike(pattern)


def _bare_hex(text: Column) -> Column:
    """Whether a text has a 40-digit hex string that nothing in the 80 characters before it excuses."""
    between, found = F.split(text, BARE_HEX, -1), F.regexp_extract_all(text, F.lit(f"({BARE_HEX})"), 1)

    def excused(i: Column) -> Column:  # two such strings and what lies between are over 80 characters
        near = [F.get(between, i - 2), F.get(found, i - 2), F.get(between, i - 1), F.get(found, i - 1), F.get(between, i)]
        before = F.right(F.concat(*(F.coalesce(x, F.lit("")) for x in near)), F.lit(HEX_CONTEXT))
        named = before.rlike(SAFE_FIELD)
        for path in SAFE_PATHS:
            named = named | before.contains(path)
        return named

    return F.exists(F.transform(found, lambda _, i: excused(i)), lambda x: ~x)


def secret_scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of texts with a secret; a bare 40-digit hex string counts unless the 80 characters before it say that it is an identifier."""
    kinds = [F.when(F.col(text).rlike(p), F.lit(k)) for k, p in SECRETS.items()]
    kinds.append(F.when(F.col(text).rlike(BARE_HEX) & _bare_hex(F.col(text)), F.lit("bare_hex")))
    return docs.select(key, F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def caption_set(mode: str, classes: DataFrame, markers: DataFrame | None = None, source: DataFrame | None = None, n: int = 10, missing: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Captions (class, caption) of ``classes(class)`` and one row that says where they come from.

    ``markers`` writes prose from ranked markers of train cells, ``name`` takes
    the class names, ``copy`` takes those of ``source(class, caption)``; a class
    without one fails, or with ``missing="name"`` is captioned by its name.
    The row: mode, fit_scope, n_classes, n_missing, missing (classes that have
    no own caption), source_sha256 (null where there is no source) and
    captions_sha256, digests of the sorted digests of the rows, so that neither
    order nor partitions matter.  Classes are few: a row for each is gathered.
    """
    known = classes.select("class").where("class is not null").distinct()
    if mode == "markers":
        if markers is None:
            raise ValueError("markers mode needs markers")
        own, scope = class_captions(markers, n), "train_cells_only"
    elif mode == "name":
        own, scope = known.withColumn("caption", F.col("class")), "none"
    elif mode == "copy":
        if source is None:
            raise ValueError("copy mode needs a source")
        own, scope = require_unique(source.select("class", "caption"), "class"), "source"
    else:
        raise ValueError(f"unknown mode: {mode}")
    lacking = known.join(own.where("caption is not null"), "class", "left_anti")
    got = copied_captions(known, own, missing)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.to_json(F.struct("class", "caption"), {"ignoreNullFields": "false"}), 256))), ""), 256)
    taken = (source.select("class", "caption") if mode == "copy" else got.limit(0)).agg(F.when(F.lit(mode == "copy"), digest).alias("source_sha256"))
    told = got.agg(F.count(F.lit(1)).alias("n_classes"), digest.alias("captions_sha256")).join(lacking.agg(F.count(F.lit(1)).alias("n_missing"), F.array_sort(F.collect_list("class")).alias("missing"))).join(taken)
    return got, told.select(F.lit(mode).alias("mode"), F.lit(scope).alias("fit_scope"), "n_classes", "n_missing", "missing", "source_sha256", "captions_sha256")


def prompt(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` places."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(head), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))
