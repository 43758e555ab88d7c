"""Text, path and number expressions of reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decision(c: Column) -> Column:
    """A reviewer's word without white space (of any kind) around it, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))


def run_parts(c: Column, mark: str = "-seed") -> Column:
    """Struct of model and seed: the text before and after the last mark (no mark: all and null)."""
    at = F.length(c) - F.locate(mark[::-1], F.reverse(c)) - len(mark) + 2
    has = c.contains(mark)
    return F.struct(F.when(has, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("model"), F.when(has, F.substring(c, at + len(mark), F.length(c))).alias("seed"))


def slug(c: Column, empty: str = "lodestone") -> Column:
    """ASCII letters, digits, underscores, dots and dashes; a run of anything else becomes a dash, no dots and dashes at the ends; `empty` if nothing is left."""
    found = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "-"), r"\A[.-]+|[.-]+\z", "")
    return F.when(found == "", F.lit(empty)).otherwise(found)


def moved(path: Column, root: str, to: str) -> Column:
    """A path below one root as the path below another; others stay."""
    return F.when(path.startswith(root.rstrip("/") + "/"), F.concat(F.lit(to.rstrip("/")), F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)))).otherwise(path)


def safe_relative(path: Column) -> Column:
    """Whether a path stays below where it is unpacked, on any system: relative, no part of two dots, no colon, backslash or NUL, not empty."""
    return (path != "") & ~path.rlike(r"\A/|(\A|/)\.\.(/|\z)|[:\\\x00]")


def mean_sd(mean: Column, sd: Column, digits: int = 2) -> Column:
    """"mean ± sd" with fixed digits."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, sd)


def largest_batch(cap: Column, target: Column, world: Column) -> Column:
    """The largest b up to cap such that b * world divides target; null if none does."""
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(cap.cast("long"), F.lit(1).cast("long"))), lambda b: (target % (b * world) == 0) & (b <= cap)))


Fields = dict[str, "Column | Fields"]


def fields_in_order(fields: Fields) -> Column:
    """A struct of the fields by name, structs within it too."""
    return F.struct(*[(fields_in_order(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(fields.items())])


def canonical_json(fields: Fields) -> Column:
    """Compact JSON of the fields in the order of their names, nulls kept; fields may be fields again."""
    return F.to_json(fields_in_order(fields), {"ignoreNullFields": "false"})
