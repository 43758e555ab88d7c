"""Nested documents of metrics as a wide table, whatever their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(rows: DataFrame, document: str, path: str, *keys: str, mark: str = ":") -> DataFrame:
    """keys, condition, family, severity, name, value of every metric of every condition below path of the document.

    A condition is cut at its first mark (none: severity is null); value is the
    metric as a VARIANT, so keys and types need not be known. A document that is no
    JSON, or has no object at path, is an error.
    """
    tree = F.variant_get(F.parse_json(document), f"$.{path}", "variant")
    kind = "map<string, map<string, variant>>"
    told = F.when(F.schema_of_variant(tree).startswith("OBJECT"), tree).otherwise(F.raise_error(F.concat(F.lit(f"no object at {path} of "), F.col(document))).cast("variant"))
    outer = rows.select(*keys, F.explode(told.cast(kind)).alias("condition", "_metrics"))
    at = F.locate(mark, F.col("condition"))
    cut = lambda first: F.when(at > 0, F.substring("condition", F.lit(1), at - 1) if first else F.substring("condition", at + len(mark), F.length("condition"))).otherwise(F.col("condition") if first else F.lit(None))
    return outer.select(*keys, "condition", cut(True).alias("family"), cut(False).alias("severity"), F.explode("_metrics").alias("name", "value"))


def kinds(found: DataFrame) -> list[tuple[str, str]]:
    """Names in order, each with its type: long or double if all values are numbers, boolean if all are, else text; found in one pass."""
    shape = F.schema_of_variant("value")
    is_null, whole = shape == "VOID", shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = whole | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT")
    tests = [F.bool_and(t | is_null) for t in (whole, number, shape == "BOOLEAN")]
    each = found.groupBy("name").agg(*[t.alias(k) for t, k in zip(tests, ("long", "double", "boolean"))]).orderBy("name").collect()  # a row for each column of the result
    return [(r["name"], next((k for k in ("long", "double", "boolean") if r[k]), "string")) for r in each]


def wide(found: DataFrame, *keys: str) -> DataFrame:
    """keys, family, severity and a column for each name of entries: numbers as numbers, arrays and objects as JSON text, missing ones null.

    A condition that has a metric twice is an error.
    """
    names = kinds(found)

    def cell(name: str, kind: str) -> Column:
        own = F.when(F.col("name") == name, F.col("value"))
        value = own.try_cast(kind) if kind != "string" else F.coalesce(F.when(F.schema_of_variant(own) == "STRING", own.cast("string")), F.when(F.schema_of_variant(own) != "VOID", F.to_json(own)))
        once = F.when(F.count(own) > 1, F.raise_error(F.lit(f"{name} is there twice")).cast(kind)).otherwise(F.max(value))
        return once.alias(name)

    return found.groupBy(*keys, "family", "severity").agg(*[cell(n, k) for n, k in names])
