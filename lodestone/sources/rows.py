"""Rows as JSON lines, JSON documents and CSV, in folders that Spark reads and writes."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line; blank lines are skipped, and a line that is no object or does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, keys in order of name, nulls kept; the committer makes the folder appear as a whole."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Adds a batch of event rows to a log that read_jsonl and streaming.events.tail read."""
    write_jsonl(df, path, "append")


def write_document(spark: SparkSession, path: str, value: dict | list) -> None:
    """One JSON document (sorted, indented), written beside its place and renamed onto it.

    For summaries that the driver holds; tables go through write_jsonl.
    """
    jvm = spark.sparkContext._jvm
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(part, False)
    try:
        out.write(bytearray((json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()))
    finally:
        out.close()
    if place.toUri().getScheme() in (None, "file") and files.getScheme() == "file":
        os.replace(part.toUri().getPath(), place.toUri().getPath())
    else:  # one step where the store renames over a file in one
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, place, options)


def read_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole files as JSON documents, with their path."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every cell as text (an empty one as empty text), by a header that must agree; quoted cells may hold line breaks."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"header": True, "enforceSchema": False, "multiLine": True, "mode": "FAILFAST", "escape": '"'}
    return spark.read.schema(schema).options(**options).csv(path).na.fill("")


def cells(df: DataFrame) -> list[Column]:
    """The columns with arrays, maps and structs as JSON text, which CSV can hold."""
    nested = (ArrayType, MapType, StructType)
    return [(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema]


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """With a header: of the named fields, in their order, or of all columns."""
    rows = df.select(*cells(df))
    rows = rows.select(*[F.col(f"`{c}`") for c in fields]) if fields else rows
    rows.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def write_union_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of tables with different columns under one sorted header; without any row an error."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(*cells(f)) for f in frames]) if frames else None
    if rows is None or rows.isEmpty():
        raise ValueError("no rows to write")
    write_csv(rows, path, sorted(rows.columns))
