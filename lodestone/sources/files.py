"""Files as rows: image folders, arrays, content manifests and their checks, in fixed-size parts."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ordering import before


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below folder), bytes, content of every file at any depth whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return files.select(F.substring_index(F.col("path"), root, -1).alias("path"), F.col("length").alias("bytes"), "content")


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """path, class_name (sub-folder), width, height, rgb, content of the PNG files of class folders.

    Size and colour type are read from the header by built-in functions; a file
    that is no PNG has nulls there.
    """
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    rows = scan(spark, folder, pattern)
    return rows.select(
        "path", F.substring_index("path", "/", 1).alias("class_name"),
        F.when(png, number(17, 4)).alias("width"), F.when(png, number(21, 4)).alias("height"), F.when(png, number(26, 1) == 2).alias("rgb"), "content",
    )


def image_violations(rows: DataFrame, width: int, height: int) -> DataFrame:
    """path of the images that are not RGB of that size."""
    fits = (F.col("width") == width) & (F.col("height") == height) & F.col("rgb")
    return rows.where(~F.coalesce(fits, F.lit(False))).select("path")


def read_npz(spark: SparkSession, folder: str, key: str, vector: str) -> DataFrame:
    """path, row, key (long), vector (array of doubles): aligned arrays of every NPZ file; files of unequal lengths fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    names, vectors = arrays[key], arrays[vector]
                if len(names) != len(vectors):
                    raise ValueError(f"{path}: {key} and {vector} are not aligned")
                yield pd.DataFrame({"path": path, "row": range(len(names)), key: names.astype("int64"), vector: list(vectors.astype("float64"))})

    return scan(spark, folder, "*.npz").select("path", "content").mapInPandas(run, f"path string, row long, `{key}` long, `{vector}` array<double>")


def read_npy(spark: SparkSession, folder: str, digests: DataFrame | None = None) -> DataFrame:
    """path, shape, values (flat, row-major) of every NPY file; with digests (path, sha256) a file that has no digest there or another one is an error."""
    rows = scan(spark, folder, "*.npy")
    if digests is not None:
        told = rows.join(digests.select("path", F.col("sha256").alias("_told")), "path", "left")
        wrong = F.raise_error(F.concat(F.lit("digest of "), "path")).cast("binary")
        rows = told.withColumn("content", F.when(F.sha2("content", 256) == F.col("_told"), F.col("content")).otherwise(wrong)).drop("_told")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "shape": [list(a.shape) for a in arrays], "values": [a.astype("float64").ravel() for a in arrays]})

    return rows.select("path", "content").mapInPandas(run, "path string, shape array<long>, values array<double>")


def manifest(rows: DataFrame) -> DataFrame:
    """path, bytes, sha256 of scanned files."""
    return rows.select("path", "bytes", F.sha2("content", 256).alias("sha256"))


def manifest_violations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem (missing, unlisted, size or digest): a sound folder gives no row."""
    e, a = expected.alias("e"), actual.alias("a")
    met = e.join(a, F.col("e.path") == F.col("a.path"), "full")
    problem = (
        F.when(F.col("a.path").isNull(), "missing").when(F.col("e.path").isNull(), "unlisted")
        .when(~F.col("e.bytes").eqNullSafe(F.col("a.bytes")), "size").when(~F.col("e.sha256").eqNullSafe(F.col("a.sha256")), "digest")
    )
    return met.select(F.coalesce("e.path", "a.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def parts(files: DataFrame, cap: int = 512 << 20) -> DataFrame:
    """path, bytes, part: files in order of path, laid end to end and cut at every cap bytes; part is where a file begins."""
    placed = before(files.select("path", "bytes"), F.sum, F.col("bytes"), "path")
    return placed.select("path", "bytes", F.expr(f"coalesce(total, 0L) DIV {int(cap)}").alias("part"))


def report_index(rows: DataFrame, keep: str = "*.json") -> DataFrame:
    """path, bytes, sha256 of the scanned files whose path fits the pattern of names: what a report's inputs are."""
    pattern = "(^|/)" + keep.replace(".", r"\.").replace("*", "[^/]*") + "$"
    return manifest(rows.where(F.col("path").rlike(pattern)))


def npz_bytes(ids: list[int], vectors: list[list[float]]) -> bytes:
    """An NPZ file of aligned arrays ids and vectors; for tables that the driver holds."""
    import numpy as np

    if len(ids) != len(vectors):
        raise ValueError("ids and vectors are not aligned")
    out = io.BytesIO()
    np.savez(out, ids=np.asarray(ids, np.int64), vectors=np.asarray(vectors, np.float64))
    return out.getvalue()
