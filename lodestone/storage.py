"""Cutting lineage with tables in the shared folder of the cluster.

A materialised table is written once and read by every later job, so a lost
executor costs a re-read and never a recomputation of what stands above it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on one machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _local[0]


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet below shared_dir and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    """Best effort: the tables outlive no application that ends normally."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            break
    for path in _local:
        import shutil

        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _written.clear()
