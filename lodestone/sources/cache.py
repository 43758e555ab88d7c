"""A cache of tensors under names made from their content: a data source with a commit protocol.

Every task writes its tensors under their own names, each through a temporary name and a
rename, so a task that is killed and tried again leaves the same files. What a
task has written it lists in a part of the manifest; the commit publishes the
parts of the tasks that succeeded by one small file, which is written last. A
reader sees committed rows only, and what is committed is not written again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.functions.texts import Fields, canonical_json
from lodestone.operators import images

ROWS = "cache_key string, content binary"
LISTED = "cache_key string, path string, bytes long, sha256 string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")


@dataclass
class Written(WriterCommitMessage):
    part: str | None


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.folder)
        listed: dict[str, list] = {k: [] for k in ("cache_key", "path", "bytes", "sha256")}
        for batch in iterator:
            for key, content in zip(batch.column("cache_key").to_pylist(), batch.column("content").to_pylist()):
                name = f"tensors/{key[:2]}/{key}.npy"
                put(system, f"{root}/{name}", content)
                for column, value in zip(listed.values(), (key, name, len(content), hashlib.sha256(content).hexdigest())):
                    column.append(value)
        if not listed["path"]:
            return Written(None)
        part = f"manifest/{self.run}-{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{root}/manifest", recursive=True)
        with system.open_output_stream(f"{root}/{part}") as out:
            pq.write_table(pa.table(listed), out)
        return Written(part)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted(m.part for m in messages if m and m.part)
        if parts:
            system, root = opened(self.folder)
            put(system, f"{root}/commits/{self.run}.json", json.dumps(parts).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.folder)
        for m in messages:
            if m and m.part:
                system.delete_file(f"{root}/{m.part}")


def put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """A whole file at once; one that is there already, whole, stays."""
    found = system.get_file_info(path)
    if found.type == fs.FileType.File and found.size == len(content):
        with system.open_input_stream(path) as there:
            if there.read() == content:
                return
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    early = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(early) as out:
        out.write(content)
    system.move(early, path)


class CacheSource(DataSource):
    """format("lodestone_cache"): rows of cache_key and content, written to the folder of option path."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_cache"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> CacheWriter:
        return CacheWriter(self.options["path"])


def cache_key(fields: Fields) -> Column:
    """Digest of what decides a tensor: the canonical JSON of the fields."""
    return F.sha2(canonical_json(fields), 256)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """cache_key, path, bytes, sha256 of what committed runs have listed, each key once."""
    system, root = opened(folder)
    commits = fs.FileSelector(f"{root}/commits", allow_not_found=True)
    parts: list[str] = []
    for info in system.get_file_info(commits):  # a file for each run
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as there:
                parts += json.loads(there.read())
    if not parts:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).parquet(*[f"{folder.rstrip('/')}/{p}" for p in parts]).dropDuplicates(["cache_key"])


def fill(rows: DataFrame, folder: str, tensor: str = "tensor", key: str = "cache_key") -> DataFrame:
    """Writes the tensors whose keys no run has committed, and returns `committed` for the keys of rows.

    The keys still to be made are found before any tensor is computed, so a second
    run computes and writes nothing. Rows of one key must have one tensor.
    """
    spark = rows.sparkSession
    spark.dataSource.register(CacheSource)
    known = committed(spark, folder)
    pending = rows.join(known.select(F.col("cache_key").alias(key)), key, "left_anti")
    if not pending.select(key).isEmpty():
        once = pending.select(F.col(key).alias("cache_key"), images.payload(F.col(tensor)).alias("content")).dropDuplicates(["cache_key"])
        once.write.format("lodestone_cache").option("path", folder).mode("append").save()
    return rows.select(F.col(key).alias("cache_key")).distinct().join(committed(spark, folder), "cache_key")


def fill_pairs(pairs: DataFrame, pictures: DataFrame, folder: str) -> DataFrame:
    """pairs with cache_path, cache_bytes and cache_sha256: the changed image of every pair in the cache.

    pairs: cache_key, source_path, donor_path (null if none), family, strength,
    gains; pictures: path, image (`images.decoded`). A path without a picture is an
    error. Pictures are joined by path, so no task holds more than its batch.
    """
    lost = lambda p: F.raise_error(F.concat(F.lit("no picture at "), p)).cast(images.TENSOR)
    one = pictures.select(F.col("path").alias("source_path"), F.col("image").alias("_source"))
    two = pictures.select(F.col("path").alias("donor_path"), F.col("image").alias("_donor"))
    met = pairs.join(one, "source_path", "left").join(two, "donor_path", "left")
    source = F.coalesce("_source", lost(F.col("source_path")))
    donor = F.when(F.col("donor_path").isNotNull(), F.coalesce("_donor", lost(F.col("donor_path"))))
    made = met.select("cache_key", images.intervene(source, donor, F.col("family"), F.col("strength"), F.col("gains")).alias("tensor"))
    filled = fill(made, folder).select("cache_key", F.col("path").alias("cache_path"), F.col("bytes").alias("cache_bytes"), F.col("sha256").alias("cache_sha256"))
    return pairs.join(filled, "cache_key")


def violations(wanted: DataFrame, folder: str, key: str = "cache_key") -> DataFrame:
    """cache_key, problem (uncommitted, missing, size or digest) of the wanted keys: a sound cache gives no row."""
    from lodestone.sources import files

    spark = wanted.sparkSession
    listed = wanted.select(F.col(key).alias("cache_key")).distinct().join(committed(spark, folder), "cache_key", "left")
    there = files.manifest(files.scan(spark, folder, "*.npy")).select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    met = listed.join(there, "path", "left")
    problem = F.when(F.col("sha256").isNull(), "uncommitted").when(F.col("_bytes").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha256"), "digest")
    return met.select("cache_key", problem.alias("problem")).where("problem IS NOT NULL")
