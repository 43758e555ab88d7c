"""Packing along a space-filling curve (operator 1).

A document's hashed vector (counts of its token ids in HASHED buckets) is
projected to DIMS numbers; these, scaled by the mean and deviation over all
documents, are the coordinates of a cell of a Hilbert curve. Documents in
order of their cell are laid end to end and cut every `length` tokens, so that
sequences hold neighbours and only the last one is padded.

The ids are computed once and written to the shared folder; the keys are plain
column expressions. Places in the global order come from sums over buckets of the
curve: bucket borders are quantiles of a sample of the keys (a matter of balance,
not of results), whose low bits are a hash of the row, so one cell with a third of
all documents still spreads over many buckets. Only SAMPLED keys and a sum for each
bucket reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder, largest_id
from lodestone.llm.native import bucket_of, let
from lodestone.storage import materialize

HASHED, DIMS, BITS = 512, 3, 7  # buckets of the vector, projected numbers, bits of a coordinate
LOW_BITS = 63 - DIMS * BITS
BUCKET_TOKENS = 32_000_000  # tokens of a bucket of the curve at which more buckets than tasks are made
SAMPLED = 8  # keys of the sample for each bucket


def hilbert_key(cell: Column, bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a struct of three whole numbers x0, x1, x2 below 2**bits (Skilling's transform)."""
    num = lambda v: F.lit(v).cast("long")
    turns = F.array(*[F.struct(num(1 << b).alias("q"), num(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(3)])

    def turn(x: Column, t: Column) -> Column:
        own = F.when(t["i"] == 0, x["x0"]).when(t["i"] == 1, x["x1"]).otherwise(x["x2"])
        low = t["q"] - 1
        hit = own.bitwiseAND(t["q"]) != 0
        swap = F.when(hit, num(0)).otherwise(x["x0"].bitwiseXOR(own).bitwiseAND(low))
        changed = lambda i: F.when(t["i"] == i, x[f"x{i}"].bitwiseXOR(swap)).otherwise(x[f"x{i}"])
        return F.struct(x["x0"].bitwiseXOR(F.when(hit, low).otherwise(swap)).alias("x0"), changed(1).alias("x1"), changed(2).alias("x2"))

    def gray(x: Column) -> Column:
        one = x["x1"].bitwiseXOR(x["x0"])
        two = x["x2"].bitwiseXOR(one)
        flip = num(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(two.bitwiseAND(1 << b) != 0, num((1 << b) - 1)).otherwise(num(0)))
        return F.struct(flip.alias("flip"), x["x0"].alias("x0"), one.alias("x1"), two.alias("x2"))

    def woven(x: Column) -> Column:
        key = num(0)
        for b in range(bits - 1, -1, -1):
            for i in range(3):
                bit = F.shiftright(x[f"x{i}"].bitwiseXOR(x["flip"]), b).bitwiseAND(1)
                key = key + F.shiftleft(bit, 3 * b + 2 - i)
        return key

    return let(let(F.aggregate(turns, cell, turn), gray), woven)


def _projection() -> np.ndarray:
    return np.random.default_rng(1).normal(size=(HASHED, DIMS))


def _stored(path: str | None) -> str:
    """How ids are kept until they are cut: two bytes each where the vocabulary allows it."""
    return "<u2" if largest_id(path) < 1 << 16 else "<u4"


def tokens(docs: DataFrame, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian, as _stored says, end_id last), n, mix (a hash of ids and doc_id), p0.. (projected vector)."""
    stored = _stored(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, matrix = encoder(path, by_library=True), _projection()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, n, mix, points = [], [], [], np.zeros((len(texts), DIMS))
            for i, x in enumerate(coder.encode(texts)):
                own = np.append(x, np.uint32(end_id))
                vector = np.bincount(own * np.uint32(2654435761) >> np.uint32(23), minlength=HASHED).astype(float)
                points[i] = vector @ matrix / np.linalg.norm(vector)
                ids.append(own.astype(stored).tobytes())
                n.append(len(own))
                mix.append(zlib.crc32(ids[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(mix, pa.int64()), *(pa.array(points[:, k], pa.float64()) for k in range(DIMS))], ["doc_id", "ids", "n", "mix", *(f"p{k}" for k in range(DIMS))])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n long, mix long, " + ", ".join(f"p{k} double" for k in range(DIMS)))


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if keep_ids).

    start counts the document's ids before the piece. A null or empty text is the
    end token alone. Rows with one doc_id, and repeated rows, are packed as
    documents of their own. Cells with equal key are ordered by a hash, then by
    doc_id (null first), then by content, so ties give one order up to equal rows.
    An empty table gives no rows; other columns play no part.
    """
    spark, stored = docs.sparkSession, _stored(path)
    table = materialize(tokens(docs, end_id, path), "tokens")
    measured = table.agg(F.count("*"), F.sum("n"), *(f(f"p{k}") for k in range(DIMS) for f in (F.avg, F.stddev_pop))).first()
    rows, total = measured[0], measured[1] or 0
    centre, width = np.array([x or 0.0 for x in measured[2::2]]), np.array([x or 1.0 for x in measured[3::2]])

    scale = lambda k: F.coalesce((F.col(f"p{k}") - float(centre[k])) / float(width[k] or 1.0), F.lit(0.0))
    cell = lambda k: F.least(F.greatest(F.floor((scale(k) + 2.5) / 5 * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")
    curve = hilbert_key(F.struct(*[cell(k).alias(f"x{k}") for k in range(DIMS)]))
    low = F.shiftrightunsigned(F.xxhash64("doc_id", "mix"), 64 - LOW_BITS)
    keyed = table.withColumn("key", F.shiftleft(curve, LOW_BITS) + low).select("key", "doc_id", "mix", "n", "ids")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = int(max(1, min(max(8 * tasks, total // BUCKET_TOKENS), rows)))
    one_in = max(1, rows // (SAMPLED * buckets))
    sampled = keyed.where(F.pmod(F.xxhash64("mix", "doc_id", F.lit(1)), F.lit(one_in)) == 0).select("key").toArrow()
    found = np.sort(sampled["key"].to_numpy())
    cuts = np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found
    placed = keyed.withColumn("bucket", bucket_of(F.col("key"), cuts.tolist()))
    sums = placed.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    before = np.zeros(len(cuts) + 2, np.int64)
    before[sums["bucket"].to_numpy() + 1] = sums["n"].to_numpy()
    before = np.cumsum(before)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = -1, 0
        for batch in batches:
            out: list[tuple] = []
            for bucket, doc, data in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if bucket != now:
                    now, at = bucket, int(before[bucket])
                data = np.frombuffer(data.as_buffer(), stored).astype("<u4")
                size, start = len(data), 0
                while start < size:
                    sequence, offset = divmod(at, length)
                    n = min(size - start, length - offset)
                    part = data[start : start + n].tobytes()
                    out.append((doc, start, n, zlib.crc32(part), size, sequence, offset) + ((part,) if keep_ids else ()))
                    start += n
                    at += n
            columns = list(zip(*out)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return placed.repartition("bucket").sortWithinPartitions("bucket", "key", "doc_id", "mix", "ids").mapInArrow(cut, schema)
