"""Predictions, controlled changes of their inputs, and deterministic partners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import ids
from lodestone.functions import scalars as S
from lodestone.operators.ordering import numbered
from lodestone.storage import materialize

# Strength of each change by severity.
STRENGTH = {
    "gain": {"sham": 0.0, "mild": 0.1, "moderate": 0.5, "severe": 1.0},
    "mix": {"sham": 0.0, "mild": 0.1, "moderate": 0.25, "severe": 0.4},
    "resolution": {"sham": 1.0, "mild": 2.0, "moderate": 4.0, "severe": 16.0},
}
SEVERITIES = ["sham", "mild", "moderate", "severe"]
SLICE = 512  # rows that a worker computes together
TASK = 2048  # rows of a task: a few bytes each, but every condition is computed


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, e (representation in doubles)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def centroids(rows: DataFrame) -> list[tuple[int, list[float]]]:
    """Unit mean representation of each class: a row for each class reaches the driver."""
    each = rows.select("label", F.posexplode("e").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("c"))
    found = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "c"))).alias("c")).orderBy("label").collect()
    out = []
    for label, parts in found:
        norm = sum(x["c"] ** 2 for x in parts) ** 0.5
        out.append((label, [x["c"] / norm for x in parts]))
    return out


def probabilities(e: Column, centres: list[tuple[int, list[float]]], temperature: float = 10.0) -> Column:
    """Softmax of temperature times the cosine with each class."""
    logits = F.array(*[temperature * S.dot(e, F.array(*[F.lit(x) for x in c])) / F.sqrt(S.dot(e, e)) for _, c in centres])
    return S.softmax(logits)


def conditions(spark: SparkSession) -> DataFrame:
    """family, severity, ordinal, strength: twelve rows."""
    rows = [(f, s, i, v[s]) for f, v in STRENGTH.items() for i, s in enumerate(SEVERITIES)]
    return spark.createDataFrame(rows, "family string, severity string, ordinal int, strength double")


def expand(rows: DataFrame) -> DataFrame:
    """Every row under every condition; a generator of twelve rows in place of a join."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("severity"), F.lit(i).alias("ordinal"), F.lit(v[s]).alias("strength")) for f, v in STRENGTH.items() for i, s in enumerate(SEVERITIES)])
    return rows.select("*", F.inline(each))


def changed(e: Column, donor: Column, family: Column, strength: Column, key: Column) -> Column:
    """The representation under a condition: gains of its elements, a mix with the donor's, or means of blocks."""
    direction = lambda j: (key * 31 + j * 17) % 101 / 50.5 - 1
    gained = F.transform(e, lambda x, j: x * (1 + strength * direction(j)))
    mixed = F.zip_with(e, donor, lambda x, y: (1 - strength) * x + strength * y)
    width = strength.cast("int")
    block = lambda j: F.slice(e, (j - j % width + 1).cast("int"), width)
    blurred = F.transform(e, lambda x, j: S.total(block(j)) / F.size(block(j)))
    return F.when(family == "gain", gained).when(family == "mix", mixed).otherwise(blurred)


def neighbours(rows: DataFrame) -> DataFrame:
    """rows with the representation of the next vec_id in order (the last: the first) as d, whatever gaps the ids have."""
    place = materialize(numbered(rows.select("vec_id"), "vec_id"), "places")
    n = place.count()
    after = place.select(F.col("vec_id").alias("_next"), F.pmod(F.col("number") - 1, F.lit(max(n, 1))).alias("number"))
    links = place.join(after, "number").select("vec_id", "_next")
    return rows.join(links, "vec_id").join(rows.select(F.col("vec_id").alias("_next"), F.col("e").alias("d")), "_next").drop("_next")


def _lists(values: np.ndarray, told: np.ndarray) -> pa.Array:
    """A list for each row of told: the next row of values where it is true, null elsewhere."""
    ends = np.cumsum(np.where(told, values.shape[1], 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.reshape(-1)), mask=pa.array(~told))


def computed(both: DataFrame, centres: list[tuple[int, list[float]]], temperature: float) -> DataFrame:
    """Rows (vec_id, label, e, d) under every condition, with p, family, severity, ordinal, strength, t and q.

    Rows are computed together in Arrow batches. What is no plain vector of the
    centres' length, or has no norm, gets nulls: the column expressions tell it.
    """
    c = np.array([x for _, x in centres]) if len({len(x) for _, x in centres}) == 1 else np.zeros((0, 0))
    size = c.shape[1]

    def tell(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((x * x).sum(1))
        told = np.isfinite(norm) & (norm > 0)
        logits = temperature * (x[told, None, :] * c).sum(2) / norm[told, None]  # no product of matrices: a row's sums depend on no other row
        e = np.exp(logits - logits.max(1, keepdims=True, initial=-np.inf))
        return e / e.sum(1, keepdims=True), told

    def change(x: np.ndarray, y: np.ndarray, key: np.ndarray, family: str, strength: float) -> np.ndarray:
        if family == "gain":
            return x * (1 + strength * (np.fmod(key[:, None] * 31 + np.arange(size) * 17, 101) / 50.5 - 1))
        if family == "mix":
            return (1 - strength) * x + strength * y
        begins = np.arange(0, size, int(strength))
        sizes = np.diff(begins, append=size)
        return np.repeat(np.add.reduceat(x, begins, axis=1) / sizes, sizes, axis=1)

    def plain(row: list | None) -> bool:
        return size > 0 and row is not None and len(row) == size and None not in row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            e, d = (batch.column(i).to_pylist() for i in (2, 3))
            key = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            good = np.array([plain(x) and plain(y) for x, y in zip(e, d)]) & (np.abs(key) < 2**57)
            x, y = (np.array([v for v, g in zip(rows, good) if g], float).reshape(-1, size) for rows in (e, d))

            def whole(found: np.ndarray, told: np.ndarray) -> pa.Array:
                at = good.copy()
                at[good] = told
                return _lists(found, at)

            p = whole(*tell(x))
            for family, by in STRENGTH.items():
                for ordinal, severity in enumerate(SEVERITIES):
                    t = change(x, y, key[good], family, by[severity])
                    fixed = [pa.array([v] * batch.num_rows, kind) for v, kind in ((family, pa.string()), (severity, pa.string()), (ordinal, pa.int32()), (by[severity], pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, p, *fixed, _lists(t, good), whole(*tell(t))], names)

    vector = T.ArrayType(T.DoubleType())
    kinds = {"p": vector, "family": T.StringType(), "severity": T.StringType(), "ordinal": T.IntegerType(), "strength": T.DoubleType(), "t": vector, "q": vector}
    schema = T.StructType([*both.schema.fields, *[T.StructField(k, v) for k, v in kinds.items()]])
    names = schema.names
    return both.mapInArrow(run, schema)


def pairs(spark: SparkSession, sf_dir: str, temperature: float = 10.0) -> DataFrame:
    """vec_id, label, family, severity, ordinal, e, t (changed), p, q (probabilities before and after)."""
    rows = samples(spark, sf_dir)
    centres = centroids(rows)
    both = neighbours(rows).select("vec_id", "label", "e", "d").repartition(max(1, -(-rows.count() // TASK)), "vec_id")
    out = computed(both, centres, temperature)
    if not centres:
        return out.drop("d", "strength")
    out = out.withColumn("t", F.coalesce("t", changed(F.col("e"), F.col("d"), F.col("family"), F.col("strength"), F.col("vec_id"))))
    told = {"p": probabilities(F.col("e"), centres, temperature), "q": probabilities(F.col("t"), centres, temperature)}
    return out.withColumns({k: F.coalesce(k, v) for k, v in told.items()}).drop("d", "strength")


def partner(sources: DataFrame, candidates: DataFrame, purpose: str, same_class: bool, seed: int = 7) -> DataFrame:
    """id, partner: the candidate that the source's digest picks among those of the same class, or of other ones, in id order.

    Candidates are numbered once by (class, id); the pick skips the source itself,
    or its class, by shifting the number: no join of all sources with all candidates.
    """
    by_class = candidates.groupBy("label").agg(F.count("*").alias("n"))
    firsts = by_class.select("label", "n", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    own = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    numbered = candidates.select("id", "label", own.alias("rank")).join(firsts, "label").select("id", (F.col("before") + F.col("rank")).alias("number"))
    placed = sources.select("id", "label").join(firsts, "label").join(candidates.select("id", "label", own.alias("rank")), ["id", "label"], "left")
    pick = ids.digest(f"{seed}:{purpose}", F.col("id"))
    if same_class:
        held = F.when(F.col("rank").isNotNull(), 1).otherwise(0)
        k = ids.choice(pick, F.greatest(F.col("n") - held, F.lit(1)))
        number = F.when(F.col("n") > held, F.col("before") + k + F.when(F.col("rank") <= k, 1).otherwise(0))
    else:
        k = ids.choice(pick, F.greatest(F.col("all") - F.col("n"), F.lit(1)))
        number = F.when(F.col("all") > F.col("n"), F.when(k < F.col("before"), k).otherwise(k + F.col("n")))
    return placed.select("id", number.alias("number")).join(numbered.withColumnRenamed("id", "partner"), "number").select("id", "partner")
