"""Whitening of embeddings by hierarchical SVD merging (operator 11).

Every partition summarises its vectors, block by block, as a number of rows, exact
sums, and all singular values and right singular vectors of its centred rows. Two
summaries merge by stacking values times vectors of both, with one further row that
corrects for the difference of their means, and a new SVD. Nothing is truncated, so
the last summary has the singular values and vectors of the whole centred table,
though no task has held more than a block of rows and FAN summaries.

Entries are taken in fixed point (`SCALE` steps a unit), so sums are whole numbers
that come out alike in any order of rows, and rows are centred before anything is
multiplied. Summaries grow with the square of the dimensions and not with the
rows; the levels of the merge are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.vectors import usable
from lodestone.storage import materialize

SCALE, OFFSET = 1024, 100_000  # an entry c counts as floor(SCALE * c) + OFFSET
FAN = 16  # summaries that are merged at once
BLOCK = 1 << 22  # numbers of a block of rows
LARGEST = 2.0**60  # entries beyond it have no exact place
NAMES = ["part", "n", "sums", "values", "axes"]
KINDS = "part long, n long, sums array<string>, values array<double>, axes binary"


@dataclass
class Summary:
    """n rows with whole sums; values and axes: the singular values, and vectors as rows, of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray

    def row(self, part: int) -> list:
        return [part, self.n, list(map(str, self.sums)), self.values.tolist(), self.axes.tobytes()]


def _factors(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, axes = np.linalg.svd(np.linalg.qr(rows, mode="r"), full_matrices=False)
    return values, axes


def _whole_sums(block: np.ndarray) -> list[int]:
    """Column sums of 64-bit whole numbers, exact beyond 64 bits."""
    high, low = (block >> 31).sum(0), (block & 0x7FFFFFFF).sum(0)
    return [(int(h) << 31) + int(x) for h, x in zip(high, low)]


def centred(block: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """block - sums / n, taken off in whole numbers first."""
    whole, rest = zip(*(divmod(s, n) for s in sums))
    return (block - np.array(whole, np.int64)).astype(float) - np.array([r / n for r in rest])


def summary(block: np.ndarray) -> Summary:
    """Of a block of whole numbers, a row a vector."""
    sums = _whole_sums(block)
    return Summary(len(block), sums, *_factors(centred(block, len(block), sums)))


def merge(one: Summary, two: Summary) -> Summary:
    """The summary of the rows of both."""
    n = one.n + two.n
    apart = np.array([(s * two.n - t * one.n) / (one.n * two.n) for s, t in zip(one.sums, two.sums)])
    correction = apart * np.sqrt(one.n / n * two.n)
    stacked = np.vstack([one.values[:, None] * one.axes, two.values[:, None] * two.axes, correction])
    return Summary(n, [s + t for s, t in zip(one.sums, two.sums)], *_factors(stacked))


def _loaded(table: pa.Table | pa.RecordBatch) -> Iterator[Summary]:
    columns = [table.column(k).to_pylist() for k in NAMES[1:]]
    for n, sums, values, axes in zip(*columns):
        yield Summary(n, list(map(int, sums)), np.array(values), np.frombuffer(axes).reshape(len(values), -1))


def _merged(found: Iterator[Summary]) -> Summary | None:
    total = None
    for x in found:
        total = x if total is None else merge(total, x)
    return total


def _batch(rows: list[list], schema: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema)], NAMES)


_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.binary()]


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def fit(points: DataFrame) -> Summary | None:
    """The summary of column x (arrays of whole numbers, one length) of all rows; none if there are none."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 1), np.int64)
            step = max(1, BLOCK // rows.shape[1])
            for at in range(0, len(rows), step):
                found = summary(rows[at : at + step])
                total = found if total is None else merge(total, found)
        if total is not None:
            yield _batch([total.row(TaskContext.get().partitionId())], _TYPES)

    def inner(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch([_merged(_loaded(table)).row(key[0].as_py())], _TYPES)])

    level = materialize(points.select("x").mapInArrow(leaves, KINDS), "svd")
    last = level.agg(F.max("part")).first()[0]
    while last:
        level = materialize(level.groupBy(F.floor(F.col("part") / FAN).alias("above")).applyInArrow(inner, KINDS), "svd")
        last //= FAN
    return _merged(_loaded(level.toArrow()))  # one row


def _deviations(block: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - sums) ** 2 of every row, exact; none beyond 64 bits."""
    whole, rest = zip(*(divmod(s, n) for s in sums))
    apart = block - np.array(whole, np.int64)
    most = int(np.abs(apart).max(initial=0)) + 1
    kind = np.int64 if most * max(most, n) * block.shape[1] < 1 << 62 else object
    apart, left = apart.astype(kind), np.array(rest, kind)
    squares, cross, last = (apart * apart).sum(1), apart @ left, sum(r * r for r in rest)
    found = (n * n * int(s) - 2 * n * int(c) + last for s, c in zip(squares, cross))
    return [f if f < 1 << 63 else None for f in found]


def whiten(rows: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error of every row that `usable` keeps.

    whitened is the centred row on the unit eigenvector of the component-th largest
    eigenvalue e of the covariance (divisor n), over sqrt(e); explained is e over the
    trace; identity_error the largest entry of the covariance of whitened less the
    identity; deviation the exact sum of (n * x - sums) ** 2, null beyond 64 bits.
    Fewer dimensions than `components` give as many rows as there are. Where a
    component has no variance (constant rows, fewer rows than components) whitened
    is null and the component is left out of identity_error, which is null if all
    are; explained is null if the trace is zero. Equal eigenvalues have any
    orthonormal vectors of their space. Rows with entries beyond 2**60 / SCALE have
    no place in fixed point and are left out. Repeated rows and rows with a null key
    count and come out each for itself; other columns play no part, whatever their
    names. An empty table gives no rows.
    """
    x = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    inside = usable(rows, vector).where(F.forall(vector, lambda c: F.abs(c.cast("double")) < LARGEST / SCALE))
    points = materialize(inside.select(F.col(key).alias("key"), x.alias("x")), "points")
    model, kind = fit(points), points.schema["key"].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    k = min(components, len(model.sums))
    variances = np.zeros(len(model.sums))
    variances[: len(model.values)] = model.values**2 / model.n
    live = int((model.values[:k] > model.values[0] * len(model.sums) * 2.0**-48).sum())
    scales = model.values[:live, None] / np.sqrt(model.n)
    projection = (model.axes[:live] / scales).T
    n, sums = model.n, model.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = _matrix(batch.column(1))
                found = (centred(block, n, sums) @ projection).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(block, n, sums), pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["key", "deviation", "whitened"])

    placed = materialize(points.mapInArrow(project, f"key {kind}, deviation long, whitened array<double>"), "whitened")
    at = lambda i: F.get("whitened", F.lit(i))
    errors = [F.abs(F.covar_pop(at(i), at(j)) - float(i == j)) for i in range(live) for j in range(i + 1)]
    error = placed.agg(F.array_max(F.array(*errors))).first()[0] if live else None
    trace = variances.sum()
    shares = F.array(*[F.lit(float(v / trace) if trace else None).cast("double") for v in variances[:k]])
    numbers = F.sequence(F.lit(1), F.lit(k))
    exploded = placed.select("key", "deviation", "whitened", F.explode(numbers).alias("component"))
    return exploded.select(
        F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"),
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
