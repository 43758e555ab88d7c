"""Summaries of partitions that are merged as a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize

FAN = 16  # summaries that are merged at once
KINDS = "part long, state binary"


def tree(rows: DataFrame, leaf: Callable[[Iterator[pa.RecordBatch]], bytes | None], merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """One state of all rows: leaf makes that of a partition (none if it has no rows), merge that of two.

    Levels are written to the shared folder; a task holds FAN states at most, and
    the driver gets the last one.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = leaf(batches)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state], pa.binary())], ["part", "state"])

    def inner(key: tuple, table: pa.Table) -> pa.Table:
        states = table["state"].to_pylist()
        total = states[0]
        for state in states[1:]:
            total = merge(total, state)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([total], pa.binary())})

    level = materialize(rows.mapInArrow(leaves, KINDS), "states")
    last = level.agg(F.max("part")).first()[0]
    while last:
        level = materialize(level.groupBy(F.floor(F.col("part") / FAN).alias("above")).applyInArrow(inner, KINDS), "states")
        last //= FAN
    found = level.select("state").first()
    return bytes(found[0]) if found else None


BLOCK = 1 << 21  # numbers whose products are summed at once


def _packed(n: int, split: int, mean: np.ndarray, product: np.ndarray) -> bytes:
    return np.array([n, split, len(mean)], np.int64).tobytes() + mean.tobytes() + product.tobytes()


def _unpacked(state: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    n, split, d = np.frombuffer(state, np.int64, 3).tolist()
    return n, split, np.frombuffer(state, float, d, 24), np.frombuffer(state, float, d * d, 24 + 8 * d).reshape(d, d)


def _joined(one: bytes, two: bytes) -> bytes:
    n, split, mean, product = _unpacked(one)
    m, other, mean2, product2 = _unpacked(two)
    if split != other or len(mean) != len(mean2):
        raise ValueError("representations of different lengths")
    apart = mean2 - mean
    return _packed(n + m, split, mean + apart * (m / (n + m)), product + product2 + np.outer(apart, apart) * (n * m / (n + m)))


def gram(rows: DataFrame) -> tuple[int, int, np.ndarray] | None:
    """n, dx and the centred products (d, d) of column z (arrays of one length) of all rows (z, dx); none without rows."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            split = batch.column(1)[0].as_py()
            step = max(1, BLOCK // z.shape[1])
            for at in range(0, len(z), step):
                block = z[at : at + step]
                mean = block.mean(0)
                own = _packed(len(block), split, mean, (block - mean).T @ (block - mean))
                state = own if state is None else _joined(state, own)
        return state

    state = tree(rows.select("z", "dx"), leaf, _joined)
    if state is None:
        return None
    n, split, _, product = _unpacked(state)
    return n, split, product
