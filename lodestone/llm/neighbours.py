"""Nearest neighbours by multi-index hashing of learned binary codes (operator 13).

Codes: vectors, lengthened by one entry to equal norms so that inner products order
as angles do, are centred, turned to principal axes and rotated so that their signs
lose least (iterative quantisation, several rotations until BITS bits are full). The
rotation is learned on a bounded sample; every row is coded.

Index: rows are dealt to shards of about SHARD rows. A shard keeps, for each
substring of the codes, a table from value to rows. By the pigeonhole principle a
code within `radius` of a query has a substring within radius / SUBSTRINGS of the
query's, or less for the later ones; such values are probed in every table, complete
distances verified, and the codes within the radius reranked by the inner products
of the vectors themselves. Each shard returns a query's best, and the best of all
shards are its result.

The radius comes from the table: the true neighbours of a bounded number of queries
among all rows are searched exactly, and RECALL of them must lie within it. Queries
for which too few codes lie within it are probed again with a greater radius, in
the end one that excludes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.vectors import usable
from lodestone.storage import materialize

BITS, WIDTH = 256, 16  # bits of a code and of a substring
SUBSTRINGS = BITS // WIDTH
FITTED, FITTED_NUMBERS = 20_000, 1 << 22  # vectors, and numbers of all of them, of the sample that codes are learned on
AXES, TURNS = 128, 30  # principal axes at most, rounds of a rotation's fit
TRIED, RECALL = 128, 0.98  # queries of the calibration, share of their true neighbours within the radius
SHARD, QUERIES = 32_768, 4096  # rows of a shard of the index, queries of a block
AT_ONCE = 64  # queries that are probed together


class Codes:
    """Learned hash: vectors to BITS signs, packed into 16-bit words."""

    def __init__(self, sample: np.ndarray, norm: float):
        self.norm = norm
        long = self._lengthened(sample)
        self.centre = long.mean(0)
        apart = long - self.centre
        _, _, axes = np.linalg.svd(np.linalg.qr(apart, mode="r"), full_matrices=False)
        self.axes = axes[:AXES].T
        projected, random = apart @ self.axes, np.random.default_rng(7)
        p = projected.shape[1]
        self.turns = [self._fitted(projected, random.normal(size=(p, p))) for _ in range(-(-BITS // p))]

    def _lengthened(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))
        return np.hstack([v, rest[:, None]]) / self.norm

    @staticmethod
    def _fitted(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        turn, _ = np.linalg.qr(start)
        for _ in range(TURNS):
            u, _, w = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
            turn = (u @ w).T
        return turn

    def words(self, v: np.ndarray) -> np.ndarray:
        """SUBSTRINGS 16-bit words for each row."""
        x = (self._lengthened(v) - self.centre) @ self.axes
        signs = np.hstack([x @ t for t in self.turns])[:, :BITS] > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")


def distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of one (rows) to all of two (columns)."""
    a, b = one.view("<u8"), two.view("<u8")
    return sum(np.bitwise_count(a[:, None, i] ^ b[None, :, i]).astype(np.int16) for i in range(a.shape[1]))


def ball(radius: int) -> np.ndarray:
    """All substrings of at most `radius` bits."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(WIDTH), k)], np.uint16)


def reach(radius: int) -> list[int]:
    """How far each substring must be probed (-1: not at all) so that no code within the radius is missed."""
    each, more = divmod(radius, SUBSTRINGS)
    return [min(each if i <= more else each - 1, WIDTH) for i in range(SUBSTRINGS)]


class Shard:
    """Tables of the substrings of some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for i in range(SUBSTRINGS):
            values, place = np.unique(codes[:, i], return_inverse=True)
            self.tables.append((values, place, np.argsort(place, kind="stable"), np.searchsorted(np.sort(place), np.arange(len(values) + 1))))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) numbers of all codes within the radius."""
        hit = np.zeros((len(queries), len(self.codes)), bool)
        for i, far in enumerate(reach(radius)):
            values, place, rows, starts = self.tables[i]
            if far < 0:
                continue
            if far <= 2 and len(values) > 1 + WIDTH * (WIDTH + 1) // 2:  # few values in the ball: look each up
                probes = queries[:, i, None] ^ ball(far)[None, :]
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                q, j = np.nonzero(values[at] == probes)
                for q, v in zip(q.tolist(), at[q, j].tolist()):
                    hit[q, rows[starts[v] : starts[v + 1]]] = True
            else:  # more values in the ball than in the table: compare those of the table
                hit |= (np.bitwise_count(queries[:, i, None] ^ values[None, :]) <= far)[:, place]
        q, r = np.nonzero(hit)
        near = sum(np.bitwise_count(a[q] ^ b[r]).astype(np.int16) for a, b in zip(queries.view("<u8").T, self.codes.view("<u8").T)) <= radius
        return q[near], r[near]


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision."""
    return np.einsum("ij,ij->i", one, two)


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id, one place an id."""
    order = np.lexsort((ids, -scores, q))
    q, ids = q[order], ids[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (ids[1:] == ids[:-1]) & (scores[order][1:] == scores[order][:-1])
    order, q = order[~again], q[~again]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def learned(rows: DataFrame) -> Codes:
    """Codes from the rows of least hash, FITTED vectors and FITTED_NUMBERS numbers at most."""
    d, norm = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    some = rows.orderBy(F.xxhash64("v"), "id").limit(max(1, min(FITTED, FITTED_NUMBERS // d))).select("v").toArrow()
    return Codes(_vectors(some.column(0)), float(np.sqrt(norm)))


def calibrated(rows: DataFrame, queries: DataFrame, codes: Codes, k: int) -> int:
    """The radius that holds RECALL of the true k neighbours of TRIED queries among all rows."""
    tried = queries.orderBy(F.xxhash64("v", F.lit(1)), "id").limit(TRIED).select("id", "v").toArrow()
    ids, v = tried.column(0).to_numpy(), _vectors(tried.column(1)) if len(tried) else np.zeros((0, 1))
    if not len(ids):
        return BITS
    words = codes.words(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, far = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int16)
        for batch in batches:
            own, w = batch.column(0).to_numpy(), _vectors(batch.column(1)) if batch.num_rows else np.zeros((0, v.shape[1]))
            now = v @ w.T
            now[ids[:, None] == own[None, :]] = -np.inf
            score, far = np.hstack([score, now]), np.hstack([far, distances(words, codes.words(w))])
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, far = np.take_along_axis(score, top, 1), np.take_along_axis(far, top, 1)
        q = np.repeat(np.arange(len(ids)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score.ravel()), pa.array(far.ravel().astype(np.int64))], ["q", "score", "far"])

    found = rows.select("id", "v").mapInArrow(run, "q long, score double, far long").where(F.col("score") > float("-inf"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    radius = ranked.agg(F.percentile("far", F.lit(RECALL))).first()[0]
    return BITS if radius is None else int(np.ceil(radius))


def probed(shards: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, parts: int) -> DataFrame:
    """q, own, id, score: for each query (q, own, v, block) the best k codes within the radius in each shard, own id left out."""
    blocks = queries.agg(F.max("block")).first()[0]
    index = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0))))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["q", "own", "id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in kinds], names)
        ids, v = left["id"].to_numpy(), _vectors(left["v"])
        number, own, w = right["q"].to_numpy(), right["own"].to_numpy(), _vectors(right["v"])
        shard, asks, out = Shard(codes.words(v)), codes.words(w), []
        for at in range(0, len(w), AT_ONCE):
            q, r = shard.within(asks[at : at + AT_ONCE], radius)
            q, r = (x[own[q + at] != ids[r]] for x in (q, r))
            scores = products(w[q + at], v[r])
            keep = best(q, ids[r], scores, k)
            out.append((number[q[keep] + at], own[q[keep] + at], ids[r[keep]], scores[keep]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], names)

    return index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, "q long, own long, id long, score double")


def search(rows: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest inner product with each row whose key is divisible by `every`.

    Ranks go by score descending, ties to the smaller key; scores are those of the
    vectors themselves. Rows without a key, and vectors that `vectors.usable` leaves
    out or that are zero, take no part. A row's candidates are the rows of other
    keys; rows that repeat count once, and rows of one key with different vectors
    each are queries and candidates of their own. Of equal vectors only the k + 1
    smallest keys can be in a result, so copies beyond them are left out before the
    index is built, which changes no result. Fewer candidates than k are all
    returned. Other columns play no part, whatever their names. An empty table gives
    no rows.
    """
    spark = rows.sparkSession
    fit = usable(rows, vector, zero=False).where(F.col(key).isNotNull())
    fit = fit.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    fit = materialize(fit, "vectors")
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    table = materialize(fit.withColumn("copy", least).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    asking = fit.where(F.col("id") % every == 0)
    asked, (n, named) = asking.count(), table.agg(F.count("*"), F.approx_count_distinct("id")).first()
    if named <= 2 * k:
        named = table.select("id").distinct().count()
    if not asked:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    codes = learned(table)
    radius = calibrated(table, asking, codes, k)
    parts = int(max(-(-n // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 512))))
    shards = table.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    block = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(-(-asked // QUERIES))).cast("int")
    queries = asking.select(F.xxhash64("v", "id").alias("q"), F.col("id").alias("own"), "v", block.alias("block"))
    order = Window.partitionBy("q", "own").orderBy(F.desc("score"), "id")
    kept, wanted = None, min(k, named - 1)
    while True:
        found = probed(shards, queries, codes, radius, k, parts)
        found = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        full = found.groupBy("q", "own").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= wanted).select("q", "own")
        left = None if radius >= BITS or not wanted else materialize(queries.join(full, ["q", "own"], "left_anti"), "again")
        if left is None or left.isEmpty():
            done = found if kept is None else kept.unionByName(found)
            return done.select(F.col("own").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
        ready = found.join(full, ["q", "own"], "left_semi")
        kept = ready if kept is None else kept.unionByName(ready)
        queries, radius = left, radius + -(-(BITS - radius) // 2)
