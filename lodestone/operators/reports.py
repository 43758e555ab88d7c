"""Selections and tables of reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordering import before


def top_unique(rows: DataFrame, unique: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows in order, one for each value of unique."""
    first = F.row_number().over(Window.partitionBy(unique).orderBy(*order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(*order).limit(k)


def pareto(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other dominates (at least as good in both, better in one).

    By values of x from the best down: a row stays if its y is the best of its x
    and exceeds every y of a better x. Only the best y of each x is compared.
    """
    best = rows.groupBy(x).agg(F.max(y).alias("_best"))
    front = before(best, F.max, F.col("_best"), F.desc(x), out="_above").where(F.col("_above").isNull() | (F.col("_best") > F.col("_above"))).select(x, F.col("_best").alias(y))
    return rows.join(front, [x, y], "left_semi")


def division(rows: DataFrame, item: str, member: str, members: int) -> DataFrame:
    """Items that meet every one of so many members."""
    return rows.groupBy(item).agg(F.count_distinct(member).alias("met")).where(F.col("met") == members).select(item)


def ranked_sample(rows: DataFrame, stratum: str, key: Column, k: int) -> DataFrame:
    """The k rows of each stratum with the smallest key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).where(F.col("_n") <= k).drop("_n")


def seed_summary(rows: DataFrame, by: str, seed: str, value: str, seeds: int) -> DataFrame:
    """by, mean, sd (sample; null for one), n_seeds, defined (all seeds have a value)."""
    each = rows.groupBy(by, seed).agg(F.avg(value).alias("v"))
    return each.groupBy(by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n_seeds"), (F.count("v") == seeds).alias("defined"))


def learning_curve(train: DataFrame, validation: DataFrame, keys: list[str], loss: str, score: str) -> DataFrame:
    """keys, loss, score; a validation row without a training row is an error when the rows are read."""
    met = validation.select(*keys, score).join(train.select(*keys, loss), keys, "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no training rows for"), *keys)).cast("double")
    return met.select(*keys, F.coalesce(loss, lost).alias(loss), score)


def reconcile(first: DataFrame, second: DataFrame, third: DataFrame, key: str, answer: str) -> DataFrame:
    """key, first, second, decision: the common answer, or the third one's where two differ.

    The first two need the same keys, and every disagreement a third answer: else reading is an error.
    """
    one, two, judge = (t.select(key, F.col(answer).alias(n)) for t, n in ((first, "first"), (second, "second"), (third, "_third")))
    met = one.join(two, key, "full").join(judge, key, "left")
    wrong = F.raise_error(F.concat(F.lit("no decision for "), F.col(key).cast("string"))).cast(dict(first.dtypes)[answer])
    decision = F.when(F.col("first").isNull() | F.col("second").isNull(), wrong).when(F.col("first") == F.col("second"), F.col("first")).otherwise(F.coalesce("_third", wrong))
    return met.select(key, "first", "second", decision.alias("decision"))


def early_stop(rows: DataFrame, run: str, step: str, score: str, min_delta: float, patience: int) -> DataFrame:
    """run, best, best_step, stopped_at (null if never): a score counts as better only by more than min_delta.

    Null scores are no steps. The runs' logs are sorted over many partitions and
    each is folded as it streams by, so no run is held whole; ties of a step go by score.
    """
    kind = dict(rows.dtypes)[run]
    steps = rows.where(F.col(score).isNotNull()).select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(score).cast("double").alias("score"))
    names = ["run", "best", "best_step", "stopped_at"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, at, bad, stop, any_row = None, None, None, 0, None, False
        for batch in batches:
            out: list[tuple] = []
            for r, s, v in zip(*(c.to_pylist() for c in batch.columns)):
                if not any_row or r != now:
                    if any_row:
                        out.append((now, best, at, stop))
                    now, best, at, bad, stop, any_row = r, None, None, 0, None, True
                if stop is None:
                    if best is None or v > best + min_delta:
                        best, at, bad = v, s, 0
                    else:
                        bad += 1
                        stop = s if bad >= patience else None
            yield _told(out, batch.schema.field(0).type)
        if any_row:
            yield _told([(now, best, at, stop)], batch.schema.field(0).type)

    def _told(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, pa.float64(), pa.int64(), pa.int64()))], names)

    found = steps.repartition("run").sortWithinPartitions("run", "step", "score").mapInArrow(fold, f"run {kind}, best double, best_step long, stopped_at long")
    return found.withColumnRenamed("run", run)


def acceptance(rows: DataFrame, accepted: str, z: float, *by: str) -> DataFrame:
    """Acceptance by every level of by, from all rows to the finest: n, rate, lower, upper (Wilson)."""
    from lodestone.functions.scalars import wilson

    each = rows.rollup(*by).agg(F.count("*").alias("n"), F.sum(F.col(accepted).cast("long")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"), z)
    return each.select(*by, "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("lower"), high.alias("upper"))
