"""Event logs as streams: extensions of the batch queries over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """The rows of an append-only log of JSON lines as they arrive, so many files a trigger; a bad line fails the query."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", per_trigger).json(path)


def once(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of key; the state forgets keys that the watermark has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def every(events: DataFrame, step: str, n: int) -> DataFrame:
    """Each n-th step."""
    return events.where(F.col(step) % n == 0)


def windowed(events: DataFrame, value: str, by: list[str], size: str = "1 hour", late: str | None = "1 hour", ts: str = "ts") -> DataFrame:
    """window_start, by, n, mean of value in tumbling windows; events behind the watermark no longer count.

    late is None for a stream that has a watermark, as after once().
    """
    seen = (events.withWatermark(ts, late) if late else events).groupBy(F.window(ts, size).alias("w"), *by)
    return seen.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), *by, "n", "mean")


def running_best(events: DataFrame, run: str, step: str, score: str, min_delta: float, patience: int) -> DataFrame:
    """run, best, best_step, stopped_at for each run that a batch touches, by the rule of reports.early_stop.

    Steps of a run are taken in order within a batch and must not go back between
    batches. The state of a run is four numbers.
    """

    def run_one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, best_step, bad, stopped = state.get if state.exists else (None, None, 0, None)
        rows = pd.concat(list(batches)).sort_values("step")
        for at, value in zip(rows["step"], rows["score"]):
            if stopped is not None or pd.isna(value):
                continue
            if best is None or value > best + min_delta:
                best, best_step, bad = float(value), int(at), 0
            else:
                bad += 1
                stopped = int(at) if bad >= patience else None
        state.update((best, best_step, bad, stopped))
        yield pd.DataFrame({"run": [str(key[0])], "best": [best], "best_step": pd.array([best_step], "Int64"), "stopped_at": pd.array([stopped], "Int64")})

    rows = events.select(F.col(run).cast("string").alias("run"), F.col(step).cast("long").alias("step"), F.col(score).cast("double").alias("score"))
    kind = "run string, best double, best_step long, stopped_at long"
    return rows.groupBy("run").applyInPandasWithState(run_one, kind, "best double, best_step long, bad long, stopped_at long", "update", GroupStateTimeout.NoTimeout)
