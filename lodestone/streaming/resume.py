"""Streams that are stopped and go on: typed state in the state store, and a checkpoint that only its own settings may use."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lodestone.sources.cache import opened, put

STATE = StructType([StructField("best", DoubleType()), StructField("best_step", LongType()), StructField("bad", LongType()), StructField("stopped_at", LongType())])
BEST = StructType([StructField("run", StringType()), *STATE.fields[:2], STATE.fields[3]])
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BestScore(StatefulProcessor):
    """The running best of a run by the rule of reports.early_stop; its state is one row of four numbers."""

    def __init__(self, min_delta: float, patience: int):
        self.min_delta, self.patience = min_delta, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, at, bad, stopped = self.state.get() if self.state.exists() else (None, None, 0, None)
        for step, score in sorted((r.step, r.score) for r in rows if r.score is not None):
            if stopped is not None:
                break
            if best is None or score > best + self.min_delta:
                best, at, bad = score, step, 0
            else:
                bad += 1
                stopped = step if bad >= self.patience else None
        self.state.update((best, at, bad, stopped))
        yield Row(run=key[0], best=best, best_step=at, stopped_at=stopped)

    def close(self) -> None:
        pass


def running_best(events: DataFrame, run: str, step: str, score: str, min_delta: float, patience: int) -> DataFrame:
    """run, best, best_step, stopped_at of each run that a batch touches; steps must not go back between batches, null scores are no steps.

    The state lives in the state store, which the session must have as `STORE` says:
    it is written by difference, and a stream that is started again from its
    checkpoint goes on with it.
    """
    rows = events.select(F.col(run).cast("string").alias("run"), F.col(step).cast("long").alias("step"), F.col(score).cast("double").alias("score"))
    return rows.groupBy("run").transformWithState(BestScore(min_delta, patience), BEST, "Update", "None")


def digest(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def claim(folder: str, settings: dict) -> bool:
    """Whether the checkpoint folder is resumed (true) or new (false); one that other settings have begun is an error.

    The settings' digest lies beside the checkpoint, written whole before the first batch.
    """
    system, root = opened(folder)
    path, told = f"{root}.contract.json", json.dumps({"settings_sha256": digest(settings)}).encode()
    if system.get_file_info(path).is_file:
        with system.open_input_stream(path) as there:
            if there.read() != told:
                raise ValueError(f"{folder} belongs to a stream of other settings")
        return True
    put(system, path, told)
    return False


def latest(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The last row of every key that a stream with `start` has written."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*").drop("batch")


def start(frame: DataFrame, out: str, checkpoint: str, settings: dict) -> StreamingQuery:
    """Writes what is there now, batch by batch, to a folder of Parquet, and ends; the same call later goes on.

    A batch replaces what an earlier try of it has written, so a stop between
    writing and noting a batch repeats no row.
    """
    claim(checkpoint, settings)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    return frame.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
