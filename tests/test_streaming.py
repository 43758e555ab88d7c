"""Event streams against the batch rules, over several triggers."""

import json
import os

import pytest

from lodestone.operators import reports
from lodestone.sources import rows
from lodestone.streaming import events

KIND = "run string, step long, score double, ts timestamp"


@pytest.fixture()
def log(spark, tmp_path):
    data = [(f"r{i % 3}", i, [0.1, 0.5, 0.4, 0.9, 0.9, 0.2, None][(i * 5 + i // 7) % 7], f"2024-01-01T{i // 6:02d}:{i % 6 * 10:02d}:00Z") for i in range(60)]
    path = tmp_path / "log"
    path.mkdir()
    for k in range(4):
        lines = [json.dumps(dict(zip(("run", "step", "score", "ts"), d))) for d in data[k * 15 : k * 15 + 15]]
        (path / f"{k}.json").write_text("\n".join(lines + lines[:2]) + "\n")
        os.utime(path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order of arrival
    return str(path)


def drain(spark, frame, mode, tmp_path, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_repeats_and_windows(spark, log, tmp_path):
    tail = events.tail(spark, log, KIND, 1)
    batch = rows.read_jsonl(spark, log, KIND)
    assert batch.count() == 68
    assert sorted(r.step for r in drain(spark, events.once(tail, ["run", "step"]), "append", tmp_path, "once")) == list(range(60))
    assert {r.step for r in drain(spark, events.every(tail, "step", 7), "append", tmp_path, "every")} == set(range(0, 60, 7))
    got = drain(spark, events.windowed(events.once(tail, ["run", "step"]), "score", ["run"], late=None), "append", tmp_path, "win")
    assert len(got) >= 18 and all(r.n == 2 for r in got)  # windows that the watermark has passed


def test_running_best(spark, log, tmp_path):
    seen = {r.run: tuple(r)[1:] for r in drain(spark, events.running_best(events.tail(spark, log, KIND, 1), "run", "step", "score", 0.05, 6), "update", tmp_path, "best")}
    batch = rows.read_jsonl(spark, log, KIND).where("score IS NOT NULL")
    assert seen == {r.run: tuple(r)[1:] for r in reports.early_stop(batch, "run", "step", "score", 0.05, 6).collect()}
