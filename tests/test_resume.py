"""A stream in two halves against the whole, and checkpoints of other settings."""

import json
import os

import pytest

from lodestone.operators import reports
from lodestone.streaming import events, resume

KIND = "run string, step long, score double"


@pytest.fixture()
def store(spark):
    spark.conf.set(*resume.STORE)
    yield
    spark.conf.unset(resume.STORE[0])


def write(folder, data, k):
    folder.mkdir(exist_ok=True)
    part = data[k * 20 : k * 20 + 20]
    (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("run", "step", "score"), d))) for d in part) + "\n")
    os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def go(spark, folder, tmp_path, name, settings):
    best = resume.running_best(events.tail(spark, str(folder), KIND, 1), "run", "step", "score", settings["min_delta"], settings["patience"])
    query = resume.start(best, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"), settings)
    assert query.awaitTermination(120)
    return sorted(tuple(r) for r in resume.latest(spark, str(tmp_path / f"{name}-out"), "run").collect())


def test_two_halves_are_the_whole(spark, store, tmp_path):
    data = [(f"r{i % 3}", i, [0.1, 0.5, 0.4, 0.9, 0.9, 0.2, None][(i * 5 + i // 7) % 7]) for i in range(80)]
    settings = {"min_delta": 0.05, "patience": 12}
    for k in range(4):
        write(tmp_path / "all", data, k)
    whole = go(spark, tmp_path / "all", tmp_path, "whole", settings)
    for k in (0, 1):
        write(tmp_path / "log", data, k)
    half = go(spark, tmp_path / "log", tmp_path, "parts", settings)
    for k in (2, 3):
        write(tmp_path / "log", data, k)
    assert go(spark, tmp_path / "log", tmp_path, "parts", settings) == whole != half
    batch = reports.early_stop(spark.createDataFrame(data, KIND), "run", "step", "score", 0.05, 12)
    assert sorted(tuple(r) for r in batch.collect()) == whole
    assert go(spark, tmp_path / "log", tmp_path, "parts", settings) == whole  # nothing new: nothing changes


def test_a_checkpoint_of_other_settings_is_refused(spark, tmp_path):
    folder = str(tmp_path / "checkpoint")
    assert not resume.claim(folder, {"min_delta": 0.1, "patience": 3})
    assert resume.claim(folder, {"patience": 3, "min_delta": 0.1})
    with pytest.raises(ValueError, match="other settings"):
        resume.claim(folder, {"min_delta": 0.1, "patience": 4})
