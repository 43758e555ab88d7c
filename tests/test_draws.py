"""Draws of groups: counts against plain Python, and plans that keep draws out of the driver."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import detectors, inference


def plain(prefix: str, n: int) -> Counter:
    return Counter(int(hashlib.sha256(f"{prefix}{i}".encode()).hexdigest()[:16], 16) % n for i in range(n))


@pytest.mark.parametrize("counted", [inference.COUNTED, 10])
def test_draws_are_those_of_the_hash(spark, counted):
    lots = spark.createDataFrame([(k, f"7\0{k}\0", n) for k, n in enumerate([1, 7, 999, 1000, 1001, 2500])], "k int, _prefix string, _n long")
    got = {(r.k, r.number): r.weight for r in inference.drawn(lots, "k", most=2500, counted=counted).collect()}
    assert got == {(k, x): w for k, n in enumerate([1, 7, 999, 1000, 1001, 2500]) for x, w in plain(f"7\0{k}\0", n).items()}


def test_draws_of_no_and_one_group(spark):
    groups = spark.range(1)
    assert inference.draws(groups.where("id < 0"), 20, 1).count() == 0
    assert {tuple(r) for r in inference.draws(groups, 3, 1).collect()} == {(0, 0, 1), (1, 0, 1), (2, 0, 1)}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("draws") / "rows")
    spark.range(40_000).selectExpr("id DIV 4 AS g", "id % 2 AS y", "hash(id) % 11 AS a", "hash(id + 1) % 7 AS b", "id % 3 AS seed").write.parquet(path)
    return spark.read.parquet(path)


FORMS = {
    "cluster": lambda r: inference.cluster_bootstrap(r, "g", "a", replicates=100),
    "cells": lambda r: inference.cluster_bootstrap(r, "g", "a", "seed", replicates=100),
    "ratio": lambda r: inference.bootstrap(r, "g", {"a": F.sum("a"), "n": F.count("*")}, inference.of_sums(F.col("a") / F.col("n")), replicates=100),
    "precision": lambda r: inference.clustered_ap(r, "g", "y", "a", replicates=100),
    "delta": lambda r: detectors.clustered_delta(r, "g", "y", "a", "b", replicates=100),
    "two levels": lambda r: inference.two_level_bootstrap(r, "seed", "g", "a", replicates=20),
}


@pytest.mark.parametrize("form", FORMS)
def test_draws_are_never_the_broadcast_side(spark, rows, form, monkeypatch):
    found = {}
    for most in (inference.BROADCAST, 0):
        monkeypatch.setattr(inference, "BROADCAST", most)
        plans = []
        step = inference.drawn_states

        def seen(*args, step=step, plans=plans):
            met = step(*args)
            plans.append(met._jdf.queryExecution().executedPlan().toString())
            return met

        with monkeypatch.context() as patch:
            patch.setattr(inference, "drawn_states", seen)
            patch.setattr(detectors, "drawn_states", seen)
            found[most] = sorted(map(tuple, FORMS[form](rows).collect()))
        assert plans and all("BuildLeft" not in p and ("SortMergeJoin" if not most else "BuildRight") in p for p in plans)
    one, two = found.values()
    assert len(one) == len(two) and all(x == pytest.approx(y, rel=1e-12) for x, y in zip(one, two))
