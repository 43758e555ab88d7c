"""Nested metrics to a wide table, and attention rollout against plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import attention, images
from lodestone.sources import nested

DOCUMENTS = [
    ("m1", {"conditions": {"gain:mild": {"count": 3, "acc": 0.5, "bins": [1, 2], "ok": True}, "mix:a:b": {"count": 4, "acc": 1, "note": "x"}}}),
    ("m2", {"conditions": {"sham": {"count": None, "acc": 2e-3, "bins": []}}, "other": 1}), ("m3", {"conditions": {}}),
]


def test_nested_metrics(spark):
    rows = spark.createDataFrame([(m, json.dumps(d)) for m, d in DOCUMENTS], "model string, doc string")
    found = nested.entries(rows, "doc", "conditions", "model")
    assert nested.kinds(found) == [("acc", "double"), ("bins", "string"), ("count", "long"), ("note", "string"), ("ok", "boolean")]
    got = {tuple(r) for r in nested.wide(found, "model").collect()}
    assert got == {("m1", "gain", "mild", 0.5, "[1,2]", 3, None, True), ("m1", "mix", "a:b", 1.0, None, 4, "x", None), ("m2", "sham", None, 0.002, "[]", None, None, None)}


@pytest.mark.parametrize("bad", ['{"x": 1}', "no json", '{"conditions": [1]}'])
def test_documents_without_metrics_are_errors(spark, bad):
    with pytest.raises(Exception, match="conditions|MALFORMED"):
        nested.entries(spark.createDataFrame([("m", bad)], "model string, doc string"), "doc", "conditions", "model").collect()


def test_rollout_by_loops(spark):
    rng = np.random.default_rng(3)
    q, k = rng.normal(size=(2, 3, 2, 5, 4))  # three layers of two heads, five tokens
    wire = lambda a: (list(a.shape), a.ravel().tolist())
    kind = "struct<shape:array<int>,values:array<double>>"
    rows = spark.createDataFrame([(i, wire(q[i]), wire(k[i])) for i in range(3)], f"i int, q {kind}, k {kind}")
    got = {r.i: np.array(r.w["values"]).reshape(r.w["shape"]) for r in rows.select("i", attention.weights(F.col("q"), F.col("k")).alias("w")).collect()}
    for i in range(3):
        by_hand = np.zeros((5, 5))
        for h in range(2):
            for a in range(5):
                e = np.exp([q[i, h, a] @ k[i, h, b] / 2 for b in range(5)])
                by_hand[a] += e / e.sum() / 2
        assert np.allclose(got[i], by_hand)
    stack = np.stack([got[i] for i in range(3)])
    joint = np.eye(5)
    for w in stack:
        joint = (w + np.eye(5)) / (w + np.eye(5)).sum(1, keepdims=True) @ joint
    grid, heat = joint[0, 1:].reshape(2, 2), np.zeros((4, 6))
    for y in range(4):
        for x in range(6):
            v, u = min(max((y + 0.5) / 2 - 0.5, 0), 1), min(max((x + 0.5) / 3 - 0.5, 0), 1)
            heat[y, x] = grid[0, 0] * (1 - v) * (1 - u) + grid[0, 1] * (1 - v) * u + grid[1, 0] * v * (1 - u) + grid[1, 1] * v * u
    layers = spark.createDataFrame([(0, wire(stack)), (1, None), (2, wire(np.full((1, 5, 5), 0.2)))], f"i int, layers {kind}")
    found = {r.i: r.m for r in layers.select("i", attention.rollout(F.col("layers"), 4, 6).alias("m")).collect()}
    assert np.allclose(np.array(found[0]["values"]).reshape(4, 6), (heat - heat.min()) / (heat.max() - heat.min()))
    assert found[1] is None and not any(found[2]["values"])
    with pytest.raises(Exception, match="square grid"):
        spark.createDataFrame([(0, wire(np.ones((1, 4, 4))))], f"i int, layers {kind}").select(attention.rollout(F.col("layers"), 4, 4)).collect()


def test_stretching_downwards_takes_the_two_nearest():
    line = np.arange(8.0)[None, :]
    assert np.allclose(attention.stretched(line, 1, 4), [[0.5, 2.5, 4.5, 6.5]]) and np.allclose(attention.stretched(line, 1, 8), line)
    assert images.linear(np.array([0.0, 0.5, 2.0])).tolist() == [1.0, 0.5, 0.0]
