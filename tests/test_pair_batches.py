"""Pairs are computed in batches, spread by their rows, with the results of the column expressions."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import pairs


def test_batches_spread_and_agree_with_the_expressions(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i * 3 - 9, i % 3, [float(x) for x in rng.normal(size=9)]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(pairs, "TASK", 8, raising=False)
    found = pairs.pairs(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    sample = pairs.samples(spark, str(tmp_path))
    centres = pairs.centroids(sample)
    each = pairs.expand(pairs.neighbours(sample).withColumn("p", pairs.probabilities(F.col("e"), centres)))
    each = each.withColumn("t", pairs.changed(F.col("e"), F.col("d"), F.col("family"), F.col("strength"), F.col("vec_id")))
    each = each.withColumn("q", pairs.probabilities(F.col("t"), centres))
    told = lambda df: {(r.vec_id, r.family, r.severity, r.ordinal, r.label): (*r.p, *r.t, *r.q) for r in df.collect()}
    got, want = told(found), told(each)
    assert len(got) == 360 and got.keys() == want.keys()
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-14) for k in want for a, b in zip(got[k], want[k], strict=True))
