"""No table that grows with the documents is broadcast by operator 4 and by components."""

from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.operators import components


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    texts = spark.range(300).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.hash(F.col("id") % 100, k).cast("string")), " ").alias("text"))
    docs = texts.withColumnRenamed("id", "doc_id").localCheckpoint()
    plans = []

    def seen(df, label, step=simhash.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return step(df, label)

    monkeypatch.setattr(simhash, "materialize", seen)
    monkeypatch.setattr(components, "materialize", seen)
    found = simhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.component_id: r.n for r in found.groupBy("component_id").agg(F.count("*").alias("n")).collect()} == {k: 3 for k in range(100)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
