"""Results that must agree with their SQL to the last bit: ranks of values computed again, half cents, keys made of several."""

import random

import duckdb
from pyspark.sql import functions as F

from lodestone.operators import inference, metrics
from lodestone.plans import catalogue, studies  # noqa: F401


def test_ranks_of_values_that_differ_when_computed_again(spark):
    again = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("g")).withColumn("v", again() - 0.5)
    assert metrics.midranks(rows, "v", "rank", "g").count() == 300
    assert {r.n for r in inference.wilcoxon(rows, "v", "g").collect()} == {100}
    assert inference.holm(rows.withColumn("v", again()), "v", "g").where("holm_p IS NULL").count() == 0


def compared(spark, folder, name, **tables):
    for t, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.QUERIES[name](spark, str(folder)).collect())), sorted(duckdb.sql(catalogue.ORACLE_SQL[name]).fetchall())


def test_signed_ranks_of_half_cents(spark, tmp_path):
    prices = [(1, "F", 1.00), (1, "F", 1.01), (1, "O", 0.0), (2, "F", 0.0), (2, "O", 1.0), (3, "F", 2.0), (3, "O", 0.5)]
    orders = spark.createDataFrame([(k, "5-LOW", s, p) for k, s, p in prices], "o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    got, wanted = compared(spark, tmp_path, "wilcoxon_stat", orders=orders)
    assert got == wanted


def test_first_price_with_part_keys_beyond_a_million(spark, tmp_path):
    lines = [(1, 1, 1_200_001, 1, 5.0), (1, 2, 1, 1, 7.0), (2, 3, 4, 10_001, 8.0), (2, 3, 5, 2, 9.0), (3, 1, 1, 1, 1.5)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
    got, wanted = compared(spark, tmp_path, "first_per_source", lineitem=rows)
    assert got == wanted and (1, 1, 7.0) in got
