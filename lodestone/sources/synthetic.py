"""Rows that follow from a seed: class images as pixel arrays, and reviews of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pixel_images(spark: SparkSession, classes: int, each: int, size: int = 64, seed: int = 4) -> DataFrame:
    """image_id, label, pixels (size * size * 3 numbers of 0 to 255, uniform, shifted by class and cut at 255)."""
    rows = spark.range(classes * each).select(F.col("id").alias("image_id"), F.expr(f"CAST(id DIV {each} AS INT)").alias("label"))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("image_id"), k), F.lit(256)).cast("int")
    shift = (F.col("label") * (64 // max(classes, 1))).cast("int")
    return rows.withColumn("pixels", F.transform(F.sequence(F.lit(1), F.lit(size * size * 3)), lambda k: F.least(draw(k) + shift, F.lit(255))))


def filled_reviews(rows: DataFrame, key: str, *cell: str) -> DataFrame:
    """rows with first, second, final: both raters accept all but the first row (by key) of each cell, which is settled as accepted."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(key))
    said = F.when(rank == 1, "reject").otherwise("accept")
    return rows.withColumn("first", said).withColumn("second", F.col("first")).withColumn("final", F.lit("accept"))
