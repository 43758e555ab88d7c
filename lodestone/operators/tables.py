"""Publication tables: wide and flat forms, gates, markers, summaries by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import inference


def heat_map(rows: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """row, a column for each of values: the mean of value."""
    return rows.groupBy(row).pivot(column, values).agg(F.avg(value))


def mean_sd(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, mean, sd (sample; 0 for one row)."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def throughput(rows: DataFrame, model: str, seed: str, items: str, seconds: str, seeds: int) -> DataFrame:
    """model, rate (mean of the seeds' items by second), pooled, defined: null unless every seed has a time."""
    each = rows.groupBy(model, seed).agg(F.sum(items).alias("i"), F.sum(seconds).alias("t"), F.count_if(F.col(seconds).isNull() | (F.col(seconds) <= 0)).alias("bad"))
    sums = each.groupBy(model).agg(F.avg(F.try_divide("i", "t")).alias("rate"), F.try_divide(F.sum("i"), F.sum("t")).alias("pooled"), ((F.count("*") == seeds) & (F.sum("bad") == 0)).alias("defined"))
    return sums.select(model, F.when(F.col("defined"), F.col("rate")).alias("rate"), F.when(F.col("defined"), F.col("pooled")).alias("pooled"), "defined")


def significance(rejected: Column, lower: Column, upper: Column) -> Column:
    """"*" where a corrected test rejects and the interval leaves zero out, else empty."""
    return F.when(rejected & ((lower > 0) | (upper < 0)), "*").otherwise("")


def flat(rows: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """name (keys and column with slashes), value of every number that is not null."""
    long = rows.unpivot(keys, numbers, "metric", "value").where("value IS NOT NULL")
    return long.select(F.concat_ws("/", *keys, "metric").alias("name"), F.col("value").cast("double").alias("value"))


def populated(bins: DataFrame) -> DataFrame:
    """x (mean confidence), y (accuracy) of the bins that hold rows."""
    return bins.where("n > 0").select("bin", F.col("confidence").alias("x"), F.col("accuracy").alias("y"))


def with_sentinel(rows: DataFrame, **values: object) -> DataFrame:
    """rows, or one row of the given values (others null) if there are none."""
    one = rows.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in rows.dtypes])
    here = rows.limit(1).select(F.lit(1).alias("_here"))
    return rows.unionByName(one.join(F.broadcast(here), F.lit(True), "left_anti"))


def effects(rows: DataFrame, keys: list[str], severity: str, value: str, low: str, high: str) -> DataFrame:
    """keys, effect: mean of value at the high severity less that at the low one, where both are there."""
    at = lambda s: F.avg(F.when(F.col(severity) == s, F.col(value)))
    return rows.groupBy(*keys).agg((at(high) - at(low)).alias("effect")).where("effect IS NOT NULL")


def contrasts(found: DataFrame, cell: list[str], family: str, group: str, value: str = "effect", replicates: int = 2000) -> DataFrame:
    """cell, groups, estimate, lower, upper, statistic, rank_biserial, p_value, holm_p, holm_rejected of every cell.

    Intervals draw whole groups, the same ones for every cell; the signed-rank test
    takes a group's mean; Holm's correction is made within what cell holds beside family.
    """
    ends = inference.cluster_bootstrap(found, group, value, *cell, replicates=replicates)
    means = found.groupBy(*cell, group).agg(F.avg(value).alias("_d"))
    tests = inference.wilcoxon(means, "_d", *cell).select(*cell, "statistic", "rank_biserial", "p_value")
    return inference.holm(ends.join(tests, cell, "left"), "p_value", *[c for c in cell if c != family])


def model_differences(found: DataFrame, model: str, first: str, second: str, keys: list[str]) -> DataFrame:
    """keys, difference of effect between two models; a key of one model only is an error when read."""
    met = found.groupBy(*keys).agg(F.avg(F.when(F.col(model) == first, F.col("effect"))).alias("a"), F.avg(F.when(F.col(model) == second, F.col("effect"))).alias("b"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *keys)).cast("double")
    return met.select(*keys, (F.coalesce("b", lost) - F.coalesce("a", lost)).alias("effect"))


def seed_estimates(rows: DataFrame, by: list[str], seed: str, value: str, seeds: int) -> DataFrame:
    """by, by_seed (map), mean, sd, defined (a value of every seed)."""
    each = rows.groupBy(*by, seed).agg(F.avg(value).alias("v"))
    told = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(seed).alias("key"), F.col("v").alias("value")))))  # a row for each seed
    return each.groupBy(*by).agg(told.alias("by_seed"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), (F.count("v") == seeds).alias("defined"))
