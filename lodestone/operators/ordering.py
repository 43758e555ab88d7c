"""Running aggregates and order statistics over a whole table or its groups, range by range."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

SMALL = 1_000_000  # rows up to which one window is the cheaper plan; results are the same


def same(one: str, two: str, by: tuple[str, ...]) -> Column:
    """Whether two frames' rows are of one group; null is a group like others."""
    tests = [F.col(f"{one}.`{c}`").eqNullSafe(F.col(f"{two}.`{c}`")) for c in by]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


Values = Column | dict[str, Column]


def before(rows: DataFrame, fold: Callable[[Column | str], Column], value: Values, *order: str | Column, out: str = "total", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with out: fold (F.sum, F.max or F.min) of value over all rows of the same group (by) before this one in order (unique); null for the first.

    With a dict of values, a column for each. The table is range-partitioned by
    group and order and written; each range is folded, and only groups that lie on
    several ranges (two for each border at most, with a row for each range) meet
    again, so neither a whole table nor a large group is sorted or scanned in one task.
    """
    values = value if isinstance(value, dict) else {out: value}
    placed = rows.withColumns({f"_v_{k}": v for k, v in values.items()})
    folded = lambda k, window: fold(f"_v_{k}").over(window)
    if by and (placed := materialize(placed, "rows")).count() <= SMALL:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return placed.withColumns({k: folded(k, window) for k in values}).drop(*[f"_v_{k}" for k in values])
    placed = materialize(placed.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*by, "_range").agg(*[fold(f"_v_{k}").alias(f"_v_{k}") for k in values])
    if by:
        several = sums.groupBy(*by).agg(F.count("*").alias("_ranges")).where("_ranges > 1")
        sums = sums.alias("s").join(several.alias("g"), same("s", "g", by), "left_semi")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(*by, "_range", *[folded(k, earlier).alias(f"_b_{k}") for k in values])
    window = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"_i_{k}": folded(k, window) for k in values}).alias("p")
    met = inside.join(F.broadcast(ranges.alias("r")), same("p", "r", (*by, "_range")), "left").select("p.*", *[f"r.`_b_{k}`" for k in values])
    join = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}[fold.__name__]
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join(a, b))
    done = met.withColumns({k: both(F.col(f"_i_{k}"), F.col(f"_b_{k}")) for k in values})
    return done.drop("_range", *[f"_{x}_{k}" for x in "vib" for k in values])


def numbered(rows: DataFrame, *order: str | Column, out: str = "number", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with out: 0, 1, ... in order (unique), in each group."""
    found = before(rows, F.sum, F.lit(1).cast("long"), *order, out=out, by=by)
    return found.withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def counts(rows: DataFrame, value: str, *by: str, order: Column | None = None, **sums: Column) -> DataFrame:
    """by, value, n and the sums of every distinct value that is not null, and of all values before it in order (ascending): n_before and <sum>_before."""
    levels = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    placed = before(levels, F.sum, {f"{k}_before": F.col(k) for k in ("n", *sums)}, F.col(value) if order is None else order, by=by)
    return placed.withColumns({f"{k}_before": F.coalesce(f"{k}_before", F.lit(0)) for k in ("n", *sums)})


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """by and a column for each share: the exact quantile of the values of a group, between two neighbours by their distance; nulls do not count.

    Values are counted, the counts are summed up range by range, and each quantile
    reads the two values that its place falls on: groups of any size go over many tasks.
    """
    levels = counts(rows, value, *by)
    totals = levels.groupBy(*by).agg(F.sum("n").alias("_all"))
    met = levels.alias("l").join(totals.alias("t"), same("l", "t", by)).select("l.*", "t._all")
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    at = lambda k: F.min(F.when(F.col("n_before") + F.col("n") > k, F.col(value)))
    ends = met.groupBy(*by).agg(F.first("_all").alias("_all"), *[f for k, q in shares.items() for f in (at(F.floor(place(q))).alias(f"_{k}_low"), at(F.ceil(place(q))).alias(f"_{k}_high"))])
    part = lambda q: place(q) - F.floor(place(q))
    read = lambda k, q: F.when(F.col(f"_{k}_low") == F.col(f"_{k}_high"), F.col(f"_{k}_low")).otherwise((1 - part(q)) * F.col(f"_{k}_low") + part(q) * F.col(f"_{k}_high"))
    return ends.select(*by, *[read(k, q).cast("double").alias(k) for k, q in shares.items()])
