"""Rules whose result must be empty: every function returns the rows that break one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import texts


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys of more than one row, with their number n."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side (left or right): keys of one table only, each once; none if the key sets are equal."""
    one = left.select(key).distinct().withColumn("_l", F.lit(True))
    two = right.select(key).distinct().withColumn("_r", F.lit(True))
    met = one.join(two, key, "full").where(F.col("_l").isNull() | F.col("_r").isNull())
    return met.select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def _or_error(sound: Column, message: str, *keys: str) -> Column:
    """A filter that keeps sound rows and is an error, naming the key, at others."""
    told = F.concat_ws(" ", F.lit(message), *[F.col(k).cast("string") for k in keys])
    return F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))


def matched(left: DataFrame, right: DataFrame, *keys: str, same: tuple[str, ...] = ()) -> DataFrame:
    """keys, columns of left, and columns of right but `same`: rows of two tables that must have the same keys, each once, and equal `same` columns.

    A key of one side only, a repeated one, and a difference are errors that name the key when rows are read; none is dropped.
    """
    once = Window.partitionBy(*keys)
    one = left.withColumn("_l", F.count("*").over(once))
    two = right.withColumn("_r", F.count("*").over(once)).withColumnsRenamed({c: f"_same_{c}" for c in same})
    met = one.join(two, list(keys), "full")
    sound = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in same], (F.col("_l") == 1) & (F.col("_r") == 1))
    return met.where(_or_error(sound, "unmatched key", *keys)).drop("_l", "_r", *[f"_same_{c}" for c in same])


def two_sided(rows: DataFrame, level: str, low: str, high: str, value: str, *keys: str, same: tuple[str, ...] = ()) -> DataFrame:
    """keys, same, effect: value at the high level less that at the low one; rows of other levels play no part.

    A key with one of the two levels only, with one of them twice, or whose `same` columns differ, is an error that names it.
    """
    at = lambda s, f: f(F.when(F.col(level) == s, F.col(value)))
    here = lambda s: F.count_if(F.col(level) == s)
    each = rows.where(F.col(level).isin(low, high)).groupBy(*keys).agg(
        here(low).alias("_n"), here(high).alias("_m"), (at(high, F.max) - at(low, F.max)).alias("effect"),
        *[f(c).alias(f"_{k}_{c}") for c in same for k, f in (("a", F.min), ("b", F.max))],
    )
    sound = reduce(lambda a, b: a & b, [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in same], (F.col("_n") == 1) & (F.col("_m") == 1))
    return each.where(_or_error(sound, f"no pair of {low} and {high} for", *keys)).select(*keys, *[F.col(f"_a_{c}").alias(c) for c in same], "effect")


def missing(needed: DataFrame, found: DataFrame, *key: str, k: int | None = None) -> DataFrame:
    """Keys of needed that found lacks; with k the first k of them as a report's examples."""
    gone = needed.select(*key).distinct().join(found.select(*key), list(key), "left_anti")
    return gone if k is None else gone.orderBy(*key).limit(k)


def mismatches(expected: DataFrame, actual: DataFrame, key: list[str], fields: list[str], tolerance: float | None = None) -> DataFrame:
    """key, field, expected, actual (as text): fields that differ between rows of a key, and rows of one side (field: row).

    With a tolerance t numbers agree within t + t * |actual|; else, and for nulls, values must be equal.
    """
    both = expected.select(*key, F.struct(*fields).alias("_e")).join(actual.select(*key, F.struct(*fields).alias("_a")), key, "full")

    def differs(f: str) -> Column:
        e, a = F.col(f"_e.`{f}`"), F.col(f"_a.`{f}`")
        if tolerance is None:
            return ~e.eqNullSafe(a)
        near = F.abs(e - a) <= tolerance + tolerance * F.abs(a)
        return F.when(e.isNull() | a.isNull(), ~e.eqNullSafe(a)).otherwise(~near)

    said = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"_e.`{f}`").cast("string").alias("expected"), F.col(f"_a.`{f}`").cast("string").alias("actual"))
    whole = F.struct(F.lit("row").alias("field"), F.when(F.col("_e").isNotNull(), "present").alias("expected"), F.when(F.col("_a").isNotNull(), "present").alias("actual"))
    each = F.when(F.col("_e").isNull() | F.col("_a").isNull(), F.array(whole)).otherwise(F.array_compact(F.array(*[F.when(differs(f), said(f)) for f in fields])))
    return both.select(*key, F.inline(each))


def grid_difference(rows: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """levels, side: cells of the full grid that rows lack (missing) and cells of rows outside it (extra)."""
    grid = rows.sparkSession.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in levels.items()])
    for k in levels:
        grid = grid.withColumn(k, F.explode(k))
    here = rows.select(*levels).distinct()
    return grid.join(here, [*levels], "left_anti").withColumn("side", F.lit("missing")).unionByName(here.join(grid, [*levels], "left_anti").withColumn("side", F.lit("extra")))


def split_contract(rows: DataFrame, key: str, group: str, role: str, label: str, roles: list[str], least: int) -> DataFrame:
    """rule, subject: keys that repeat, roles out of the list, roles without a label of the data, groups of several roles, roles below least rows."""
    text = lambda c: F.col(c).cast("string")
    told = lambda frame, rule, subject: frame.select(F.lit(rule).alias("rule"), subject.alias("subject"))
    labels = rows.select(label).distinct()
    cells = rows.select(role).distinct().join(F.broadcast(labels)) if labels.limit(10_001).count() <= 10_000 else rows.select(role).distinct().crossJoin(labels)
    found = [
        told(repeated(rows, key), "repeated key", text(key)),
        told(rows.select(role).distinct().where(~F.col(role).isin(roles)), "unknown role", text(role)),
        told(missing(cells, rows, role, label), "class without rows", F.concat_ws(":", role, label)),
        told(rows.groupBy(group).agg(F.count_distinct(role).alias("n")).where("n > 1"), "group of several roles", text(group)),
        told(rows.groupBy(role).agg(F.count("*").alias("n")).where(F.col("n") < least), "small role", text(role)),
    ]
    return reduce(DataFrame.unionByName, found)


def unexplained_access(log: DataFrame, subject: str, order: list[str], reason: Column) -> DataFrame:
    """Rows of a log after a subject's first in order that give no reason."""
    again = F.row_number().over(Window.partitionBy(subject).orderBy(*order)) > 1
    return log.withColumn("_again", again).where(F.col("_again") & ~F.coalesce(reason, F.lit(False))).drop("_again")


def same_person(rows: DataFrame, key: str, people: list[str]) -> DataFrame:
    """key of rows whose people are not as many different names; blanks and case do not tell names apart."""
    names = F.array_distinct(F.filter(F.array(*[texts.decision(F.col(c)) for c in people]), lambda x: x.isNotNull() & (x != "")))
    return rows.where(F.size(names) < len(people)).select(key)


def gaps(rows: DataFrame, run: str, step: str) -> DataFrame:
    """run, step, problem: steps that repeat, and steps that do not follow the one before by one (per run)."""
    seen = rows.groupBy(run, step).agg(F.count("*").alias("n"))
    before = F.lag(step).over(Window.partitionBy(run).orderBy(step))
    problem = F.when(F.col("n") > 1, "repeated").when(F.col(step) != before + 1, "gap")
    return seen.select(run, step, problem.alias("problem")).where("problem IS NOT NULL")


def preflight(plan: DataFrame, step_seconds: str, steps: str, epochs: str, batch: str, world: str, memory: str, budget_hours: float, budget_memory: float) -> DataFrame:
    """plan with hours, batch_per_rank, memory_per_rank and the gates divisible, in_time, in_memory, passed."""
    hours = F.col(step_seconds) * F.col(steps) * F.col(epochs) / 3600
    each = F.floor(F.col(batch) / F.col(world)).cast("long")
    need = F.col(memory) * each
    gates = [(F.col(batch) % F.col(world) == 0).alias("divisible"), (hours <= budget_hours).alias("in_time"), (need < budget_memory).alias("in_memory")]
    return plan.select("*", hours.alias("hours"), each.alias("batch_per_rank"), need.alias("memory_per_rank"), *gates).withColumn("passed", F.expr("divisible AND in_time AND in_memory"))
