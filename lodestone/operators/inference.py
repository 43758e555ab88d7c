"""Resampling, paired tests and corrections for many tests."""

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions import ids
from lodestone.operators.metrics import midranks
from lodestone.operators.ordering import before, counts, numbered, same
from lodestone.storage import materialize


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b of two tables with the same keys; a key of one side only is an error when the rows are read."""
    met = left.select(key, F.col(value).alias("a"), F.lit(True).alias("_l")).join(right.select(key, F.col(value).alias("b"), F.lit(True).alias("_r")), key, "full")
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    return met.select(key, F.when(bad, F.raise_error(F.concat(F.lit("unpaired key "), F.col(key).cast("string"))).cast("double")).otherwise(F.col("a")).alias("a"), "b")


COUNTED = 1 << 22  # numbers up to which a task counts a lot by itself, in two arrays of that length
BROADCAST = 1_000_000  # rows of states up to which they are sent to all tasks


def _counts(lots: DataFrame, keys: list[str]) -> DataFrame:
    """As drawn, each lot counted in its task and passed on in slices."""
    low = [b"%03d" % i for i in range(1000)]

    def numbers(prefix: bytes, n: int) -> np.ndarray:
        found = np.empty(n, np.int64)
        for at in range(0, n, 1000):  # slots that share all but three digits
            start = hashlib.sha256(prefix + (b"%d" % (at // 1000) if at else b""))
            digests = []
            for i in range(min(1000, n - at)):
                h = start.copy()
                h.update(low[i] if at else b"%d" % i)
                digests.append(h.digest())
            words = np.frombuffer(b"".join(digests), ">u8")[::4].astype(np.uint64)
            found[at : at + len(words)] = words % np.uint64(n)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                weight = np.bincount(numbers(row["_prefix"].encode(), row["_n"]))
                number = np.flatnonzero(weight)
                for at in range(0, len(number), 1 << 16):
                    part = number[at : at + (1 << 16)]
                    own = [pa.array(np.full(len(part), row[k], kinds[k])) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(part), pa.array(weight[part])], [*keys, "number", "weight"])

    kinds = {k: {"int": np.int32, "bigint": np.int64}[kind] for k, kind in lots.dtypes if k in keys}
    told = ", ".join(f"{k} {kind}" for k, kind in lots.dtypes if k in keys)
    return lots.select(*keys, "_prefix", "_n").mapInArrow(run, f"{told}, number long, weight long")


def drawn(lots: DataFrame, *keys: str, most: int, counted: int = COUNTED) -> DataFrame:
    """keys (whole numbers), number, weight of lots (keys, _prefix, _n): how often the hashes of _prefix and the slots below _n pick each number below _n.

    A lot of up to `counted` slots (most: the largest) is counted in one task, so draws
    are neither shuffled nor held as rows; larger ones are drawn as rows and counted by partial aggregates.
    """
    if most <= counted:
        return _counts(lots, list(keys))
    block = 1 << 20
    blocks = lots.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((_n - 1) DIV {block} AS INT)")))).repartition(max(200, most // block))
    first = F.col("_block").cast("long") * block
    slots = blocks.select(*keys, "_prefix", "_n", F.explode(F.sequence(first, F.least(first + block, F.col("_n")) - 1)).alias("_slot"))
    number = ids.choice(F.sha2(F.concat("_prefix", F.col("_slot").cast("string")), 256), F.col("_n"))
    return slots.select(*keys, number.alias("number")).groupBy(*keys, "number").agg(F.count("*").alias("weight"))


def draws(groups: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate, number, weight: how often the hash draws each of the groups numbered from 0, as many draws as groups."""
    spark, n = groups.sparkSession, groups.count()
    tasks = max(spark.sparkContext.defaultParallelism, min(replicates, n * replicates >> 20))
    prefix = F.concat_ws("\0", F.lit(str(seed)), "id", F.lit(""))
    lots = spark.range(0, replicates if n else 0, 1, tasks).select(F.col("id").cast("int").alias("replicate"), prefix.alias("_prefix"), F.lit(n).cast("long").alias("_n"))
    return drawn(lots, "replicate", most=n)


def drawn_states(states: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """states and weights joined by key.

    The planner takes weights for a small table, as they come from a range, and would send all of
    them to the driver: so states are sent to the tasks, or both are sorted if they are many.
    """
    states = materialize(states, "states")
    return weights.join(F.broadcast(states) if states.count() <= BROADCAST else states.hint("merge"), key)


Statistic = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def resampled(rows: DataFrame, group: str, states: dict[str, Column], *levels: str, by: tuple[str, ...] = (), replicates: int = 2000, seed: int = 1) -> DataFrame:
    """by, levels, replicate and the states of every replicate: sums over groups, each as often as it is drawn; replicate -1 is the data themselves.

    A state is an aggregate that adds up over rows (F.sum, F.count, F.sum of products). Groups
    are reduced to their states before they meet their draws, and draws are the same for all cells of by.
    """
    sums = rows.groupBy(*by, *levels, F.col(group).alias("_group")).agg(*[c.alias(k) for k, c in states.items()])
    groups = materialize(numbered(sums.select("_group").distinct(), "_group"), "groups")
    weights = draws(groups, replicates, seed).unionByName(groups.select(F.lit(-1).alias("replicate"), "number", F.lit(1).cast("long").alias("weight")))
    met = drawn_states(sums.join(groups, "_group").drop("_group"), weights, "number")
    return met.groupBy(*by, "replicate", *levels).agg(*[F.sum(F.col("weight") * F.col(k)).alias(k) for k in states])


def of_sums(value: Column) -> Statistic:
    """A statistic that is an expression of the states' sums: a mean, a ratio, a variance, a correlation."""
    return lambda sums, keys: sums.select(*keys, value.alias("value"))


def of_levels(score: str, positives: str = "pos", n: str = "cnt", area: str = "ap") -> Statistic:
    """Average precision ("ap") or the area under the ROC curve ("auroc") over levels of a score, from their positives and numbers."""
    from lodestone.operators.detectors import ranked_areas

    def found(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        levels = sums.select(*keys, F.col(score).alias("s"), F.col(positives).alias("pos"), F.col(n).alias("cnt")).where("cnt > 0")
        return ranked_areas(levels, *keys).select(*keys, F.col(area).alias("value"))

    return found


def of_function(f: Callable[[pd.DataFrame], float | None]) -> Statistic:
    """Any function of a replicate's rows of states (one for each level), which must fit a task; None where it is undefined."""

    def found(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        kinds = ", ".join(f"`{k}` {kind}" for k, kind in sums.dtypes if k in keys)

        def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*key, f(part)]], columns=[*keys, "value"]).astype({"value": "float64"})

        return sums.groupBy(*keys).applyInPandas(one, f"{kinds}, value double")

    return found


def bootstrap(rows: DataFrame, group: str, states: dict[str, Column], statistic: Statistic, *levels: str, by: tuple[str, ...] = (), replicates: int = 2000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """by, estimate, lower, upper, valid, defined of any statistic when whole groups are drawn.

    One draw serves every statistic: it meets the groups' states, and the statistic
    reads the sums of a replicate. Replicates where it is null are not valid; with
    fewer valid ones than max(100, replicates / 2) the numbers are null.
    """
    sums = resampled(rows, group, states, *levels, by=by, replicates=replicates, seed=seed)
    values = statistic(sums, (*by, "replicate"))
    drawn, low = F.when(F.col("replicate") >= 0, F.col("value")), (1 - confidence) / 2
    ends = F.percentile(drawn, F.array(F.lit(low), F.lit(1 - low)))  # of replicates, whatever the rows
    found = values.groupBy(*by).agg(F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("e"), ends.alias("q"), F.count(drawn).alias("valid"))
    enough = F.col("valid") >= max(100, replicates // 2)
    told = [F.when(enough, c).alias(k) for k, c in (("estimate", F.col("e")), ("lower", F.col("q")[0]), ("upper", F.col("q")[1]))]
    return found.select(*by, *told, "valid", enough.alias("defined"))


def cluster_bootstrap(rows: DataFrame, group: str, value: str, *by: str, replicates: int = 2000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """by, estimate, lower, upper, groups of the mean of value when whole groups are drawn, the same draws for every cell of by.

    A replicate's mean is a ratio of weighted sums over groups, so replicates meet
    one row for each group and cell and never the rows.
    """
    sums = materialize(rows.groupBy(*by, F.col(group).alias("_group")).agg(F.sum(value).alias("s"), F.count(value).alias("n")), "sums")
    names = sums.select("_group").distinct()
    ordered = sums.join(numbered(names, "_group"), "_group").drop("_group")
    mean = lambda w: F.try_divide(F.sum(w * F.col("s")), F.sum(w * F.col("n")))
    means = drawn_states(ordered, draws(names, replicates, seed), "number").groupBy(*by, "replicate").agg(mean(F.col("weight")).alias("m"))
    low = (1 - confidence) / 2
    ends = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(low), F.lit(1 - low))).alias("q"))
    whole = sums.groupBy(*by).agg(mean(F.lit(1)).alias("estimate"), F.count("*").alias("groups"))
    met = whole.join(ends, list(by)) if by else whole.join(F.broadcast(ends))
    return met.select(*by, "estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "groups")


def paired_bootstrap(left: DataFrame, right: DataFrame, key: str, group: str, value: str, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """estimate, lower, upper, groups of the mean of right's value less left's over the same keys, drawn by whole groups.

    Both tables need the same keys, each once, with the same groups: else reading is an error.
    """
    one = left.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(group).alias("_g"), F.any_value(value).alias("a"))
    two = right.groupBy(key).agg(F.count("*").alias("_m"), F.any_value(group).alias("_h"), F.any_value(value).alias("b"))
    met = one.join(two, key, "full")
    sound = F.coalesce((F.col("_n") == 1) & (F.col("_m") == 1) & F.col("_g").eqNullSafe(F.col("_h")), F.lit(False))
    difference = F.when(sound, F.col("b") - F.col("a")).otherwise(F.raise_error(F.concat(F.lit("unpaired key "), F.col(key).cast("string"))).cast("double"))
    return cluster_bootstrap(met.select(F.col("_g").alias("g"), difference.alias("d")), "g", "d", replicates=replicates, seed=seed)


def clustered_ap(rows: DataFrame, group: str, target: str, score: str, replicates: int = 2000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """estimate, lower, upper, replicates, defined of the average precision when whole groups are drawn.

    Replicates of a single class are undefined and left out (replicates counts the
    rest); with fewer than max(100, half of them) left the numbers are null. They
    meet one row for each group and score, never the rows.
    """
    levels = rows.groupBy(F.col(group).alias("_group"), F.col(score).alias("s")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count("*").alias("cnt"))
    groups = materialize(numbered(levels.select("_group").distinct(), "_group"), "groups")
    weights = draws(groups, replicates, seed).unionByName(groups.select(F.lit(-1).alias("replicate"), "number", F.lit(1).cast("long").alias("weight")))
    each = drawn_states(levels.join(groups, "_group").drop("_group"), weights, "number").groupBy("replicate", "s").agg(F.sum(F.col("weight") * F.col("pos")).alias("pos"), F.sum(F.col("weight") * F.col("cnt")).alias("cnt"))
    running = Window.partitionBy("replicate").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = each.select("replicate", "pos", "cnt", F.sum("pos").over(running).alias("tp"), F.sum("cnt").over(running).alias("k"))
    found = cum.groupBy("replicate").agg((F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"), (F.sum("pos") < F.sum("cnt")).alias("both"))
    drawn, low = F.when(F.col("both") & (F.col("replicate") >= 0), F.col("ap")), (1 - confidence) / 2
    ends = F.percentile(drawn, F.array(F.lit(low), F.lit(1 - low)))
    whole = found.agg(F.max(F.when(F.col("both") & (F.col("replicate") < 0), F.col("ap"))).alias("e"), ends.alias("q"), F.count(drawn).alias("replicates"))
    enough = F.col("replicates") >= max(100, replicates // 2)
    return whole.select(F.when(enough, F.col("e")).alias("estimate"), F.when(enough, F.col("q")[0]).alias("lower"), F.when(enough, F.col("q")[1]).alias("upper"), "replicates", enough.alias("defined"))


def two_level_bootstrap(rows: DataFrame, seed_key: str, group: str, value: str, replicates: int = 2000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """estimate, lower, upper of the mean of the seeds' means when seeds, then whole groups of a drawn seed, are drawn.

    Seeds are few; groups may be many and never meet in one task.
    """
    sums = rows.groupBy(F.col(seed_key).alias("_seed"), F.col(group).alias("_group")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    placed = materialize(numbered(sums, "_seed", "_group", out="_at"), "groups")
    seeds = placed.groupBy("_seed").agg(F.count("*").alias("_m"), F.min("_at").alias("_first"), (F.sum("s") / F.sum("n")).alias("_mean"))
    seeds = materialize(seeds.withColumn("_pick", F.row_number().over(Window.orderBy("_seed")).cast("long") - 1), "seeds")
    count, most = seeds.agg(F.count("*"), F.max("_m")).first()
    cells = rows.sparkSession.range(replicates * count).select(F.expr(f"id DIV {max(count, 1)}").alias("replicate"), (F.col("id") % max(count, 1)).alias("slot"))
    cells = cells.withColumn("_pick", ids.choice(ids.digest(str(seed), "seed", F.col("replicate"), F.col("slot")), max(count, 1)))
    prefix = F.concat_ws("\0", F.lit(str(seed)), "replicate", "slot", F.lit(""))
    lots = cells.join(F.broadcast(seeds), "_pick").select("replicate", "slot", "_first", prefix.alias("_prefix"), F.col("_m").alias("_n"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(replicates * count, replicates * count * (most or 0) >> 20))
    weights = drawn(lots.repartition(tasks), "replicate", "slot", "_first", most=most or 0)
    weights = weights.select("replicate", "slot", (F.col("_first") + F.col("number")).alias("_at"), F.col("weight").alias("w"))
    means = drawn_states(placed.select("_at", "s", "n"), weights, "_at").groupBy("replicate", "slot").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    low = (1 - confidence) / 2
    ends = means.groupBy("replicate").agg(F.avg("m").alias("m")).agg(F.percentile("m", F.array(F.lit(low), F.lit(1 - low))).alias("q"))
    return seeds.agg(F.avg("_mean").alias("estimate")).join(F.broadcast(ends)).select("estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def holm(rows: DataFrame, p: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """rows with holm_p and holm_rejected; null p-values pass through and do not count."""
    return _corrected(rows, p, by, "holm", alpha)


def benjamini_hochberg(rows: DataFrame, p: str, *by: str, q: float = 0.05) -> DataFrame:
    """rows with bh_p and bh_rejected; null p-values pass through and do not count."""
    return _corrected(rows, p, by, "bh", q)


def _corrected(rows: DataFrame, p: str, by: tuple[str, ...], name: str, level: float) -> DataFrame:
    """Counted by p-value, so equal ones get one answer: under Holm the first of them has the most tests left, under BH the last the highest rank."""
    rows = materialize(rows, "tests")  # read twice, and joined by equal p-values
    each = counts(rows, p, *by)
    tests = each.groupBy(*by).agg(F.sum("n").alias("_m"))
    met = each.alias("e").join(tests.alias("t"), same("e", "t", by)).select("e.*", "t._m")
    if name == "holm":
        own = (F.col("_m") - F.col("n_before")) * F.col(p)
        met = before(met, F.max, own, F.col(p), out="_other", by=by)
        value = F.greatest(own, F.col("_other"))
    else:
        own = F.col(p) * F.col("_m") / (F.col("n_before") + F.col("n"))
        met = before(met, F.min, own, F.desc(p), out="_other", by=by)
        value = F.least(own, F.col("_other"))
    told = met.select(*by, p, F.least(value, F.lit(1.0)).alias(f"{name}_p"))
    same_p = same("l", "r", by) & (F.col(f"l.`{p}`") == F.col(f"r.`{p}`"))
    done = rows.alias("l").join(told.alias("r"), same_p, "left").select("l.*", f"r.{name}_p")
    return done.withColumn(f"{name}_rejected", F.col(f"{name}_p") <= level)


EXACT = 50  # differences up to which the distribution of the rank sum is counted out


def rank_sum_tail(n: int, statistic: float) -> float:
    """Two-sided p-value of a signed rank sum of n different absolute differences, by counting all signs."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k] if k < len(ways) else ways[k:]
    return min(1.0, 2 * float(ways[: int(statistic) + 1].sum()) / 2.0**n)


@F.pandas_udf(DoubleType())
def _p_value(n: pd.Series, statistic: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    """Exact for few differences without ties, else the normal tail; a row for each group, so nothing of size goes through Python."""
    exact = lambda k, t: k <= EXACT and t == 0
    found = [rank_sum_tail(int(k), w) if exact(k, t) else None if pd.isna(x) else math.erfc(x / math.sqrt(2)) for k, w, t, x in zip(n, statistic, ties, z)]
    return pd.Series(found, dtype="float64")


def wilcoxon(rows: DataFrame, difference: str, *by: str) -> DataFrame:
    """n (without zeros), statistic, rank_biserial, z, p_value by group; no row without a nonzero difference.

    p_value is two-sided: exact for up to EXACT differences without ties, else normal with a correction for ties.
    """
    moved = rows.where(F.col(difference) != 0).withColumn("_abs", F.abs(difference))
    ranked = midranks(moved, "_abs", "_rank", *by)
    side = lambda test: F.coalesce(F.sum(F.when(test, F.col("_rank"))), F.lit(0.0))
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), side(F.col(difference) > 0).alias("up"), side(F.col(difference) < 0).alias("down"))
    ties = ranked.groupBy(*by, "_abs").count().groupBy(*by).agg(F.sum(F.col("count") * F.col("count") * F.col("count") - F.col("count")).alias("ties"))
    met = sums.join(ties, list(by)) if by else sums.join(F.broadcast(ties))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    z = F.when(spread > 0, F.abs(F.col("up") - n * (n + 1) / 4.0) / spread)
    return met.select(*by, "n", F.least("up", "down").alias("statistic"), ((F.col("up") - F.col("down")) / (n * (n + 1) / 2.0)).alias("rank_biserial"), z.alias("z"), "ties").withColumn("p_value", _p_value("n", "statistic", "ties", "z")).drop("ties")
