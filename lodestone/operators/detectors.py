"""Failure detectors: who is scored, nested logistic models, scores and their comparison over drawn groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.inference import drawn_states, draws
from lodestone.operators.ordering import before, numbered
from lodestone.storage import materialize


def population(rows: DataFrame, key: str, role: Column, qualified: Column, correct: Column, sham: Column) -> DataFrame:
    """Rows of the role that are qualified and correct before the change and no sham; a repeated key is an error when read."""
    kept = rows.where(role & F.coalesce(qualified, F.lit(False)) & F.coalesce(correct, F.lit(False)) & ~F.coalesce(sham, F.lit(False)))
    n = F.count("*").over(Window.partitionBy(key))
    return kept.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key])).otherwise(F.col(key))).drop("_n")


def fit_logistic(rows: DataFrame, target: str, features: list[str], c: float = 1.0, least: int = 10, rounds: int = 50, tolerance: float = 1e-9) -> dict:
    """Centre, scale (population), weights and intercept of an L2-regularised logistic model, or the reason why there is none.

    Newton steps: each is one aggregate of the gradient and the curvature, a row of
    (features + 1) squared numbers, so the rows stay where they are.
    """
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("pos"), *[f(x) for x in features for f in (F.avg, F.stddev_pop)]).first()
    n, pos = stats["n"], stats["pos"] or 0
    if pos == 0 or pos == n:
        return {"reason": "one class only"}
    if pos < least:
        return {"reason": f"fewer than {least} positives"}
    centre, scale = list(stats[2::2]), [s or 1.0 for s in stats[3::2]]
    x = [*[(F.col(f) - m) / s for f, m, s in zip(features, centre, scale)], F.lit(1.0)]
    k = len(x)
    w = np.zeros(k)
    ridge = np.diag([1.0] * (k - 1) + [0.0])
    for _ in range(rounds):
        z = sum(float(a) * b for a, b in zip(w, x))
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum((p - F.col(target).cast("double")) * x[i]) for i in range(k)] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i + 1)]
        found = rows.agg(*sums).first()
        gradient = c * np.array(found[:k]) + ridge @ w
        curve = np.zeros((k, k))
        curve[np.tril_indices(k)] = found[k:]
        step = np.linalg.solve(c * (curve + np.tril(curve, -1).T) + ridge, gradient)
        w = w - step
        if np.abs(step).max() < tolerance:
            return {"centre": centre, "scale": scale, "weights": w[:-1].tolist(), "intercept": float(w[-1]), "rounds": _ + 1}
    return {"reason": "no convergence"}


def score(model: dict, features: list[str], clip: float = 40.0) -> Column:
    """Probability of a fitted model; null if there is none."""
    if "reason" in model:
        return F.lit(None).cast("double")
    z = F.lit(float(model["intercept"]))
    for f, m, s, w in zip(features, model["centre"], model["scale"], model["weights"]):
        z = z + (F.col(f) - float(m)) / float(s) * float(w)
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))))


def prevalence(rows: DataFrame, target: str, *by: str) -> DataFrame:
    """by, n, positives, prevalence of every condition."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("positives"), F.avg(F.col(target).cast("double")).alias("prevalence"))


def ranked_areas(levels: DataFrame, *by: str) -> DataFrame:
    """by, ap, auroc, pos, n of levels (by, s, pos, cnt): one row for each different score, so ties are one level.

    Both are null where there is one class only.
    """
    placed = before(levels, F.sum, {"_tp": F.col("pos"), "_k": F.col("cnt")}, F.desc("s"), by=by)
    cum = placed.select(*by, "pos", "cnt", (F.coalesce("_tp", F.lit(0)) + F.col("pos")).alias("tp"), (F.coalesce("_k", F.lit(0)) + F.col("cnt")).alias("k"))
    above = F.col("k") - F.col("tp") - (F.col("cnt") - F.col("pos"))  # negatives of better score
    sums = cum.groupBy(*by).agg(
        F.sum("pos").alias("pos"), F.sum("cnt").alias("n"), F.sum(F.col("pos") * F.col("tp") / F.col("k")).alias("a"),
        F.sum(F.col("pos") * (above + (F.col("cnt") - F.col("pos")) / 2.0)).alias("lost"),
    )
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return sums.select(*by, F.when(both, F.col("a") / F.col("pos")).alias("ap"), F.when(both, 1 - F.col("lost") / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auroc"), "pos", "n")


def clustered_delta(rows: DataFrame, group: str, target: str, first: str, second: str, metric: str = "ap", replicates: int = 2000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """estimate, lower, upper, valid, defined of metric(second) - metric(first), both over the same drawn groups.

    Replicates of one class are not valid; with fewer valid ones than max(100,
    replicates / 2) the interval is undefined and the numbers are null.
    """
    levels = None
    for which, s in enumerate((first, second)):
        each = rows.groupBy(F.lit(which).alias("which"), F.col(group).alias("_group"), F.col(s).alias("s")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count("*").alias("cnt"))
        levels = each if levels is None else levels.unionByName(each)
    groups = materialize(numbered(rows.select(F.col(group).alias("_group")).distinct(), "_group"), "groups")
    weights = draws(groups, replicates, seed).unionByName(groups.select(F.lit(-1).alias("replicate"), "number", F.lit(1).cast("long").alias("weight")))
    met = drawn_states(levels.join(groups, "_group").drop("_group"), weights, "number").groupBy("replicate", "which", "s").agg(F.sum(F.col("weight") * F.col("pos")).alias("pos"), F.sum(F.col("weight") * F.col("cnt")).alias("cnt"))
    areas = ranked_areas(met, "replicate", "which")
    value = lambda k: F.max(F.when(F.col("which") == k, F.col(metric)))
    delta = areas.groupBy("replicate").agg((value(1) - value(0)).alias("d"))
    drawn = F.when(F.col("replicate") >= 0, F.col("d"))
    low = (1 - confidence) / 2
    q = F.percentile(drawn, F.array(F.lit(low), F.lit(1 - low)))
    found = delta.agg(F.max(F.when(F.col("replicate") < 0, F.col("d"))).alias("e"), q.alias("q"), F.count(drawn).alias("valid"))
    enough = F.col("valid") >= max(100, replicates // 2)
    return found.select(F.when(enough, F.col("e")).alias("estimate"), F.when(enough, F.col("q")[0]).alias("lower"), F.when(enough, F.col("q")[1]).alias("upper"), "valid", enough.alias("defined"))
