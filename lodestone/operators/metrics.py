"""Grouped classification, calibration, ranking and agreement measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import merging
from lodestone.operators.ordering import counts, quantiles, same
from lodestone.storage import materialize


def classification(rows: DataFrame, classes: int, target: str = "label", predicted: str = "predicted") -> DataFrame:
    """class, support, precision, recall, f1; a ratio without cases is 0 and absent classes are listed."""
    grid = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    cells = rows.groupBy(F.col(target).alias("t"), F.col(predicted).alias("p")).count()
    sums = cells.select(F.inline(F.array(F.struct(F.col("t").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("said"), F.lit(0).cast("long").alias("hit")))))
    each = grid.join(sums.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")), "class", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    each = each.select("class", "support", ratio("hit", "said").alias("precision"), ratio("hit", "support").alias("recall"))
    return each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(rows: DataFrame, classes: int, target: str = "label", predicted: str = "predicted") -> DataFrame:
    """target, predicted, n for every cell of the class grid."""
    one = rows.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("target"), (F.col("id") % classes).cast("int").alias("predicted"))
    cells = rows.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return one.join(cells, ["target", "predicted"], "left").na.fill(0, ["n"])


def reliability(rows: DataFrame, bins: int = 15, p: str = "p", target: str = "label") -> DataFrame:
    """bin, n, confidence, accuracy for every bin of confidence; means are null in an empty bin."""
    each = rows.select(F.array_max(p).alias("c"), (S.argmax(F.col(p)) == F.col(target)).cast("double").alias("hit"))
    binned = each.withColumn("bin", (F.least(F.width_bucket("c", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)) - 1).cast("int"))
    sums = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("hit").alias("accuracy"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").na.fill(0, ["n"])


def calibration_error(rows: DataFrame, bins: int = 15, p: str = "p", target: str = "label") -> DataFrame:
    r = reliability(rows, bins, p, target)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """The measures of each pair, before (p, e) against after (q, t)."""
    c, d = F.array_max("p"), F.array_max("q")
    clean, kept = S.argmax(F.col("p")) == F.col("label"), S.argmax(F.col("q")) == F.col("label")
    similarity = S.cosine(F.col("e"), F.col("t"))
    return pairs.select(
        "vec_id", "label", "family", "severity", "ordinal",
        S.js_divergence(F.col("p"), F.col("q")).alias("js"), S.entropy(F.col("p")).alias("entropy"), S.entropy(F.col("q")).alias("changed_entropy"),
        c.alias("confidence"), d.alias("changed_confidence"), (d - c).alias("confidence_change"), (1 - d).alias("uncertainty"),
        similarity.alias("cosine"), (1 - similarity).alias("instability"),
        (S.argmax(F.col("p")) == S.argmax(F.col("q"))).alias("consistent"), clean.alias("clean_correct"), kept.alias("changed_correct"), (clean & ~kept).alias("failure"),
    )


def condition_summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Means, failures, prevalence and quartiles by condition; prevalence is null without correct clean cases.

    The measures are written once, as quartiles go over them a second time.
    """
    metrics = materialize(metrics, "measures")
    whole = metrics.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("vec_id").alias("sources"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("js", "entropy", "changed_entropy", "confidence_change", "instability")],
        F.avg(F.col("consistent").cast("double")).alias("consistency"), F.sum(F.col("failure").cast("long")).alias("failures"), F.sum(F.col("clean_correct").cast("long")).alias("clean_correct"),
        F.try_divide(F.sum(F.col("failure").cast("double")), F.sum(F.col("clean_correct").cast("long"))).alias("prevalence"),
        F.avg(F.when(F.col("failure"), (F.col("confidence_change") > 0).cast("double"))).alias("failures_more_confident"),
    )
    quartiles = quantiles(metrics, "confidence_change", {"change_q25": 0.25, "change_median": 0.5, "change_q75": 0.75}, *by)
    return whole.alias("w").join(quartiles.alias("q"), same("w", "q", by), "left").select("w.*", "q.change_q25", "q.change_median", "q.change_q75")


def ranking(rows: DataFrame, target: str, score: str, *by: str, min_positives: int = 20) -> DataFrame:
    """n, positives, defined, underpowered, average_precision, auroc by group.

    Equal scores are one threshold: counts are summed for each score first, and
    run on from score to score over ranges, so no task holds a group's scores. Undefined for a single class.
    """
    hit = F.col(target).cast("long")
    cum = counts(rows, score, *by, order=F.desc(score), pos=hit).withColumns({"tp": F.col("pos_before") + F.col("pos"), "k": F.col("n_before") + F.col("n")})
    whole = cum.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * F.col("tp") / F.col("k")).alias("a"),
        F.sum(F.col("pos") * (F.col("k") - F.col("tp") - (F.col("n") - F.col("pos")) / 2)).alias("b"),
    )
    defined = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    negatives = F.col("n") - F.col("positives")
    return whole.select(
        *by, "n", "positives", defined.alias("defined"), (F.col("positives") < min_positives).alias("underpowered"),
        F.when(defined, F.col("a") / F.col("positives")).alias("average_precision"), F.when(defined, 1 - F.col("b") / (F.col("positives") * negatives)).alias("auroc"),
    )


def control_ecdf(rows: DataFrame, value: str, is_control: str) -> DataFrame:
    """Rows that are no controls, with percentile: the share of controls at or below their value (null for a null value).

    Counts are summed for each value first and the running sum is taken within
    ranges of values, with the ranges' totals added: no single task sorts all rows.
    """
    levels = rows.groupBy(F.col(value).alias("v")).agg(F.sum(F.col(is_control).cast("long")).alias("controls"))
    cuts = [x for x in (levels.agg(F.percentile_approx("v", F.lit([i / 64 for i in range(1, 64)]), F.lit(10_000))).first()[0] or [])]
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = levels.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("v"))))
    totals = ranged.groupBy("range").agg(F.sum("controls").alias("c"))
    before = totals.select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("all"))
    inside = F.sum("controls").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = ranged.withColumn("at", inside).join(F.broadcast(before), "range").select(F.col("v").alias(value), F.try_divide((F.col("at") + F.col("before")).cast("double"), F.col("all")).alias("percentile"))
    return rows.where(~F.coalesce(F.col(is_control), F.lit(False))).join(table, value, "left")


def linear_cka(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n and linear CKA of two representations from centred products; null if one is constant.

    Partitions sum the products of blocks of rows as matrices, and the matrices are
    merged as a tree with a correction for their means: the shuffle carries one matrix a
    partition and no row for each pair of elements.
    """
    found = merging.gram(rows.select(F.concat(x, y).alias("z"), F.size(x).alias("dx")))
    n, cka = 0, None
    if found is not None:
        n, d, product = found
        c = product / n
        xy, xx, yy = (float((c[a] ** 2).sum()) for a in (np.s_[:d, d:], np.s_[:d, :d], np.s_[d:, d:]))
        cka = xy / (xx**0.5 * yy**0.5) if xx > 0 and yy > 0 else None
    return rows.sparkSession.createDataFrame([(n, cka)], "n long, cka double")


def midranks(rows: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """Rank among the rows of a group, the mean rank for equal values; from counts of each value, range by range.

    Rows are written first: they are read twice and meet by equal values, and a mean
    that is computed again in another order can differ in its last bit.
    """
    rows = materialize(rows, "ranked")
    ranks = counts(rows, value, *by).select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))
    return rows.alias("l").join(ranks.alias("r"), same("l", "r", by) & (F.col(f"l.`{value}`") == F.col(f"r.`{value}`"))).select("l.*", f"r.`{out}`")


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two raters with answers true or false; kappa is null where chance agreement is whole."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = rows.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    chance = F.col("x") * F.col("y") + (1 - F.col("x")) * (1 - F.col("y"))
    return sums.select("n", "agreement", F.try_divide(F.col("agreement") - chance, 1 - chance).alias("kappa"))
