"""Detectors, contrasts and contracts on small hand-made tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import texts
from lodestone.operators import contracts, detectors, grouping, inference, metrics, pairs, reports, selections, tables


def test_rank_sum_tail_counts_all_signs():
    for n in range(1, 9):
        sums = [sum(k for k, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert inference.rank_sum_tail(n, w) == pytest.approx(min(1.0, 2 * sum(x <= w for x in sums) / 2**n))


def test_wilcoxon_is_exact_for_few_and_normal_for_ties(spark):
    rows = spark.createDataFrame([("few", float(x)) for x in (3, -1, 2, 5, 4, -6, 7)] + [("ties", x) for x in (1.0, 1.0, -1.0, 2.0, 0.0)], "g string, d double")
    got = {r.g: r for r in inference.wilcoxon(rows, "d", "g").collect()}
    assert got["few"].p_value == pytest.approx(inference.rank_sum_tail(7, got["few"].statistic))
    assert got["ties"].n == 4 and got["ties"].p_value != pytest.approx(inference.rank_sum_tail(4, got["ties"].statistic))


def test_fitted_detector_is_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [2, 5] + [1, -3]
    y = rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))
    rows = spark.createDataFrame([(float(a), float(b), bool(t)) for (a, b), t in zip(x, y)], "a double, b double, y boolean")
    model = detectors.fit_logistic(rows, "y", ["a", "b"])
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.array(model["weights"]), model["intercept"]
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(z.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6  # the gradient vanishes
    assert [r.s for r in rows.select(detectors.score(model, ["a", "b"]).alias("s")).collect()] == pytest.approx(p.tolist())
    assert detectors.fit_logistic(rows.where("y"), "y", ["a"]) == {"reason": "one class only"}
    assert "fewer" in detectors.fit_logistic(rows, "y", ["a"], least=10_000)["reason"]


def test_areas_against_brute_force(spark):
    rows = [(int(t), float(s)) for t, s in zip([1, 0, 1, 1, 0, 0, 1, 0], [3, 3, 2, 5, 1, 2, 2, 0])]
    levels = spark.createDataFrame(rows, "y int, s double").groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("cnt"))
    got = detectors.ranked_areas(levels).first()
    pairs_of = [(a, b) for t, a in rows if t for u, b in rows if not u]
    assert got.auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs_of]))
    ap, last = 0.0, 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        above = [t for t, x in rows if x >= s]
        recall = sum(above) / 4
        ap, last = ap + (recall - last) * sum(above) / len(above), recall
    assert got.ap == pytest.approx(ap)


def test_delta_is_undefined_with_few_valid_draws(spark):
    rows = spark.createDataFrame([("g", 1, 0.1, 0.2), ("g", 1, 0.3, 0.1)], "g string, y int, a double, b double")
    got = detectors.clustered_delta(rows, "g", "y", "a", "b", replicates=200).first()
    assert not got.defined and got.estimate is None and got.valid == 0


def test_population_refuses_repeated_keys(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", None)], "k string, ok boolean")
    yes, no = F.lit(True), F.lit(False)
    assert [r.k for r in detectors.population(rows.where("k = 'b'").withColumn("ok", yes), "k", yes, F.col("ok"), yes, no).collect()] == ["b"]
    assert detectors.population(rows.where("k = 'b'"), "k", yes, F.col("ok"), yes, no).count() == 0
    with pytest.raises(Exception, match="repeated key a"):
        detectors.population(rows, "k", yes, F.col("ok"), yes, no).collect()


def test_paired_bootstrap_needs_equal_keys_and_groups(spark):
    left = spark.createDataFrame([(1, "g", 1.0), (2, "h", 2.0)], "k int, g string, v double")
    right = spark.createDataFrame([(1, "g", 3.0), (2, "h", 5.0)], "k int, g string, v double")
    got = inference.paired_bootstrap(left, right, "k", "g", "v", replicates=400).first()
    assert (got.estimate, got.lower, got.upper, got.groups) == (2.5, 2.0, 3.0, 2)
    for bad in (right.where("k = 1"), right.withColumn("g", F.lit("x")), right.unionByName(right)):
        with pytest.raises(Exception, match="unpaired key"):
            inference.paired_bootstrap(left, bad, "k", "g", "v", replicates=10).collect()


def test_mismatches(spark):
    one = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 5.0)], "k int, s string, x double")
    two = spark.createDataFrame([(1, "a", 1.0 + 1e-9), (2, "B", None), (4, "c", 5.0)], "k int, s string, x double")
    got = {(r.k, r.field) for r in contracts.mismatches(one, two, ["k"], ["s", "x"]).collect()}
    assert got == {(1, "x"), (2, "s"), (3, "row"), (4, "row")}
    assert contracts.mismatches(one, one, ["k"], ["s", "x"]).count() == 0
    numbers = contracts.mismatches(one.select("k", "x"), two.select("k", "x"), ["k"], ["x"], 1e-7)
    assert {(r.k, r.field) for r in numbers.collect()} == {(3, "row"), (4, "row")}


def test_contracts_of_logs_and_people(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, True), ("b", 1, None)], "s string, n int, why boolean")
    assert [tuple(r)[:2] for r in contracts.unexplained_access(log, "s", ["n"], F.col("why")).collect()] == [("a", 2)]
    people = spark.createDataFrame([(1, "Ada", "Bo", "Cy"), (2, "Ada", " ada", "Cy"), (3, "Ada", "", "Cy"), (4, "Ada", None, "Cy")], "k int, a string, b string, c string")
    assert {r.k for r in contracts.same_person(people, "k", ["a", "b", "c"]).collect()} == {2, 3, 4}
    steps = spark.createDataFrame([("r", 1), ("r", 2), ("r", 2), ("r", 4), ("q", 9)], "run string, step int")
    assert {(r.run, r.step, r.problem) for r in contracts.gaps(steps, "run", "step").collect()} == {("r", 2, "repeated"), ("r", 4, "gap")}


def test_texts(spark):
    paths = ["a/b.json", "/a", "../a", "a/..", "a/../b", "C:/x", "\\x", "", "a..b/c"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in rows.where(texts.safe_relative(F.col("p"))).collect()] == ["a/b.json", "a..b/c"]
    name = spark.createDataFrame([("vit-seed-seed17",), ("plain",)], "n string").select(texts.run_parts(F.col("n")).alias("r"))
    assert [tuple(x.r) for x in name.collect()] == [("vit-seed", "17"), ("plain", None)]


def test_gaps_in_ids_lose_no_row(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in (0, 1, 5, 9)], "vec_id long, e array<double>")
    assert {(r.vec_id, r.d[0]) for r in pairs.neighbours(rows).collect()} == {(0, 1.0), (1, 5.0), (5, 9.0), (9, 0.0)}


def test_split_keeps_rows_without_group_or_label(spark):
    rows = spark.createDataFrame([(1, "g", "a"), (2, None, "b"), (3, "h", None), (4, "g", "b")], "k int, g string, c string")
    got = grouping.grouped_split(rows, "g", "c", {"x": 0.5, "y": 0.5}).collect()
    assert sorted(r.k for r in got) == [1, 2, 3, 4] and len({r.role for r in got if r.g == "g"}) == 1


def test_ecdf_keeps_rows_without_value_or_mark(spark):
    rows = spark.createDataFrame([(1, 1.0, True), (2, 2.0, False), (3, None, False), (4, 0.5, None)], "k int, v double, c boolean")
    assert {(r.k, r.percentile) for r in metrics.control_ecdf(rows, "v", "c").collect()} == {(2, 1.0), (3, None), (4, 0.0)}


def test_errors_in_place_of_lost_rows(spark):
    answers = lambda rows: spark.createDataFrame(rows, "k int, a boolean")
    one, two = answers([(1, True), (2, True)]), answers([(1, True), (2, False)])
    assert {(r.k, r.decision) for r in reports.reconcile(one, two, answers([(2, False)]), "k", "a").collect()} == {(1, True), (2, False)}
    for second, third in ((two.where("k = 1"), answers([(2, False)])), (two, answers([(1, False)]))):
        with pytest.raises(Exception, match="no decision for 2"):
            reports.reconcile(one, second, third, "k", "a").collect()
    epochs = lambda rows, c: spark.createDataFrame(rows, f"e int, {c} double")
    with pytest.raises(Exception, match="no training rows for 3"):
        reports.learning_curve(epochs([(1, 0.5)], "loss"), epochs([(1, 0.9), (3, 0.8)], "score"), ["e"], "loss", "score").collect()


def test_tables(spark):
    rows = spark.createDataFrame([("a", 1, 10, 2.0), ("a", 2, 10, 4.0), ("b", 1, 10, None), ("b", 2, 10, 1.0)], "m string, s int, i int, t double")
    got = {r.m: r for r in tables.throughput(rows, "m", "s", "i", "t", 2).collect()}
    assert (got["a"].rate, got["a"].defined) == (3.75, True) and (got["b"].rate, got["b"].defined) == (None, False)
    some = spark.createDataFrame([("x", 1)], "f string, n int")
    assert [tuple(r) for r in tables.with_sentinel(some, f="none", n=0).collect()] == [("x", 1)]
    assert [tuple(r) for r in tables.with_sentinel(some.where("n > 1"), f="none", n=0).collect()] == [("none", 0)]
    effects = spark.createDataFrame([("F", 1, 1.0), ("O", 1, 3.0), ("F", 2, 1.0)], "m string, k int, effect double")
    with pytest.raises(Exception, match="no partner for 2"):
        tables.model_differences(effects, "m", "F", "O", ["k"]).collect()


def test_partners_are_eligible(spark):
    rows = spark.createDataFrame([(1, "g", "x", 0, "c"), (2, "g", "y", 7, "c"), (3, "h", "x", 7, "c"), (4, "h", "z", 7, "c"), (5, "k", "w", 1, "c")], "id int, g string, h string, bits long, label string")
    got = {(r.id, r.partner) for r in selections.eligible_partners(rows, "id", "g", "h", "bits", "label", 1).collect()}
    assert got == {(1, 4), (4, 1), (3, 5), (5, 3), (4, 5), (5, 4), (2, 5), (5, 2)}
