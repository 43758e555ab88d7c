import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import contracts, grouping, inference, metrics, ordering, reports
from lodestone.operators.components import connected_components


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("x")).first()[0]


def test_divergence(spark):
    assert one(spark, S.js_divergence(F.col("p"), F.col("q")), p=[1, 0], q=[1, 0]) == 0
    assert 0 < one(spark, S.js_divergence(F.col("p"), F.col("q")), p=[0.5, 0.5], q=[0, 1]) <= math.log(2)
    assert one(spark, S.entropy(F.col("p")), p=[1, 0]) == 0
    for p, q in (([0, 0], [1, 0]), ([1, 0], [1, 0, 0])):  # undefined, so refused
        with pytest.raises(Exception, match="zero vector"):
            one(spark, S.cosine(F.col("p"), F.col("q")), p=p, q=q)
    with pytest.raises(Exception, match="outside its bounds"):
        one(spark, S.js_divergence(F.col("p"), F.col("q")), p=[2, 0], q=[0, 2])
    assert one(spark, S.argmax(F.col("p")), p=[0.4, 0.4, 0.2]) == 0
    assert one(spark, S.valid_probabilities(F.col("p")), p=[0.5, 0.6]) is False


def test_holm_and_bh(spark):
    rows = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.20])), "i int, p double")
    got = {r.i: (round(r.holm_p, 10), r.holm_rejected) for r in inference.holm(rows, "p").collect()}
    assert got == {0: (0.04, True), 1: (0.09, False), 2: (0.09, False), 3: (0.20, False)}
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.2), (3, None)], "i int, p double")
    assert [r.i for r in inference.benjamini_hochberg(rows, "p").collect() if r.bh_rejected] == [0]


def test_ranking_undefined_and_tied(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("a", 0, 0.2), ("b", 0, 0.5), ("b", 0, 0.6), ("c", 1, 0.5), ("c", 0, 0.5)], "g string, y int, s double")
    got = {r.g: r for r in metrics.ranking(rows, "y", "s", "g", min_positives=2).collect()}
    assert got["a"].average_precision == 1.0 and got["a"].auroc == 1.0 and got["a"].underpowered
    assert not got["b"].defined and got["b"].auroc is None
    assert got["c"].average_precision == 0.5 and got["c"].auroc == 0.5


def test_ecdf_is_scale_free(spark):
    for k in (1.0, 10.0):
        rows = spark.createDataFrame([(v * k, True) for v in (1.0, 2.0, 3.0, 4.0)] + [(1.5 * k, False), (3.5 * k, False)], "v double, c boolean")
        assert sorted(r.percentile for r in metrics.control_ecdf(rows, "v", "c").collect()) == [0.25, 0.75]


def test_cka(spark):
    rows = spark.createDataFrame([([float(4 * i + j) for j in range(4)], [10.0 * (4 * i + j) + 3 for j in range(4)]) for i in range(6)], "x array<double>, y array<double>")
    assert metrics.linear_cka(rows, "x", "y").first().cka == pytest.approx(1.0)
    assert metrics.linear_cka(rows.withColumn("y", F.array(F.lit(1.0))), "x", "y").first().cka is None


def test_wilcoxon(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (0.0,)], "d double")
    got = inference.wilcoxon(rows, "d").first()
    assert (got.n, got.statistic, got.rank_biserial) == (3, 0.0, 1.0)


def test_unpaired_keys_are_an_error(spark):
    left, right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(1, 0.0)], "k int, v double")
    with pytest.raises(Exception, match="unpaired key 2"):
        inference.paired(left, right, "k", "v").collect()


def test_bootstrap_of_a_constant(spark):
    rows = spark.createDataFrame([(i // 2, 1.0) for i in range(8)], "g int, v double")
    got = inference.cluster_bootstrap(rows, "g", "v").first()
    assert (got.estimate, got.lower, got.upper, got.groups) == (1.0, 1.0, 1.0, 4)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1)], "u long, v long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0


def test_hamming_edges(spark):
    rows = spark.createDataFrame([(0, 0), (1, 15), (2, 31), (3, -1)], "id long, h long")
    assert sorted(tuple(r) for r in grouping.hamming_edges(rows, "id", "h").collect()) == [(0, 1, 4), (1, 2, 1)]


def test_hamming_edges_ties_copies_to_one(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = [v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in base for k in (0, 0, 1, 3, 5)]
    rows = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "id long, h long")
    first = {v: i for i, v in reversed(list(enumerate(values)))}
    want = {(first[v], i, 0) for i, v in enumerate(values) if first[v] != i}
    want |= {(min(i, j), max(i, j), (v ^ w).bit_count()) for v, i in first.items() for w, j in first.items() if i < j and (v ^ w).bit_count() <= 4}
    assert sorted(tuple(r) for r in grouping.hamming_edges(rows, "id", "h").collect()) == sorted(want)


def test_simhash_bits(spark):
    rows = spark.createDataFrame([(1, -1), (1, 0), (1, 5), (2, -(1 << 63)), (3, None)], "k int, v long")
    assert {r.k: r.bits for r in grouping.simhash_bits(rows, "v", "k").collect()} == {1: 5, 2: -(1 << 63), 3: 0}


def test_split_keeps_groups_whole(spark):
    rows = spark.createDataFrame([(i, f"g{i // 3}", i % 2) for i in range(300)], "i int, g string, y int")
    out = grouping.grouped_split(rows, "g", "y", {"train": 0.6, "test": 0.4})
    assert out.count() == 300 and grouping.split_violations(out, "g").count() == 0
    assert 150 <= out.where("role = 'train'").count() <= 210


def test_early_stop_needs_more_than_min_delta(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.5, 0.55, 0.59, 0.58, 0.9])], "run string, step long, score double")
    assert tuple(reports.early_stop(rows, "run", "step", "score", 0.1, 3).first()) == ("a", 0.5, 0, 3)


def test_pareto(spark):
    rows = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 2.0), (3, 2.0, 1.0), (4, 1.0, 3.0), (5, 0.5, 2.5)], "i int, x double, y double")
    assert sorted(r.i for r in reports.pareto(rows, "x", "y").collect()) == [1, 2, 4]


@pytest.mark.parametrize("parts", [1, 6])
def test_folds_before_each_row(spark, parts):
    rng = random.Random(parts)
    values = [(i, rng.randrange(50)) for i in range(300)]
    rows = spark.createDataFrame(values, "k int, v long")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        up = {r.k: r.total for r in ordering.before(rows, F.sum, F.col("v"), "k").collect()}
        down = {r.k: r.most for r in ordering.before(rows, F.max, F.col("v"), F.desc("k"), out="most").collect()}
        place = {r.k: r.number for r in ordering.numbered(rows, F.desc("k")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert up == {k: sum(v for _, v in values[:k]) if k else None for k, _ in values}
    assert down == {k: max([v for _, v in values[k + 1 :]], default=None) for k, _ in values}
    assert place == {k: 299 - k for k, _ in values}


def test_wilcoxon_p_value(spark):
    rows = spark.createDataFrame([("a", float(d)) for d in (1, 2, 3, -4, 5, 6, 7, 8, 9, 10)] + [("b", 0.0)], "g string, d double")
    found = inference.wilcoxon(rows, "d", "g").collect()
    assert [(r.g, r.n, r.statistic) for r in found] == [("a", 10, 4.0)]
    assert math.isclose(found[0].p_value, 2 * 7 / 2**10)  # the ranks 1 to 10 have seven subsets of sum 4 or less
    many = spark.createDataFrame([(float(d) if d % 5 else -float(d),) for d in range(1, 61)], "d double")  # too many to count out
    (r,) = inference.wilcoxon(many, "d").collect()
    z = abs(sum(d for d in range(1, 61) if d % 5) - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert math.isclose(r.p_value, math.erfc(z / math.sqrt(2)))


def test_bootstraps_of_one_answer(spark):
    rows = spark.createDataFrame([(s, g, float(y), y) for s in "xy" for g in range(10) for y in (0, 1)], "s string, g int, score double, y int")
    assert tuple(inference.clustered_ap(rows, "g", "y", "score").first()) == (1.0, 1.0, 1.0, 2000, True)
    assert tuple(inference.two_level_bootstrap(rows, "s", "g", "score").first()) == (0.5, 0.5, 0.5)
    assert tuple(inference.clustered_ap(rows.limit(0), "g", "y", "score").first()) == (None, None, None, 0, False)
    assert tuple(inference.two_level_bootstrap(rows.limit(0), "s", "g", "score").first()) == (None, None, None)


def test_matched_tables_drop_nothing(spark):
    frame = lambda rows, c: spark.createDataFrame(rows, f"k int, g string, {c} double")
    good = frame([(1, "x", 1.0), (2, "y", 2.0)], "a")
    assert sorted(map(tuple, contracts.matched(good, frame([(2, "y", 5.0), (1, "x", 4.0)], "b"), "k", same=("g",)).collect())) == [(1, "x", 1.0, 4.0), (2, "y", 2.0, 5.0)]
    for bad in ([(1, "x", 1.0)], [(1, "x", 1.0), (2, "y", 1.0), (3, "z", 1.0)], [(1, "x", 1.0), (2, "z", 1.0)], [(1, "x", 1.0), (2, "y", 1.0), (2, "y", 1.0)]):
        with pytest.raises(Exception, match="unmatched key"):
            contracts.matched(good, frame(bad, "b"), "k", same=("g",)).collect()


def test_effects_need_both_sides(spark):
    frame = lambda rows: spark.createDataFrame(rows, "source int, grp string, severity string, v double")
    whole = [(1, "x", "mild", 1.0), (1, "x", "severe", 4.0), (1, "x", "sham", 9.0), (2, "y", "mild", None), (2, "y", "severe", 1.0)]
    found = lambda rows: contracts.two_sided(frame(rows), "severity", "mild", "severe", "v", "source", same=("grp",)).collect()
    assert sorted(map(tuple, found(whole))) == [(1, "x", 3.0), (2, "y", None)]
    for bad in (whole[1:], [*whole, (2, "y", "mild", 2.0)], [*whole[:1], (1, "z", "severe", 4.0)]):
        with pytest.raises(Exception, match="no pair of mild and severe for"):
            found(bad)


def test_word_bits_are_those_of_single_words(spark):
    texts = [None, "", "  ", "a", "A a b", "Ä ä Z\tq  z z", "x " * 500 + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    words = rows.select("k", F.explode_outer(F.filter(F.split(F.translate("text", "AZ", "az"), " "), lambda w: w != "")).alias("w"))
    want = grouping.simhash_bits(words.select("k", F.conv(F.substring(F.sha2("w", 256), 1, 16), 16, -10).cast("long").alias("v")), "v", "k")
    assert {r.k: r.bits for r in want.collect()} == {k: grouping.word_bits(t) for k, t in enumerate(texts)}


def test_hamming_edges_over_many_partitions(spark, monkeypatch):
    rng = random.Random(9)
    values = [rng.getrandbits(6) << 58 | rng.getrandbits(4) << 20 for _ in range(150)]
    rows = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "id long, h long")
    want = sorted(tuple(r) for r in grouping.hamming_edges(rows, "id", "h").collect())
    monkeypatch.setattr(grouping, "ENTRIES", 100)
    assert sorted(tuple(r) for r in grouping.hamming_edges(rows, "id", "h").collect()) == want
    assert len({(a, b) for a, b, _ in want}) == len(want)
