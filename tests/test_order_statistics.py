"""Running aggregates, ranks, quantiles and corrections of groups, by one window and range by range; matrices merged as a tree; bootstraps of any statistic; the split."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import grouping, inference, merging, metrics, ordering

ROWS = [(random.Random(i).choice(["a", "a", "a", "b", None]), i, random.Random(-i).choice([None, *map(float, range(8))])) for i in range(900)]


@pytest.fixture(params=["window", "ranges"])
def plan(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(ordering, "SMALL", -1)
    return request.param


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, i int, v double").repartition(7)


def groups():
    by = defaultdict(list)
    for g, i, v in ROWS:
        by[g].append((i, v))
    return by


def test_running_aggregates_of_groups(rows, plan):
    found = ordering.before(rows, F.sum, {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, "i", by=("g",))
    got = {r.i: (r.s, r.n) for r in ordering.before(found.drop("s", "n"), F.sum, {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, "i", by=("g",)).collect()}
    top = {r.i: r.total for r in ordering.before(rows, F.max, F.col("v"), F.desc("i"), by=("g",)).collect()}
    for each in groups().values():
        each.sort()
        for k, (i, _) in enumerate(each):
            assert got[i] == ((sum(v or 0 for _, v in each[:k]), k) if k else (None, None))
            assert top[i] == max((v for _, v in each[k + 1 :] if v is not None), default=None)


def test_quantiles_of_groups(rows, plan):
    shares = {"low": 0.25, "mid": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in ordering.quantiles(rows, "v", shares, "g").collect()}
    assert set(got) == set(groups())
    for g, each in groups().items():
        values = [v for _, v in each if v is not None]
        assert all(math.isclose(got[g][k], np.quantile(values, q)) for k, q in shares.items())
    assert ordering.quantiles(rows, "v", {"mid": 0.5}).first().mid == np.quantile([v for *_, v in ROWS if v is not None], 0.5)
    assert ordering.quantiles(rows.where("v IS NULL"), "v", {"mid": 0.5}, "g").collect() == []


def test_midranks_of_groups(rows, plan):
    got = {r.i: r["rank"] for r in metrics.midranks(rows, "v", "rank", "g").collect()}
    for each in groups().values():
        values = [v for _, v in each if v is not None]
        assert all(got[i] == sum(w < v for w in values) + (values.count(v) + 1) / 2 for i, v in each if v is not None)


def test_ranking_of_groups(rows, plan):
    got = {r.g: r for r in metrics.ranking(rows.where("v IS NOT NULL").withColumn("y", F.col("i") % 3 == 0), "y", "v", "g").collect()}
    for g, each in groups().items():
        pairs = [(v, i % 3 == 0) for i, v in each if v is not None]
        pos = sum(y for _, y in pairs)
        tp = k = 0
        ap = 0.0
        for s in sorted({v for v, _ in pairs}, reverse=True):
            here = [y for v, y in pairs if v == s]
            tp, k = tp + sum(here), k + len(here)
            ap += sum(here) * tp / k
        wins = sum((a > b) + (a == b) / 2 for a, x in pairs if x for b, y in pairs if not y)
        assert math.isclose(got[g].average_precision, ap / pos) and math.isclose(got[g].auroc, wins / (pos * (len(pairs) - pos)))


@pytest.mark.parametrize("p, holm, bh", [([0.01, 0.04, 0.03, 0.20], [0.04, 0.09, 0.09, 0.20], None), ([0.01, 0.04, 0.2], None, [0.03, 0.06, 0.2]), ([0.02, 0.02, 0.02, None], [0.06] * 3 + [None], [0.02] * 3 + [None])])
def test_corrections(spark, plan, p, holm, bh):
    tests = spark.createDataFrame([(f, i, v) for f in ("x", "y") for i, v in enumerate(p)], "f string, i int, p double")
    for want, correct, name in ((holm, inference.holm, "holm"), (bh, inference.benjamini_hochberg, "bh")):
        if want:
            for f in ("x", "y"):
                got = [r[f"{name}_p"] for r in correct(tests, "p", "f").where(F.col("f") == f).orderBy("i").collect()]
                assert got == [None if w is None else pytest.approx(w) for w in want]


def test_early_stop_streams_runs(spark):
    from lodestone.operators import reports

    rows = spark.createDataFrame([("r", 1, 0.1), ("r", 2, None), ("r", 3, 0.1), ("r", 4, 0.05), ("s", 1, None), (None, 1, 1.0)], "r string, step int, score double")
    got = {r.r: tuple(r)[1:] for r in reports.early_stop(rows, "r", "step", "score", 0.0, 2).collect()}
    assert got == {"r": (0.1, 1, 4), None: (1.0, 1, None)}


@pytest.mark.parametrize("parts", [1, 9])
def test_cka_of_wide_representations(spark, monkeypatch, parts):
    monkeypatch.setattr(merging, "FAN", 2)
    monkeypatch.setattr(merging, "BLOCK", 600)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 64)) + 1e6, rng.normal(size=(40, 48))
    y[:, :20] += x[:, :20] - 1e6
    table = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(parts)
    got = metrics.linear_cka(table, "x", "y").first()
    xc, yc = x - x.mean(0), y - y.mean(0)
    norm = np.linalg.norm
    assert got.n == 40 and math.isclose(got.cka, norm(xc.T @ yc) ** 2 / (norm(xc.T @ xc) * norm(yc.T @ yc)), rel_tol=1e-9)
    same = table.withColumn("y", F.transform("x", lambda v: 10 * v + 3))
    assert math.isclose(metrics.linear_cka(same, "x", "y").first().cka, 1.0, rel_tol=1e-9)
    constant = table.withColumn("y", F.array(F.lit(1.0)))
    assert metrics.linear_cka(constant, "x", "y").first().cka is None and metrics.linear_cka(table.limit(0), "x", "y").first().n == 0


def test_one_draw_serves_every_statistic(spark):
    """Mean, ratio, average precision and a function of one's own, each against the same draws by hand."""
    data = [(i // 5, float(i % 7), float(i % 4), int(i * i % 5 < 2)) for i in range(200)]
    rows = spark.createDataFrame(data, "g int, v double, s double, y int")
    weights = Counter()
    for r in range(120):
        for slot in range(40):
            weights[r, inference_choice(r, slot, 40)] += 1
    states = {"v": F.sum("v"), "n": F.count("*"), "vv": F.sum(F.col("v") * F.col("v"))}

    def by_hand(f):
        values = []
        for r in range(120):
            drawn = [d for d in data for _ in range(weights[r, d[0]])]
            values.append(f(drawn))
        return f(data), np.quantile(values, 0.025), np.quantile(values, 0.975)

    mean = lambda d: sum(x[1] for x in d) / len(d)
    spread = lambda d: sum(x[1] ** 2 for x in d) / len(d) - mean(d) ** 2
    got = inference.bootstrap(rows, "g", states, inference.of_sums(F.col("v") / F.col("n")), replicates=120).first()
    assert np.allclose(got[:3], by_hand(mean)) and got.valid == 120 and got.defined
    own = inference.of_function(lambda part: float(part["vv"].iloc[0] / part["n"].iloc[0] - (part["v"].iloc[0] / part["n"].iloc[0]) ** 2))
    assert np.allclose(inference.bootstrap(rows, "g", states, own, replicates=120).first()[:3], by_hand(spread))

    def precision(d):
        tp = k = 0
        ap = 0.0
        for s in sorted({x[2] for x in d}, reverse=True):
            here = [x[3] for x in d if x[2] == s]
            tp, k = tp + sum(here), k + len(here)
            ap += sum(here) * tp / k
        return ap / sum(x[3] for x in d)

    levels = inference.bootstrap(rows, "g", {"pos": F.sum("y"), "cnt": F.count("*")}, inference.of_levels("s"), "s", replicates=120).first()
    assert np.allclose(levels[:3], by_hand(precision))
    few = inference.bootstrap(rows, "g", states, inference.of_sums(F.lit(None).cast("double")), replicates=120).first()
    assert (few.estimate, few.valid, few.defined) == (None, 0, False)


def inference_choice(replicate, slot, n):
    import hashlib

    return int(hashlib.sha256("\0".join(map(str, (1, replicate, slot))).encode()).hexdigest()[:16], 16) % n


FRACTIONS = {"train": 0.6, "validation": 0.15, "calibration": 0.1, "final_test": 0.15}


@pytest.mark.parametrize("large", [0.0, 0.3])
def test_split_keeps_groups_whole_and_labels_near_their_shares(spark, plan, large):
    rng = random.Random(5)
    own = lambda g: (f"g{g}", "xxxyz"[g % 5]) if large else (f"g{g}", rng.choice("xxxyz"))  # noqa: E731  a large group displaces what shares groups with its label
    data = [own(rng.randrange(700)) for _ in range(4000)] + [("huge", "x")] * int(4000 * large) + [(None, "x"), (None, None)]
    rows = spark.createDataFrame(data, "grp string, label string")
    got = grouping.grouped_split(rows, "grp", "label", FRACTIONS).collect()
    assert Counter((r.grp, r.label) for r in got) == Counter(data)
    assert all(len({r.role for r in got if r.grp == g}) == 1 for g in {r.grp for r in got})
    total = Counter(r.label for r in got)
    for label in "xyz":
        roles = Counter(r.role for r in got if r.label == label)
        assert all(abs(roles[r] - f * total[label]) < 0.06 * total[label] + 5 for r, f in FRACTIONS.items())
    again = grouping.grouped_split(rows.repartition(5), "grp", "label", FRACTIONS).collect()
    assert {(r.grp, r.role) for r in again} == {(r.grp, r.role) for r in got}
