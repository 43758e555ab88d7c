"""Near-duplicate groups whose members are all alike cost links and not pairs, and parts of any size are compared in blocks."""

import hashlib
import random
from itertools import combinations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from lodestone.operators import grouping
from lodestone.plans import catalogue


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def near(values, radius=4):
    return {(i, j, (v ^ w).bit_count()) for (i, v), (j, w) in combinations(enumerate(values), 2) if (v ^ w).bit_count() <= radius}


def crowd(n, seed):
    """Different numbers, most of them near one another; every third stands further off."""
    rng, found = random.Random(seed), {}
    centre = rng.getrandbits(64)
    while len(found) < n:
        found[centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 8))))] = None
    return list(found)


def roots(n, links):
    top = list(range(n))
    for a, b in sorted((a, b) for a, b, *_ in links):
        low, high = sorted((top[a], top[b]))
        top = [low if t == high else t for t in top]
    return top


def test_links_of_alike_texts_grow_with_the_texts(spark, monkeypatch, tmp_path):
    texts = [" ".join([f"w{k}" for k in range(400)] + [f"x{i}.{k}" for k in range(10)]) for i in range(200)]
    spark.createDataFrame(list(enumerate(texts)) + [(900, "far"), (901, "far")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, step = [], grouping.connected_components
    monkeypatch.setattr(grouping, "connected_components", lambda edges, *a: (counts.append(edges.count()), step(edges, *a))[1])
    got = {r.doc_id: r.group_key for r in catalogue.dup_components(spark, str(tmp_path)).collect()}
    bits = [grouping.word_bits(t) % (1 << 64) for t in texts]
    assert len(near(bits)) > 5000
    assert counts[0] < 15 * 200  # at most a link for each number and set of bands
    assert got == dict(enumerate(roots(200, near(bits)))) | {900: 900, 901: 900}


def test_parts_in_blocks_give_all_edges_and_a_forest_their_components(spark, monkeypatch):
    values = crowd(180, 3)
    rows = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "id long, h long")
    monkeypatch.setattr(grouping, "BLOCK", 25)
    got = [tuple(r) for r in grouping.hamming_edges(rows, "id", "h").collect()]
    assert len(got) == len(set(got)) and set(got) == near(values)
    links = [tuple(r) for r in grouping.hamming_edges(rows, "id", "h", forest=True).collect()]
    assert roots(180, links) == roots(180, got) and len(set(roots(180, got))) > 1


def test_near_places_of_small_large_and_crossed_groups():
    values, rng = crowd(400, 4), random.Random(4)
    h = np.array(values, np.uint64)
    starts = np.array([0, 1, 41, 51, 200])
    crossed = np.repeat([False, False, True, False, True], np.diff(np.append(starts, 400)))
    block = np.array([0] * 400)
    for s, e in ((41, 51), (200, 400)):
        block[s:e] = sorted(rng.choice((3, 7)) for _ in range(s, e))
    got = [p for i, j in grouping.near_places(h, starts, block, crossed, 4) for p in zip(i.tolist(), j.tolist())]
    group = np.searchsorted(starts, np.arange(400), "right")
    want = {(i, j) for i, j, _ in near(values) if group[i] == group[j] and not (crossed[i] and block[i] == block[j])}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_group_ids_go_on_over_batches(spark):
    rng = random.Random(6)
    members = [(rng.choice((1, 2, 2, 2, 5)), rng.choice((None, f"{rng.getrandbits(64):x}"))) for _ in range(90)] + [(9, None)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.k: r.group_id for r in grouping.content_ids(spark.createDataFrame(members, "k long, c string"), "k", "c").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {k: hashlib.sha256("\n".join(sorted(c for g, c in members if g == k and c is not None)).encode()).hexdigest() for k, _ in members}


def test_a_file_of_one_row_group_is_told_in_many_tasks(spark, monkeypatch, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c"), F.col("id")).alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(grouping, "word_bits", lambda text: TaskContext.get().partitionId())
    rows = catalogue.content_bits(spark, str(tmp_path))
    assert rows.count() == 3000
    assert rows.select("bits").distinct().count() > 1
