"""Whitening, collocations and nearest neighbours against brute force; rows of one doc_id in substring dedup."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, neighbours, substrings, vectors, whitening
from lodestone.llm.queries import QUERIES

def clashing():
    return [F.lit("clash").alias(c) for c in ("x", "n", "id", "v", "q", "rank", "score", "component", "query", "key", "phrase", "k", "salt")]


VECTORS = "vec_id long, embedding array<float>"


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(901, None), (902, [1.0, None, 0.5]), (903, [nan, 0.0, 0.0]), (904, [inf, 0.0, 0.0]), (905, []), (906, [1.0, 2.0])]


def brute_whitening(rows, components=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    apart = ((n * x - sums) / n).astype(float)
    e, axes = np.linalg.eigh(apart.T @ apart / n)
    e, axes = e[::-1], axes[:, ::-1]
    return n, deviation, apart @ axes[:, :components] / np.sqrt(e[:components]), e / e.sum()


def test_whitening_query_against_numpy(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, deviation, white, share = brute_whitening(rows)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert np.abs(white * np.sign((white * wide).sum(0)) - wide).max() < 1e-9
    assert dict(zip(got.vec_id, got.deviation)) == {i: d for (i, _), d in zip(rows, deviation)}
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert np.abs(got.groupby("component").explained.first().to_numpy() - share[:8]).max() < 1e-12


def test_whitening_merges_lose_nothing(spark, monkeypatch):
    """Many partitions, small blocks and a fan of two give what one block gives."""
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**6), 10**6, (500, 7)) + 10**9
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(13)
    found, whole = whitening.fit(table), whitening.summary(x)
    assert (found.n, found.sums) == (500, x.sum(0).tolist() == found.sums and found.sums)
    assert np.allclose(found.values, whole.values, rtol=1e-12)
    assert np.allclose(np.abs((found.axes * whole.axes).sum(1)), 1, atol=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(3).tolist()) for i in range(40)]
    rows += [rows[0], (None, [0.25, 0.5, -1.0]), (999, [3e38, 0.0, 0.0])]
    table = spark.createDataFrame(rows + odd_vectors(), VECTORS).select("*", *clashing())
    got = whitening.whiten(table).toPandas()
    n, deviation, white, _ = brute_whitening([(i, np.float32(v)) for i, v in rows[:-1]], 3)
    assert (got.n == n).all() and set(got.component) == {1, 2, 3} and len(got) == 3 * n
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert np.allclose(sorted(got[got.component == 2].whitened.abs()), sorted(np.abs(white[:, 1])), atol=1e-9)
    assert got.vec_id.isna().sum() == 3 and (got.vec_id == 0).sum() == 6


def test_whitening_without_variance(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], VECTORS)).collect()
    assert len(flat) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in flat)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])], VECTORS)).collect()
    assert [r.whitened is None for r in sorted(line)] == [False, True] * 3 and line[0].identity_error < 1e-12
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


def test_exact_deviations_beyond_64_bits():
    block = np.array([[1 << 40, -5], [7, 9], [7, 9]])
    sums = whitening._whole_sums(block)
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in block]
    assert sums == block.sum(0).tolist() and whitening._deviations(block, 3, sums) == [e if e < 1 << 63 else None for e in exact]


def brute_phrases(rows, least, first):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = (b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * b >= 80 * a for b in longer):
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["Ab", "ab", "b", "É", "é", "日本", "x\x00y", "'q", " ", "z\x1fz", "🎉", "c", "d", "e"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "de", None, "und"]), text(rng.randrange(60))) for _ in range(400)]
    return rows + [("en", None), (None, ""), ("fr", "a a a a a a a " * 40), ("de", "  ...  "), ("en", "x " * 50_000 + text(3000))] + rows[:20]


@pytest.mark.parametrize("parts", [1, 7])
def test_collocations_against_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 5000)  # texts over many blocks, long ones cut
    rows = phrase_rows()
    docs = spark.createDataFrame([(i % 50, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(parts)
    got = collocations.mine(docs.select("*", *clashing()), first=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 30, 50)


def test_a_full_sketch_changes_no_result(spark, monkeypatch):
    """Few cells bound badly: more phrases are scanned, the same are found."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations.mine(docs, first=50).collect())) == brute_phrases(rows, 30, 50)


def test_sketch_bounds_are_upper_bounds(spark):
    rows = phrase_rows()
    texts = spark.createDataFrame([(lang or "und", t or "") for lang, t in rows], "lang string, text string")
    heavy = collocations.sketch(texts, 10)
    by = collections.defaultdict(list)
    for lang, t in rows:
        by[lang or "und"].append((t or "").encode())
    true = collections.Counter()
    for lang, held in by.items():
        block = collocations.read(lang, held)
        assert {b" ".join(block.words[i : i + 2]) for i in np.flatnonzero(block.room > 1)} >= set(p for p in collocations.candidates(block, heavy, 10) if p.count(b" ") == 1)
        for k in range(4):
            at = np.flatnonzero(block.room > k)
            true.update((lang, b" ".join(block.words[i : i + k + 1]), int(c)) for i, c in zip(at.tolist(), collocations._cells(block, k, 10)[at]))
    assert all(heavy[c >> 3] >> (c & 7) & 1 for (_, _, c), n in true.items() if n >= 30)


def test_products_beyond_64_bits(spark):
    big = 10**13
    phrases = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big + 3), ("en", "a b", 2, big)], "lang string, phrase string, k int, f long")
    row = collocations.scored(phrases).first()
    assert (row.score, row.l, row.r) == (2000000 * big // (2 * big + 4), big + 1, big + 3)


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.mine(docs).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None)], docs.schema)).collect() == []


def brute_search(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, v = np.array([i for i, _ in rows]), np.array([w for _, w in rows], float)
    out = {}
    for i, w in rows:
        if i % every == 0:
            scores = neighbours.products(np.tile(np.array(w, float), (len(v), 1)), v)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def listed(found):
    by = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(by[r.query_id]) + 1
        by[r.query_id].append((r.vec_id, r.score))
    return dict(by)


def test_search_recall_on_the_table(spark):
    got = listed(QUERIES["op13_neighbours"](spark, "/root/testdata/sf0.1"))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    truth = brute_search(rows, 20, 20)
    assert set(got) == set(truth) and all(len(x) == 20 for x in got.values())
    score = {q: dict(brute) for q, brute in brute_search(rows, len(rows), 20).items()}
    assert all(score[q][i] == s for q, x in got.items() for i, s in x)  # scores are those of the vectors
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 20 for q in truth]) >= 0.95


def test_search_of_clusters_and_copies(spark):
    """A third of the rows are one vector; norms differ; odd rows take no part; clashing columns."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 12))
    rows = [(i, ((centres[i % 30] + 0.1 * rng.normal(size=12)) * rng.uniform(0.5, 3)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(i, rows[0][1]) for i in range(1200, 1800)]
    odd = [(None, rows[1][1]), (2000, [0.0] * 12), (2020, None), (2040, [float("nan")] * 12), (2060, [1.0] * 11)]
    table = spark.createDataFrame(rows + rows[:40] + odd, VECTORS).select("*", *clashing()).repartition(5)
    got, truth = listed(neighbours.search(table)), brute_search(rows, 20, 20)
    assert set(got) == set(truth) and all(len(got[q]) == 20 for q in got)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 20 for q in truth]) >= 0.95
    assert got[1200] == truth[1200]  # ties of copies go to the smaller ids


def test_search_of_few_rows(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(5)]
    assert listed(neighbours.search(spark.createDataFrame(rows, VECTORS))) == brute_search(rows, 20, 20)
    assert neighbours.search(spark.createDataFrame([(20, [1.0])], VECTORS)).collect() == []
    assert neighbours.search(spark.createDataFrame([], VECTORS)).collect() == []
    two = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0])]
    assert sorted(map(tuple, neighbours.search(spark.createDataFrame(two, VECTORS)).collect())) == [(20, 1, 7, 1.0), (20, 1, 7, 1.0)]


def test_a_short_radius_is_widened(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "calibrated", lambda *a: 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    got = listed(neighbours.search(spark.createDataFrame(rows, VECTORS)))
    assert all(len(x) == 20 for x in got.values()) and len(got) == 5


@pytest.mark.parametrize("radius", [0, 5, 16, 33, 60, 120, 256])
def test_probes_reach_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 16, (700, neighbours.SUBSTRINGS)).astype(np.uint16)
    flips = np.packbits(rng.random((40, neighbours.BITS)) < radius / 300, axis=1, bitorder="little").view("<u2")
    queries = codes[:40] ^ flips
    far = neighbours.distances(queries, codes)
    q, r = neighbours.Shard(codes).within(queries, radius)
    assert set(zip(q.tolist(), r.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius))))


def test_usable_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])] + odd_vectors(), VECTORS)
    assert sorted(r.vec_id for r in vectors.usable(table).collect()) == [1, 2]
    assert [r.vec_id for r in vectors.usable(table, zero=False).collect()] == [1]


def test_rows_of_one_doc_id_with_equal_short_hashes(spark):
    """Rows without doc_id whose 32-bit hashes agree: only the one that repeats a passage loses it."""
    words = lambda seed, n: " ".join(f"w{seed}x{i}" for i in range(n))
    passage = words("p", 60)
    texts = spark.range(300_000).select(F.concat(F.lit(passage + " tail "), F.col("id").cast("string")).alias("a"), F.concat(F.lit(words("q", 70) + " end "), F.col("id").cast("string")).alias("b"))
    pair = texts.select(F.hash("a").alias("h"), "a").join(texts.select(F.hash("b").alias("h"), "b"), "h").orderBy("a").first()
    rows = [(1, passage), (None, pair.a), (None, pair.b), (None, None)] + [(None, words(s, 40)) for s in range(30)]
    got = {(r.doc_id, r.n_removed > 0, r.text) for r in substrings.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {t for _, lost, t in got if not lost}
    assert {pair.b, passage, "", *(words(s, 40) for s in range(30))} == kept
    assert [t.split()[-2:] for _, lost, t in got if lost] == [pair.a.split()[-2:]]
