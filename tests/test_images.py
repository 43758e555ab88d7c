"""Image tensors and their cache against plain loops."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import images
from lodestone.sources import cache, files

RNG = np.random.default_rng(4)


def rows_of(spark, arrays, *more):
    data = [(i, (list(a.shape), a.ravel().tolist()) if a is not None else None, *(m[i] for m in more)) for i, a in enumerate(arrays)]
    kinds = "".join(f", m{k} {kind}" for k, kind in enumerate(["struct<shape:array<int>,values:array<double>>", "string", "double", "array<double>"][: len(more)]))
    return spark.createDataFrame(data, f"i int, image struct<shape:array<int>,values:array<double>>{kinds}")


def back(rows, column):
    return {r.i: None if r[column] is None else np.array(r[column]["values"]).reshape(r[column]["shape"]) for r in rows.collect()}


def hand_resampled(line, out):
    """Bicubic with a kernel that widens with the step, one value at a time."""
    n, step, found = len(line), len(line) / out, []
    wide = max(step, 1.0)
    for o in range(out):
        centre, total, weights = (o + 0.5) * step, 0.0, 0.0
        for i in range(max(0, math.floor(centre - 2 * wide + 0.5)), min(n, math.floor(centre + 2 * wide + 0.5))):
            t = abs((i + 0.5 - centre) / wide)
            w = 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0
            total, weights = total + w * line[i], weights + w
        found.append(total / weights)
    return np.array(found)


@pytest.mark.parametrize("size", [(64, 16), (16, 64), (64, 48), (48, 64), (7, 5), (5, 5), (1, 4)])
def test_resampling_by_hand(size):
    plane = RNG.random((size[0], 3))
    got = images.kernel(*size) @ plane
    assert np.allclose(got, np.stack([hand_resampled(plane[:, k], size[1]) for k in range(3)], 1), atol=1e-12)


def test_interventions(spark):
    """Formulas, sham as identity, severities in order, a null source, mixed shapes in one batch."""
    a, b = RNG.random((3, 64, 64)), RNG.random((3, 64, 64))
    small = RNG.random((3, 4, 4))
    cases = [(a, b, "gain", 1.0, [1.05, 0.95, 1.0]), (a, b, "mix", 0.0, None), (a, b, "mix", 0.4, None), (a, b, "resolution", 48.0, None), (a, b, "resolution", 16.0, None), (a, b, "resolution", 64.0, None), (small, small[:, ::-1], "mix", 0.25, None), (None, b, "mix", 0.1, None)]
    wire = lambda x: (list(x.shape), x.ravel().tolist())
    rows = rows_of(spark, [c[0] for c in cases], [wire(c[1]) for c in cases], *([c[k] for c in cases] for k in (2, 3, 4)))
    got = back(rows.select("i", images.intervene(F.col("image"), F.col("m0"), F.col("m1"), F.col("m2"), F.col("m3")).alias("out")), "out")
    assert np.allclose(got[0], np.clip(a * np.array([1.05, 0.95, 1])[:, None, None], 0, 1)) and np.allclose(got[0][2], a[2])
    assert np.allclose(got[1], a, atol=2e-6) and np.allclose(got[5], a, atol=1e-12) and got[7] is None
    assert got[3].shape == a.shape and np.abs(got[4] - a).mean() > np.abs(got[3] - a).mean()
    wave = np.exp(-2j * np.pi * np.outer(range(4), range(4)) / 4)  # brute-force transform of 4 x 4 planes
    for c in range(3):
        one, two = wave @ small[c] @ wave, wave @ small[c, ::-1] @ wave
        amplitude = 0.75 * np.abs(one) + 0.25 * np.abs(two)
        plane = (wave.conj() @ (amplitude * np.exp(1j * np.angle(one))) @ wave.conj()).real / 16
        assert np.allclose(got[6][c], np.clip(plane, 0, 1), atol=1e-9)


@pytest.mark.parametrize("family, shape", [("mix", (3, 5, 4)), ("blur", (3, 4, 4))])
def test_wrong_interventions_are_errors(spark, family, shape):
    a = RNG.random((3, 4, 4))
    rows = rows_of(spark, [a], [(list(shape), RNG.random(shape).ravel().tolist())], [family], [0.5], [[1.0, 1.0, 1.0]])
    with pytest.raises(Exception, match="tensor of shape"):
        rows.select(images.intervene(F.col("image"), F.col("m0"), F.col("m1"), F.col("m2"), F.col("m3"))).collect()


def filtered(pixels, kinds):
    """PNG lines with the given filters, by the definition of each."""
    lines = []
    for y, kind in enumerate(kinds):
        line, out = pixels[y].reshape(-1), []
        above = pixels[y - 1].reshape(-1) if y else np.zeros_like(line)
        for i, v in enumerate(line.tolist()):
            left, up, corner = (int(line[i - 3]) if i >= 3 else 0), int(above[i]), (int(above[i - 3]) if i >= 3 else 0)
            guess = left + up - corner
            nearest = min((left, up, corner), key=lambda x: abs(guess - x))
            out.append((v - [0, left, up, (left + up) // 2, nearest][kind]) % 256)
        lines.append([kind, *out])
    return np.array(lines, np.uint8)


def test_filters_of_png_lines():
    pixels = RNG.integers(0, 256, (10, 6, 3)).astype(np.int64)
    kinds = [k % 5 for k in range(10)]
    assert (images.unpredicted(filtered(pixels, kinds), 3).reshape(10, 6, 3) == pixels).all()


def test_decode_from_folders(spark, tmp_path):
    made = {}
    for k in range(6):
        (tmp_path / f"class{k % 2}").mkdir(exist_ok=True)
        pixels = RNG.integers(0, 256, (3, 5, 7)) / 255
        made[f"class{k % 2}/{k}.png"] = pixels
        (tmp_path / f"class{k % 2}" / f"{k}.png").write_bytes(images.encode_png(pixels))
    found = files.scan(spark, str(tmp_path), "*.png")
    manifest = spark.createDataFrame(files.manifest(found).collect())
    got = {r.path: np.array(r.image["values"]).reshape(r.image["shape"]) for r in images.decoded(found, manifest).collect()}
    assert set(got) == set(made) and all(np.allclose(got[p], made[p]) for p in made)
    path = tmp_path / "class0" / "0.png"
    whole = path.read_bytes()
    for broken in (whole[:-20], whole[:40] + b"x" + whole[41:], b"no image"):
        path.write_bytes(broken)
        with pytest.raises(Exception, match="class0/0.png"):
            images.decoded(files.scan(spark, str(tmp_path), "*.png")).collect()
    with pytest.raises(Exception, match="digest of class0/0.png"):
        images.decoded(files.scan(spark, str(tmp_path), "*.png"), manifest).collect()
    with pytest.raises(Exception, match="digest of"):
        images.decoded(files.scan(spark, str(tmp_path), "*.png"), manifest.where("path <> 'class1/1.png'")).collect()


def test_preprocessing(spark):
    a = RNG.random((3, 4, 6))
    sized = rows_of(spark, [a, None]).select("i", images.resize(F.col("image"), 9).alias("image"))
    got = back(sized.select("i", images.normalise(F.col("image")).alias("out")), "out")
    by_hand = [[hand_resampled(row, 9) for row in np.stack([hand_resampled(a[c, :, x], 9) for x in range(6)], 1)] for c in range(3)]
    assert got[1] is None and np.allclose(got[0], [(np.array(p) - m) / s for p, m, s in zip(by_hand, images.MEAN, images.DEVIATION)])
    with pytest.raises(Exception, match="other channels"):
        rows_of(spark, [a[:2]]).select(images.normalise(F.col("image"))).collect()


def test_difference_hash_of_a_ramp(spark):
    ramp = np.tile(np.linspace(0, 1, 64), (3, 64, 1))
    got = [r.h for r in rows_of(spark, [ramp, ramp[:, :, ::-1], None]).orderBy("i").select(images.difference_hash(F.col("image")).alias("h")).collect()]
    assert got == [-1, 0, None]


def listing(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def test_cache_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "cache")
    arrays = [RNG.random((3, 2, 2)) for _ in range(9)]
    rows = rows_of(spark, arrays).select("image", cache.cache_key({"b": F.col("i"), "a": {"y": F.lit(None).cast("string"), "x": F.lit(1)}}).alias("cache_key")).repartition(3)
    filled = {r.cache_key: r for r in cache.fill(rows, folder, "image").collect()}
    keys = [hashlib.sha256(f'{{"a":{{"x":1,"y":null}},"b":{i}}}'.encode()).hexdigest() for i in range(9)]
    assert set(filled) == set(keys)
    for key, a in zip(keys, arrays):
        content = open(f"{folder}/{filled[key].path}", "rb").read()
        assert content == images.npy(a) and (len(content), hashlib.sha256(content).hexdigest()) == (filled[key].bytes, filled[key].sha256)
    before = listing(folder)
    cache.fill(rows, folder, "image")
    assert listing(folder) == before and cache.violations(rows, folder).count() == 0
    assert not [p for p in before if p.endswith(".tmp")]
    more = rows_of(spark, [*arrays, arrays[0]]).select("image", cache.cache_key({"b": F.col("i"), "a": {"y": F.lit(None).cast("string"), "x": F.lit(1)}}).alias("cache_key"))
    assert cache.fill(more, folder, "image").count() == 10
    assert {p: t for p, t in listing(folder).items() if p in before} == before


def test_a_killed_task_leaves_the_same_files(spark, tmp_path):
    """The first try of every task writes its files and dies before the commit."""
    folder, mark = str(tmp_path / "cache"), str(tmp_path / "mark")
    content = [(hashlib.sha256(str(k).encode()).hexdigest(), images.npy(RNG.random((3, 2, 2)))) for k in range(8)]
    spark.dataSource.register(cache.CacheSource)
    rows = spark.createDataFrame(content, cache.ROWS).repartition(2)

    def dies_once(batches):
        from pyspark import TaskContext

        at = f"{mark}-{TaskContext.get().partitionId()}"
        yield from batches
        if not os.path.exists(at):
            open(at, "w").close()
            raise RuntimeError("killed")

    failing = rows.mapInArrow(dies_once, rows.schema)
    with pytest.raises(Exception, match="killed"):  # local tasks are not tried again
        failing.write.format("lodestone_cache").option("path", folder).mode("append").save()
    assert cache.committed(spark, folder).count() == 0
    failing.write.format("lodestone_cache").option("path", folder).mode("append").save()
    assert {(r.cache_key, r.sha256) for r in cache.committed(spark, folder).collect()} == {(k, hashlib.sha256(c).hexdigest()) for k, c in content}
    assert len([p for p in listing(folder) if p.endswith(".npy")]) == 8


def test_cache_violations(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = rows_of(spark, [RNG.random((3, 2, 2)) for _ in range(5)]).select("image", F.col("i").cast("string").alias("cache_key"))
    paths = {r.cache_key: f"{folder}/{r.path}" for r in cache.fill(rows.where("i < 4"), folder, "image").collect()}
    os.remove(paths["0"])
    whole = open(paths["1"], "rb").read()
    open(paths["1"], "wb").write(whole + b"x")
    open(paths["2"], "wb").write(whole[:-1] + b"\x7f")
    for p in (paths["1"], paths["2"]):  # checksums of the file system would hide the change
        crc = os.path.join(os.path.dirname(p), "." + os.path.basename(p) + ".crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert {(r.cache_key, r.problem) for r in cache.violations(rows, folder).collect()} == {("0", "missing"), ("1", "size"), ("2", "digest"), ("4", "uncommitted")}


def test_workers_hold_slices_and_not_batches_of_outputs(spark, monkeypatch):
    arrays = [None if k % 50 == 7 else RNG.random((3, 8, 8)) for k in range(600)]
    held = []
    steps = images._sliced(lambda t: held.append(len(t)) or images._resized(t, images.pa.array([28] * len(t))))
    out = [a for part in steps(iter([images._tensors(arrays[:590]), images._tensors([]), images._tensors(arrays[590:])])) for a in images._arrays(part)]
    assert max(held) <= images.AT_ONCE and len(out) == 600
    rows = rows_of(spark, arrays).coalesce(1)
    one = back(rows.select("i", images.normalise(images.resize(F.col("image"), 28)).alias("r")), "r")
    two = back(rows.select("i", images.preprocessed(F.col("image"), 28).alias("r")), "r")
    mean, deviation = (np.array(v)[:, None, None] for v in (images.MEAN, images.DEVIATION))
    for k, a in enumerate(arrays):
        if a is None:
            assert out[k] is None and one[k] is None and two[k] is None
        else:
            assert np.allclose(out[k], images.resampled(a, 28, 28)) and np.array_equal(one[k], two[k]) and np.allclose(two[k], (out[k] - mean) / deviation)
