"""Archives, settings, tensors, registered functions and the command line."""

import hashlib
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import registered, tensors
from lodestone.sources import archives, files, settings


def packed(tmp_path, entries, cut=100):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as out:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            out.addfile(info, io.BytesIO(content))
    whole, paths = data.getvalue(), []
    for k in range(0, len(whole), cut):
        paths.append(str(tmp_path / f"part-{k:06d}"))
        (tmp_path / f"part-{k:06d}").write_bytes(whole[k : k + cut])
    return paths


def test_archive_in_parts(spark, tmp_path):
    entries = [("a/x.json", b"{}" * 50), ("b.txt", bytes(range(256)))]
    listed = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in entries}
    paths = packed(tmp_path, entries)
    assert len(paths) > 1 and list(archives.members(paths, listed)) == entries
    told = {k: {"bytes": b, "sha256": h} for k, (b, h) in listed.items()}
    frame = spark.createDataFrame([(paths, told)], "parts array<string>, listed map<string,struct<bytes:bigint,sha256:string>>")
    assert sorted((r.path, bytes(r.content)) for r in archives.read(spark, frame).collect()) == entries
    for bad in ({**listed, "c": (1, "")}, {"b.txt": listed["b.txt"]}, {**listed, "b.txt": (256, "0")}):
        with pytest.raises(ValueError):
            list(archives.members(paths, bad))
    assert not any(map(archives.safe, ["/x", "..", "a/../b", "c:/x", "", "\\x", "x\\escape", "a/b:c", "a\0"])) and archives.safe("a/..b")


def test_settings_contract():
    assert settings.frozen_violations({"a": {"b": 1}, "c": True}, {"a": {"b": 1}, "c": True}) == []
    assert settings.frozen_violations({"a": {"b": 2}, "x": 0, "c": 1}, {"a": {"b": 1}, "c": True, "d": 1}) == ["a.b: 2 in place of 1", "c: 1 in place of True", "d: missing", "x: unknown"]
    assert settings.option_map(["a=b=c", " d = e "]) == {"a": "b=c", "d": "e"}
    for bad in (["a"], ["=b"], ["a="], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            settings.option_map(bad)
    assert settings.stage_id("s", {"b": 1, "a": 2}, "x") == settings.stage_id("s", {"a": 2, "b": 1}, "x") != settings.stage_id("s", {"a": 2}, "x")


def test_tensors(spark):
    x, y = [0.1, 0.9, 0.4, 0.2], [0.5, 0.5, 0.1, 0.7]
    rows = spark.createDataFrame([(1, x, y), (2, None, y)], "k int, x array<double>, y array<double>")
    got = rows.select("k", tensors.fourier_mix("x", "y", F.lit(0.0)).alias("same"), tensors.fourier_mix("x", "y", F.lit(0.4)).alias("m"), tensors.clipped_gain(F.col("x"), F.col("y"), F.lit(2.0)).alias("g")).orderBy("k").collect()
    assert got[0].same == pytest.approx(x) and got[1].m is None
    fx, fy = np.fft.fft(x), np.fft.fft(y)
    assert got[0].m == pytest.approx(np.clip(np.fft.ifft((0.6 * abs(fx) + 0.4 * abs(fy)) * np.exp(1j * np.angle(fx))).real, 0, 1).tolist())
    assert got[0].g == pytest.approx([min(1.0, a * (1 + 2 * b)) for a, b in zip(x, y)])
    out = rows.where("k = 1").select(tensors.resized(F.col("x"), 8).alias("r"), tensors.resized(F.col("x"), 4).alias("s"), tensors.normalised(F.col("x"), [0.5, 0.0], [0.5, 1.0]).alias("n")).first()
    assert out.s == pytest.approx(x) and out.r == pytest.approx(np.interp((np.arange(8) + 0.5) / 2 - 0.5, range(4), x).tolist()) and out.n == pytest.approx([-0.8, 0.9, -0.2, 0.2])
    sums = tensors.applied(spark.range(10).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")), "v", "id", lambda m: m.sum(1, keepdims=True), 3)
    assert {r.id: r.out for r in sums.collect()} == {i: [i + 1.0] for i in range(10)}


def test_registered_functions(spark):
    registered.register(spark)
    hostile = ["../escape", "/absolute", "C:/escape", "x\\escape", "a/b:c", "", "a/..", "a\0b", "a/..b", "..\n"]
    safe = spark.createDataFrame([(p,) for p in hostile], "p string").selectExpr("p", "lodestone_safe_path(p) AS safe")
    assert [r.p for r in safe.where("safe").collect()] == ["a/..b", "..\n"]
    got = spark.sql("SELECT lodestone_entropy(array(0.5D, 0.5D, 0D)) AS e, lodestone_hamming(6, 3) AS h, lodestone_digest('a', 'b') AS d, lodestone_safe_path('a/b') AS p, lodestone_safe_path('../b') AS q").first()
    assert (round(got.e, 6), got.h, got.d, got.p, got.q) == (0.693147, 2, hashlib.sha256(b"a\0b").hexdigest(), True, False)
    assert spark.sql("SELECT * FROM lodestone_conditions()").count() == 12
    drawn = spark.sql("SELECT r.id, t.slot, t.number FROM range(3) r, LATERAL lodestone_draws(1, r.id, 7) t").collect()
    assert len(drawn) == 21 and all(r.number == int(hashlib.sha256(f"1\0{r.id}\0{r.slot}".encode()).hexdigest()[:16], 16) % 7 for r in drawn)


def test_npz_comes_back(spark, tmp_path):
    (tmp_path / "v.npz").write_bytes(files.npz_bytes([3, 1], [[1.0, 2.0], [3.0, 4.0]]))
    assert sorted((r.ids, r.vectors) for r in files.read_npz(spark, str(tmp_path), "ids", "vectors").collect()) == [(1, [3.0, 4.0]), (3, [1.0, 2.0])]


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("{}")
    (tmp_path / "in" / "b.bin").write_text("x")
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("data-manifest", "--folder", tmp_path / "in", "--out", tmp_path / "m") == 0
    assert run("data-verify", "--folder", tmp_path / "in", "--manifest", tmp_path / "m") == 0
    (tmp_path / "in" / "b.bin").write_text("y")
    assert run("data-verify", "--folder", tmp_path / "in", "--manifest", tmp_path / "m") == 1
    assert run("report-inputs", "--folder", tmp_path / "in", "--out", tmp_path / "i") == 0 and [r.path for r in spark.read.parquet(str(tmp_path / "i")).collect()] == ["a.json"]
    spark.createDataFrame([(k, k // 2, k % 2, float(k), k % 4 > 1) for k in range(40)], "k long, g long, c long, x double, y boolean").write.parquet(str(tmp_path / "rows"))
    assert run("split-create", "--rows", tmp_path / "rows", "--group", "g", "--label", "c", "--role", "train=0.5", "--role", "test=0.5", "--out", tmp_path / "s") == 0
    assert run("split-verify", "--rows", tmp_path / "s", "--key", "k", "--group", "g", "--label", "c", "--role", "train", "--role", "test") == 0
    assert run("detector-fit", "--rows", tmp_path / "rows", "--target", "y", "--feature", "x", "--feature", "c", "--out", tmp_path / "d.json") == 0
    assert run("detector-evaluate", "--rows", tmp_path / "rows", "--model", tmp_path / "d.json", "--out", tmp_path / "e") == 0
    assert spark.read.parquet(str(tmp_path / "e")).first().n == 40
    assert run("statistics", "--left", tmp_path / "rows", "--right", tmp_path / "rows", "--key", "k", "--group", "g", "--value", "x", "--replicates", 50, "--out", tmp_path / "t") == 0
    assert tuple(spark.read.parquet(str(tmp_path / "t")).first()) == (0.0, 0.0, 0.0, 20)
    assert run("query", "--name", "run_matrix", "--data", "/root/testdata/sf0.001", "--out", tmp_path / "q") == 0 and spark.read.parquet(str(tmp_path / "q")).count() == 15
    with pytest.raises(SystemExit):
        cli.main(["no-such-command"])
