"""Sources and sinks: what is written comes back, and what does not fit fails."""

import hashlib
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, rows, settings, synthetic


def png(width, height, kind=2):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IEND", b"")


def test_jsonl(spark, tmp_path):
    data = [(2, "é\n\"", [1, 2]), (1, None, [])]
    rows.write_jsonl(spark.createDataFrame(data, "z int, a string, m array<int>"), str(tmp_path / "x"))
    lines = [line for p in (tmp_path / "x").glob("part*") for line in p.read_text().splitlines()]
    assert all(list(json.loads(line)) == ["a", "m", "z"] for line in lines)
    rows.append_events(spark.createDataFrame([(3, "b", [])], "z int, a string, m array<int>"), str(tmp_path / "x"))
    got = rows.read_jsonl(spark, str(tmp_path / "x"), "z int, a string, m array<int>").collect()
    assert sorted(map(tuple, got)) == sorted([(z, a, m) for z, a, m in data] + [(3, "b", [])])
    (tmp_path / "y.jsonl").write_text('{"z": 1}\n\n{"z": 2}\n')
    assert rows.read_jsonl(spark, str(tmp_path / "y.jsonl"), "z int").count() == 2
    (tmp_path / "y.jsonl").write_text('{"z": 1}\n[1\n')
    with pytest.raises(Exception):
        rows.read_jsonl(spark, str(tmp_path / "y.jsonl"), "z int").collect()


def test_document(spark, tmp_path):
    path = str(tmp_path / "d.json")
    for value in ({"b": 1, "a": ["é"]}, {"b": 2, "a": []}):
        rows.write_document(spark, path, value)
        assert (tmp_path / "d.json").read_text() == json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    assert rows.read_documents(spark, path, "a array<string>, b int").first()["b"] == 2
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []


def test_csv(spark, tmp_path):
    one = spark.createDataFrame([(1, 'a "q",\nb', [1, 2]), (2, "", [])], "n int, t string, xs array<int>")
    rows.write_csv(one, str(tmp_path / "a"), ["t", "n"])
    assert sorted(map(tuple, rows.read_csv(spark, str(tmp_path / "a"), ["t", "n"]).collect())) == [("", "2"), ('a "q",\nb', "1")]
    with pytest.raises(Exception):
        rows.read_csv(spark, str(tmp_path / "a"), ["n", "t"]).collect()
    rows.write_union_csv([one, spark.createDataFrame([(5,)], "b int")], str(tmp_path / "u"))
    got = rows.read_csv(spark, str(tmp_path / "u"), ["b", "n", "t", "xs"]).collect()
    assert sorted((r.b, r.xs) for r in got) == [("", "[1,2]"), ("", "[]"), ("5", "")]
    for nothing in ([], [one.limit(0)]):
        with pytest.raises(ValueError):
            rows.write_union_csv(nothing, str(tmp_path / "n"))


def test_files(spark, tmp_path):
    content = {"cat/a.png": png(64, 64), "cat/b.png": png(32, 64), "dog/c.png": b"no image", "dog/d.png": png(64, 64, 0)}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.images(spark, str(tmp_path))
    assert {r.path: (r.class_name, r.width, r.height, r.rgb) for r in found.collect()} == {
        "cat/a.png": ("cat", 64, 64, True), "cat/b.png": ("cat", 32, 64, True), "dog/c.png": ("dog", None, None, None), "dog/d.png": ("dog", 64, 64, False)
    }
    assert {r.path for r in files.image_violations(found, 64, 64).collect()} == {"cat/b.png", "dog/c.png", "dog/d.png"}
    actual = files.manifest(files.scan(spark, str(tmp_path)))
    assert {r.path: (r.bytes, r.sha256) for r in actual.collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items()}
    expected = actual.where("path <> 'cat/a.png'").withColumn("bytes", F.expr("IF(path = 'cat/b.png', 1L, bytes)")).withColumn("sha256", F.expr("IF(path = 'dog/c.png', '', sha256)"))
    expected = expected.unionByName(spark.createDataFrame([("gone", 1, "")], "path string, bytes long, sha256 string"))
    assert {tuple(r) for r in files.manifest_violations(expected, actual).collect()} == {("cat/a.png", "unlisted"), ("cat/b.png", "size"), ("dog/c.png", "digest"), ("gone", "missing")}
    assert files.manifest_violations(actual, actual).count() == 0


def test_arrays(spark, tmp_path):
    (tmp_path / "z").mkdir()
    np.savez(tmp_path / "z" / "a.npz", ids=np.arange(3), v=np.arange(6.0).reshape(3, 2))
    assert sorted((r.row, r.ids, r.v) for r in files.read_npz(spark, str(tmp_path / "z"), "ids", "v").collect()) == [(0, 0, [0, 1]), (1, 1, [2, 3]), (2, 2, [4, 5])]
    np.savez(tmp_path / "z" / "b.npz", ids=np.arange(2), v=np.zeros((3, 2)))
    with pytest.raises(Exception):
        files.read_npz(spark, str(tmp_path / "z"), "ids", "v").collect()
    data = io.BytesIO()
    np.save(data, np.arange(6, dtype=np.float32).reshape(2, 3))
    for name in "xy":
        (tmp_path / f"{name}.npy").write_bytes(data.getvalue())
    good = hashlib.sha256(data.getvalue()).hexdigest()
    known = lambda y: spark.createDataFrame([("x.npy", good), ("y.npy", y)], "path string, sha256 string")
    got = files.read_npy(spark, str(tmp_path), known(good)).collect()
    assert sorted((r.path, r.shape, r.values) for r in got) == [(p, [2, 3], [0, 1, 2, 3, 4, 5]) for p in ("x.npy", "y.npy")]
    for wrong in ("", None):
        with pytest.raises(Exception, match="digest of y.npy"):
            files.read_npy(spark, str(tmp_path), known(wrong)).collect()


def test_parts(spark):
    sizes = [(f"{i:04d}", (i * 37) % 101) for i in range(500)]
    at, want = 0, {}
    for path, n in sizes:
        want[path] = at // 1000
        at += n
    for count in (1, 7):
        table = spark.createDataFrame(sizes, "path string, bytes long").repartition(count)
        assert {r.path: r.part for r in files.parts(table, 1000).collect()} == want
    assert files.parts(table.limit(0), 1000).count() == 0


def test_settings(spark):
    base = {"a": {"b": 1}, "c": "x"}
    assert settings.override(base, "a.b=2.5", "c=y z") == {"a": {"b": 2.5}, "c": "y z"} and base["a"]["b"] == 1
    for bad in ("a.z=1", "a", "c.d=1"):
        with pytest.raises(KeyError):
            settings.override(base, bad)
    assert settings.parse('{"a": [1]}') == {"a": [1]}
    with pytest.raises(ValueError):
        settings.parse("[1]")
    row = spark.createDataFrame([(0.5, 0.125), (1.0, None)], "m double, s double").select(settings.latex_row(F.lit("r"), settings.latex_mean_sd(F.col("m"), F.col("s"))).alias("x"))
    assert sorted(r.x for r in row.collect()) == ["r & $0.50 \\pm 0.13$ \\\\", "r & $1.00$ \\\\"]


def test_synthetic(spark):
    found = synthetic.pixel_images(spark, 3, 4, 8)
    got = found.collect()
    assert len(got) == 12 and all(len(r.pixels) == 192 and 0 <= min(r.pixels) and max(r.pixels) <= 255 for r in got)
    assert got == synthetic.pixel_images(spark, 3, 4, 8).collect() and got != synthetic.pixel_images(spark, 3, 4, 8, 5).collect()
    reviews = synthetic.filled_reviews(found.select("image_id", "label"), "image_id", "label").collect()
    assert sorted(r.image_id for r in reviews if r.first == r.second == "reject") == [0, 4, 8] and {r.final for r in reviews} == {"accept"}
