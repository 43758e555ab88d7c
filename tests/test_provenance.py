"""The graph of digests: a tampered leaf, a missing file and a cycle each give their row."""

import hashlib

from lodestone import cli
from lodestone.operators import provenance
from lodestone.sources import files

NODES, EDGES = "node string, digest string", "parent string, child string, expected string"


def graph(spark, digests, edges, told=None):
    nodes = spark.createDataFrame(list(digests.items()), NODES)
    return nodes, spark.createDataFrame([(p, c, (told or {}).get((p, c), digests.get(c, "lost"))) for p, c in edges], EDGES)


def found(nodes, edges):
    return {tuple(r) for r in provenance.problems(nodes, edges).collect()}


CHAIN = [("report", "metrics"), ("metrics", "pairs"), ("pairs", "split"), ("split", "data"), ("report", "config"), ("pairs", "config")]
DIGESTS = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("report", "metrics", "pairs", "split", "data", "config")}


def test_a_sound_graph(spark):
    nodes, edges = graph(spark, DIGESTS, CHAIN)
    assert found(nodes, edges) == set() and provenance.affected(nodes, edges).count() == 0
    assert {r.node: r.level for r in provenance.levels(nodes, edges).collect()} == {"data": 0, "config": 0, "split": 1, "pairs": 2, "metrics": 3, "report": 4}
    assert found(nodes.limit(0), edges.limit(0)) == set()


def test_a_tampered_leaf(spark):
    nodes, edges = graph(spark, DIGESTS, CHAIN, {("split", "data"): "before"})
    assert found(nodes, edges) == {("data", "digest", "split", 0)}
    assert {tuple(r) for r in provenance.affected(nodes, edges).collect()} == {(n, "data", 0) for n in ("data", "split", "pairs", "metrics", "report")}


def test_a_missing_file_and_a_deeper_cause(spark):
    nodes, edges = graph(spark, {k: v for k, v in DIGESTS.items() if k != "config"}, CHAIN, {("metrics", "pairs"): "before"})
    assert found(nodes, edges) == {("config", "missing", "report", 0), ("config", "missing", "pairs", 0), ("pairs", "digest", "metrics", 2)}
    causes = {r.node: r.cause for r in provenance.affected(nodes, edges).collect()}
    assert causes == {"config": "config", "pairs": "config", "metrics": "config", "report": "config"}


def test_a_cycle(spark):
    nodes, edges = graph(spark, DIGESTS, [*CHAIN, ("data", "pairs")])
    assert found(nodes, edges) == {(n, "cycle", None, None) for n in ("data", "split", "pairs", "metrics", "report")}
    assert {r.node for r in provenance.affected(nodes, edges).collect()} == {"data", "split", "pairs", "metrics", "report"}


def test_a_node_of_two_digests(spark):
    nodes, edges = graph(spark, DIGESTS, CHAIN)
    twice = nodes.unionByName(spark.createDataFrame([("split", "other"), ("data", DIGESTS["data"])], NODES))
    assert found(twice, edges) == {("split", "repeated", None, 1)}


def test_freeze_and_verify_a_folder(spark, tmp_path, monkeypatch):
    folder = tmp_path / "run"
    folder.mkdir()
    for name in ("config.yaml", "split.json", "pairs.jsonl"):
        (folder / name).write_text(name)
    monkeypatch.setattr(cli, "_session", lambda: spark)
    frozen, out = str(tmp_path / "frozen"), str(tmp_path / "problems")
    assert cli.main(["freeze-protocol", "--folder", str(folder), "--name", "protocol", "--out", frozen]) == 0
    assert cli.main(["verify-protocol", "--folder", str(folder), "--frozen", frozen]) == 0
    (folder / "split.json").write_text("changed")
    (folder / "config.yaml").unlink()
    assert cli.main(["verify-protocol", "--folder", str(folder), "--frozen", frozen, "--out", out]) == 1
    assert {(r.node, r.problem) for r in spark.read.parquet(out).collect()} == {("split.json", "digest"), ("config.yaml", "missing")}
    edges = spark.read.parquet(frozen)
    one, two = (provenance.frozen_node(e).first().digest for e in (edges, edges.repartition(3)))
    assert one == two != provenance.frozen_node(provenance.freeze(provenance.scanned(files.scan(spark, str(folder))), "protocol")).first().digest
