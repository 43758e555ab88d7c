"""Command line: python -m lodestone.cli COMMAND ...; tables are read and written as Parquet."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.operators import contracts, detectors, grouping, images, inference, metrics, pairs, provenance, reports, selections, tables
from lodestone.plans import catalogue, pixels, studies  # noqa: F401
from lodestone.sources import cache, files, rows, settings


def _session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _put(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def _none_left(problems: DataFrame, out: str | None) -> int:
    """1 and a few offenders on standard error if there are any, else 0."""
    if out:
        _put(problems, out)
    some = problems.limit(5).collect()
    for r in some:
        print(r.asDict(), file=sys.stderr)
    return int(bool(some))


def queries(spark: SparkSession, a: argparse.Namespace) -> int:
    print("\n".join(sorted(catalogue.QUERIES)))
    return 0


def query(spark: SparkSession, a: argparse.Namespace) -> int:
    _put(catalogue.QUERIES[a.name](spark, a.data), a.out)
    return 0


def validate_config(spark: SparkSession, a: argparse.Namespace) -> int:
    read = lambda p: settings.parse(open(p, encoding="utf-8").read())
    found = settings.frozen_violations(settings.override(read(a.config), *a.set), read(a.contract))
    print("\n".join(found))
    return int(bool(found))


def preflight(spark: SparkSession, a: argparse.Namespace) -> int:
    plan = spark.read.parquet(a.rows)
    found = contracts.preflight(plan, "step_seconds", "steps", "epochs", "batch", "world", "memory", a.hours, a.memory)
    _put(found, a.out)
    return _none_left(found.where("NOT passed"), None)


def data_manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    _put(files.manifest(files.scan(spark, a.folder, a.pattern)), a.out)
    return 0


def data_verify(spark: SparkSession, a: argparse.Namespace) -> int:
    return _none_left(files.manifest_violations(spark.read.parquet(a.manifest), files.manifest(files.scan(spark, a.folder, a.pattern))), a.out)


def split_create(spark: SparkSession, a: argparse.Namespace) -> int:
    shares = {k: float(v) for k, v in settings.option_map(a.role).items()}
    _put(grouping.grouped_split(spark.read.parquet(a.rows), a.group, a.label, shares, a.seed), a.out)
    return 0


def split_verify(spark: SparkSession, a: argparse.Namespace) -> int:
    return _none_left(contracts.split_contract(spark.read.parquet(a.rows), a.key, a.group, "role", a.label, a.role, a.least), a.out)


def pairs_create(spark: SparkSession, a: argparse.Namespace) -> int:
    each = pairs.expand(spark.read.parquet(a.rows))
    _put(each.withColumn("pair_id", ids.digest("pair", F.col(a.key), F.col("family"), F.col("severity"))), a.out)
    return 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    each = metrics.pair_metrics(pairs.pairs(spark, a.data, a.temperature))
    _put(each, f"{a.out}/pairs")
    _put(metrics.condition_summary(spark.read.parquet(f"{a.out}/pairs").where("severity <> 'sham'"), "family", "severity"), f"{a.out}/conditions")
    return 0


def review_freeze(spark: SparkSession, a: argparse.Namespace) -> int:
    read = spark.read.parquet
    decided = reports.reconcile(read(a.first), read(a.second), read(a.third), a.key, a.answer)
    _put(decided, f"{a.out}/decisions")
    kappa = metrics.cohen_kappa(spark.read.parquet(f"{a.out}/decisions"), "first", "second")
    _put(kappa.withColumn("passed", F.coalesce(F.col("kappa") >= a.kappa, F.lit(False))), f"{a.out}/agreement")
    return _none_left(spark.read.parquet(f"{a.out}/agreement").where("NOT passed"), None)


def condition_policy(spark: SparkSession, a: argparse.Namespace) -> int:
    found, chosen = spark.read.parquet(a.rows), spark.read.parquet(a.chosen)
    sham, keys = F.col("severity") == "sham", ["family", "severity"]
    _put(selections.keep_conditions(found, chosen, keys, sham), f"{a.out}/kept")
    _put(selections.excluded_conditions(found, chosen, keys, sham), f"{a.out}/excluded")
    return 0


def detector_fit(spark: SparkSession, a: argparse.Namespace) -> int:
    model = detectors.fit_logistic(spark.read.parquet(a.rows), a.target, a.feature, a.c, a.least)
    rows.write_document(spark, a.out, {"features": a.feature, "target": a.target, **model})
    return int("reason" in model)


def detector_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    model = json.loads("\n".join(r.value for r in spark.read.text(a.model, wholetext=True).collect()))
    scored = spark.read.parquet(a.rows).withColumn("s", detectors.score(model, model["features"])).withColumn("y", F.col(model["target"]).cast("long"))
    levels = scored.groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("cnt"))
    _put(detectors.ranked_areas(levels), a.out)
    return 0


def statistics(spark: SparkSession, a: argparse.Namespace) -> int:
    left, right = spark.read.parquet(a.left), spark.read.parquet(a.right)
    _put(inference.paired_bootstrap(left, right, a.key, a.group, a.value, a.replicates, a.seed), a.out)
    return 0


def primary_statistics(spark: SparkSession, a: argparse.Namespace) -> int:
    keys = ["model", "seed", "family", a.group]
    found = tables.effects(spark.read.parquet(a.rows), keys, "severity", a.value, "mild", "severe")
    _put(found, f"{a.out}/effects")
    found = spark.read.parquet(f"{a.out}/effects")
    _put(tables.contrasts(found, ["model", "seed", "family"], "family", a.group, replicates=a.replicates), f"{a.out}/contrasts")
    _put(tables.seed_estimates(found, ["model", "family"], "seed", "effect", a.seeds), f"{a.out}/summary")
    return 0


def report_inputs(spark: SparkSession, a: argparse.Namespace) -> int:
    _put(files.report_index(files.scan(spark, a.folder, "*")), a.out)
    return 0


def report_artifacts(spark: SparkSession, a: argparse.Namespace) -> int:
    for name in a.query or ["condition_metrics", "condition_class_metrics", "master_summary", "macro_confusion", "pareto"]:
        rows.write_csv(catalogue.QUERIES[name](spark, a.data), f"{a.out}/{name}")
    return 0


def cache_generate(spark: SparkSession, a: argparse.Namespace) -> int:
    pictures = images.decoded(files.scan(spark, a.images, "*.png"), spark.read.parquet(a.manifest)).select("path", "image")
    _put(cache.fill_pairs(spark.read.parquet(a.pairs), pictures, a.cache), a.out)
    return 0


def cache_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    return _none_left(cache.violations(spark.read.parquet(a.pairs), a.cache), a.out)


def freeze_protocol(spark: SparkSession, a: argparse.Namespace) -> int:
    found = provenance.scanned(files.scan(spark, a.folder))
    _put(provenance.freeze(found, a.name), a.out)
    return 0


def verify_protocol(spark: SparkSession, a: argparse.Namespace) -> int:
    frozen = spark.read.parquet(a.frozen)
    edges = frozen.select("parent", "child", "expected")
    if a.edges:
        edges = edges.unionByName(spark.read.parquet(a.edges))
    return _none_left(provenance.problems(provenance.scanned(files.scan(spark, a.folder)).unionByName(provenance.frozen_node(frozen)), edges), a.out)


def synthetic_smoke(spark: SparkSession, a: argparse.Namespace) -> int:
    for name in ("clean_accuracy", "headline_replay"):
        print(name, [r.asDict() for r in catalogue.QUERIES[name](spark, a.data).collect()])
    return 0


#: Command: (function, arguments); an argument ends in "?" if it may be left out, in "*" if it repeats, and may have a default after "=".
COMMANDS = {
    "queries": (queries, ""), "query": (query, "name data out"), "validate-config": (validate_config, "config contract set*"), "hardware-preflight": (preflight, "rows out hours=3.0 memory=20.0"),
    "data-manifest": (data_manifest, "folder out pattern=*"), "data-verify": (data_verify, "folder manifest out? pattern=*"), "split-create": (split_create, "rows out group label role* seed=7"),
    "split-verify": (split_verify, "rows key group label role* least=1 out?"), "pairs-create": (pairs_create, "rows key out"), "evaluate": (evaluate, "data out temperature=10.0"),
    "review-freeze": (review_freeze, "first second third key answer out kappa=0.6"), "condition-policy": (condition_policy, "rows chosen out"), "detector-fit": (detector_fit, "rows target feature* out c=1.0 least=10"),
    "detector-evaluate": (detector_evaluate, "rows model out"), "statistics": (statistics, "left right key group value out replicates=2000 seed=1"), "primary-statistics": (primary_statistics, "rows group value out replicates=2000 seeds=3"),
    "report-inputs": (report_inputs, "folder out"), "report-artifacts": (report_artifacts, "data out query*"), "synthetic-smoke": (synthetic_smoke, "data"),
    "cache-generate": (cache_generate, "pairs images manifest cache out"), "cache-validate": (cache_validate, "pairs cache out?"),
    "freeze-protocol": (freeze_protocol, "folder name out"), "verify-protocol": (verify_protocol, "folder frozen edges? out?"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        one = sub.add_parser(name)
        for spec in arguments.split():
            word, mark, default = spec.partition("=")
            value = float(default) if "." in default else int(default) if default.isdigit() else default
            if mark:
                one.add_argument(f"--{word}", default=value, type=type(value))
            elif word.endswith("*"):
                one.add_argument(f"--{word[:-1]}", action="append", default=[])
            else:
                one.add_argument(f"--{word.rstrip('?')}", required=not word.endswith("?"))
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    return COMMANDS[a.command][0](_session(), a)


if __name__ == "__main__":
    sys.exit(main())
