"""Registered queries over the shared tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions import scalars as S
from lodestone.operators import contracts, grouping, inference, metrics, pairs, reports
from lodestone.operators.ordering import quantiles
from lodestone.sources import files, synthetic
from lodestone.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CLASSES = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    rounded = F.round(c, 6)
    return rounded.alias(name) if name else rounded


# --- identifiers -----------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256('v1' || chr(0) || doc_id) AS sample_id, substr(sha256('v1' || chr(0) || doc_id), 1, 20) AS opaque_id, sha256(text) AS content FROM documents")
def sample_ids(spark, d):
    key = ids.digest("v1", F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", key.alias("sample_id"), ids.opaque(key).alias("opaque_id"), F.sha2("text", 256).alias("content"))


@query("SELECT c_custkey, (('0x' || substr(sha256('7' || chr(0) || c_custkey), 1, 16))::UBIGINT % 13)::BIGINT AS pick FROM customer")
def hash_choice_mod(spark, d):
    return table(spark, d, "customer").select("c_custkey", ids.choice(ids.digest("7", F.col("c_custkey")), 13).alias("pick"))


@query("""SELECT event_id, ('0x' || substr(sha256('flip' || chr(0) || event_id), 1, 13))::UBIGINT / 4503599627370496.0 < 0.5 AS horizontal,
 ('0x' || substr(sha256('flip' || chr(0) || event_id), 17, 13))::UBIGINT / 4503599627370496.0 < 0.25 AS vertical FROM events""")
def hash_coin_flip(spark, d):
    key = ids.digest("flip", F.col("event_id"))
    return table(spark, d, "events").select("event_id", (ids.uniform(key) < 0.5).alias("horizontal"), (ids.uniform(key, 1) < 0.25).alias("vertical"))


# --- duplicates, groups and splits -----------------------------------------------------------------------


FEW = 1000  # rows of a task that are not worth dealing out


def dealt(docs: DataFrame, key: str) -> DataFrame:
    """docs, dealt out by key where one task would read (a file has few row groups) over a quarter more than its share of the rows; only footers are read for that."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    each = docs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    rows, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return docs.repartition(max(4 * cores, rows // 8192), key) if most > FEW and 4 * most * cores > 5 * rows else docs


def content_bits(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, content, bits: SimHash of the words of the whole text (0 without words); a text is told in its row, and rows are written once."""
    bits = F.udf(grouping.word_bits, "long", useArrow=True)
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.sha2("text", 256).alias("content"), bits("text").alias("bits"))
    return materialize(docs.distinct(), "bits")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BITS = f"""SELECT doc_id, content, {" | ".join(f"(CASE WHEN 2 * sum((v >> {k}) & 1) > count(v) THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(64))} AS bits FROM (
 SELECT doc_id, content, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS v FROM (SELECT doc_id, content, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [NULL] END) AS w FROM (
 SELECT doc_id, sha256(text) AS content, list_filter(string_split(coalesce(translate(text, '{_UPPER}', '{_UPPER.lower()}'), ''), ' '), lambda x: x <> '') AS ws FROM documents))) GROUP BY doc_id, content"""
_EDGES = f"""b AS MATERIALIZED ({_BITS}), c AS MATERIALIZED (SELECT bits, min(doc_id) AS rep FROM b GROUP BY 1), e AS MATERIALIZED (
 SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, bit_count(xor(x.bits, y.bits))::INT AS distance FROM c x JOIN c y ON x.bits < y.bits AND bit_count(xor(x.bits, y.bits)) <= 4
 UNION ALL SELECT rep, doc_id, 0 FROM b JOIN c USING (bits) WHERE rep <> doc_id)"""


@query("SELECT count(*) AS n, count(DISTINCT sha256(text)) AS distinct_contents, count(*) - count(DISTINCT sha256(text)) AS surplus FROM documents")
def exact_duplicates(spark, d):
    return grouping.duplicate_counts(table(spark, d, "documents").select(F.sha2("text", 256).alias("content")), "content")


@query(f"WITH {_EDGES} SELECT a, b, distance FROM e")
def neardup_edges(spark, d):
    return grouping.hamming_edges(content_bits(spark, d), "doc_id", "bits", 4)


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT x.doc_id, y.doc_id FROM b x JOIN b y ON x.content = y.content AND x.doc_id <> y.doc_id),
 r AS (SELECT doc_id, doc_id AS root FROM b UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.doc_id), g AS (SELECT doc_id, min(root) AS group_key FROM r GROUP BY 1),
 h AS (SELECT group_key, sha256(coalesce(string_agg(content, chr(10) ORDER BY content), '')) AS group_id FROM g JOIN b USING (doc_id) GROUP BY 1) SELECT doc_id, group_key, group_id FROM g JOIN h USING (group_key)""")
def dup_components(spark, d):
    rows = content_bits(spark, d)
    return grouping.duplicate_groups(rows, "doc_id", "content", grouping.hamming_edges(rows, "doc_id", "bits", 4, forest=True))


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS sources FROM embeddings GROUP BY label")
def class_histogram(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("sources"))


ROLES = {"train": 0.6, "validation": 0.15, "calibration": 0.1, "final_test": 0.15}


@query()
def grouped_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("group_id"))
    return grouping.grouped_split(rows, "group_id", "lang", ROLES)


@query("SELECT source, count(DISTINCT lang) AS roles FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def split_violations(spark, d):
    return grouping.split_violations(table(spark, d, "documents"), "source", "lang")


# --- pairs -----------------------------------------------------------------------------------------------

_CONDITIONS = "(VALUES " + ", ".join(f"('{f}', '{s}', {i}, {v[s]}::DOUBLE)" for f, v in pairs.STRENGTH.items() for i, s in enumerate(pairs.SEVERITIES)) + ") c(family, severity, ordinal, strength)"


@query(f"SELECT vec_id, family, severity, ordinal, strength, sha256('pair' || chr(0) || vec_id || chr(0) || family || chr(0) || severity) AS pair_id FROM embeddings, {_CONDITIONS}")
def pair_factorial(spark, d):
    each = pairs.expand(table(spark, d, "embeddings").select("vec_id"))
    return each.withColumn("pair_id", ids.digest("pair", F.col("vec_id"), F.col("family"), F.col("severity")))


def _partner_sql(purpose: str, test: str) -> str:
    return f"""WITH c AS (SELECT s.vec_id AS id, o.vec_id AS partner, row_number() OVER (PARTITION BY s.vec_id ORDER BY o.label, o.vec_id) - 1 AS k, count(*) OVER (PARTITION BY s.vec_id) AS n
 FROM embeddings s JOIN embeddings o ON {test} AND s.vec_id <> o.vec_id) SELECT id, partner FROM c WHERE k = ('0x' || substr(sha256('7:{purpose}' || chr(0) || id), 1, 16))::UBIGINT % n"""


@query(_partner_sql("donor", "s.label = o.label"))
def donor_match(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return pairs.partner(rows, rows, "donor", same_class=True)


@query(_partner_sql("control", "s.label <> o.label"))
def control_match(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return pairs.partner(rows, rows, "control", same_class=False)


def _pairs_sql(t: int = 10) -> str:
    return f"""x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
 cen AS (SELECT label AS k, j, avg(v) AS c FROM x GROUP BY 1, 2), cn AS (SELECT k, sqrt(sum(c * c)) AS n FROM cen GROUP BY k),
 nx AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
 bl AS (SELECT x.vec_id, x.label, x.j, x.v, y.v AS d FROM x, nx JOIN x y ON y.vec_id = (x.vec_id + 1) % nx.n AND y.j = x.j),
 ch AS (SELECT vec_id, label, j, v, family, severity, ordinal, CASE family WHEN 'gain' THEN v * (1 + strength * ((vec_id * 31 + j * 17) % 101 / 50.5::DOUBLE - 1)) WHEN 'mix' THEN (1 - strength) * v + strength * d
   ELSE avg(v) OVER (PARTITION BY vec_id, family, severity, j // greatest(strength::INT, 1)) END AS t FROM bl, {_CONDITIONS}),
 lg AS (SELECT vec_id, label, family, severity, ordinal, cen.k, {t} * sum(v * c) / (any_value(cn.n) * sqrt(sum(v * v))) AS lp, {t} * sum(t * c) / (any_value(cn.n) * sqrt(sum(t * t))) AS lq FROM ch JOIN cen USING (j) JOIN cn USING (k) GROUP BY ALL),
 pq AS (SELECT *, exp(lp - max(lp) OVER w) / sum(exp(lp)) OVER w * exp(max(lp) OVER w) AS p, exp(lq) / sum(exp(lq)) OVER w AS q FROM lg WINDOW w AS (PARTITION BY vec_id, family, severity)),
 sim AS (SELECT vec_id, family, severity, sum(v * t) / (sqrt(sum(v * v)) * sqrt(sum(t * t))) AS cosine FROM ch GROUP BY ALL),
 pm AS (SELECT vec_id, label, family, severity, ordinal, any_value(cosine) AS cosine, 1 - any_value(cosine) AS instability, -sum(p * ln(p)) AS entropy, -sum(q * ln(q)) AS changed_entropy,
   sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 AS js, max(p) AS confidence, max(q) AS changed_confidence, max(q) - max(p) AS confidence_change, 1 - max(q) AS uncertainty,
   arg_max(k, p) = arg_max(k, q) AS consistent, arg_max(k, p) = label AS clean_correct, arg_max(k, q) = label AS changed_correct, arg_max(k, p) = label AND arg_max(k, q) <> label AS failure,
   arg_max(k, p)::INT AS predicted, arg_max(k, q)::INT AS changed_predicted, max(CASE WHEN k = label THEN p END) AS p_label, sum((p - (k = label)::INT) ** 2) AS brier FROM pq JOIN sim USING (vec_id, family, severity) GROUP BY vec_id, label, family, severity, ordinal)"""


_REAL = ["js", "entropy", "changed_entropy", "confidence", "changed_confidence", "confidence_change", "uncertainty", "cosine", "instability"]
_FLAGS = ["consistent", "clean_correct", "changed_correct", "failure"]


def _metrics(spark, d, temperature: float = 10.0) -> DataFrame:
    return metrics.pair_metrics(pairs.pairs(spark, d, temperature))


def _no_zero(c: Column) -> Column:
    return r6(c) + F.lit(0.0)


@query(f"WITH {_pairs_sql()} SELECT vec_id, label, family, severity, ordinal, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _REAL)}, {', '.join(_FLAGS)} FROM pm")
def pair_metrics(spark, d):
    return _metrics(spark, d).select("vec_id", "label", "family", "severity", "ordinal", *[_no_zero(F.col(c)).alias(c) for c in _REAL], *_FLAGS)


@query(f"WITH {_pairs_sql()} SELECT vec_id, family, severity, round(sum(p * ln(p / q)), 6) + 0.0 AS kl, bool_and(p BETWEEN 0 AND 1) AS valid FROM pq GROUP BY vec_id, family, severity")
def prob_kl(spark, d):
    rows = pairs.pairs(spark, d)
    return rows.select("vec_id", "family", "severity", _no_zero(S.kl_divergence(F.col("p"), F.col("q"))).alias("kl"), S.valid_probabilities(F.col("p")).alias("valid"))


@query(f"WITH {_pairs_sql()} SELECT vec_id, family, severity, round(entropy, 6) + 0.0 AS entropy, round(changed_entropy, 6) + 0.0 AS changed_entropy FROM pm")
def prob_entropy(spark, d):
    rows = pairs.pairs(spark, d)
    return rows.select("vec_id", "family", "severity", _no_zero(S.entropy(F.col("p"))).alias("entropy"), _no_zero(S.entropy(F.col("q"))).alias("changed_entropy"))


@query(f"WITH {_pairs_sql()} SELECT vec_id, family, severity, round(js, 6) + 0.0 AS js FROM pm")
def prob_js(spark, d):
    return pairs.pairs(spark, d).select("vec_id", "family", "severity", _no_zero(S.js_divergence(F.col("p"), F.col("q"))).alias("js"))


@query(f"WITH {_pairs_sql()} SELECT vec_id, family, severity, round(cosine, 6) + 0.0 AS cosine FROM pm")
def vec_cosine(spark, d):
    return pairs.pairs(spark, d).select("vec_id", "family", "severity", _no_zero(S.cosine(F.col("e"), F.col("t"))).alias("cosine"))


@query(f"""WITH {_pairs_sql()} SELECT family, count(*) AS n, round(avg(confidence_change), 6) + 0.0 AS mean_change, round(avg(abs(confidence_change)), 6) + 0.0 AS mean_absolute, round(quantile_cont(confidence_change, 0.5), 6) + 0.0 AS median_change,
 round(avg((confidence_change > 0)::INT) FILTER (WHERE failure), 6) + 0.0 AS failures_more_confident FROM pm GROUP BY 1""")
def confidence_summary(spark, d):
    change = F.col("confidence_change")
    rows = materialize(_metrics(spark, d).select("family", "confidence_change", "failure"), "changes")
    whole = rows.groupBy("family").agg(
        F.count("*").alias("n"), F.avg(change).alias("mean_change"), F.avg(F.abs(change)).alias("mean_absolute"),
        F.avg(F.when(F.col("failure"), (change > 0).cast("double"))).alias("failures_more_confident"),
    )
    found = whole.join(quantiles(rows, "confidence_change", {"median_change": 0.5}, "family"), "family")
    return found.select("family", "n", *[_no_zero(F.col(c)).alias(c) for c in found.columns[2:]])


@query(f"""WITH {_pairs_sql()}, s AS (SELECT vec_id, family, ordinal, 1 - cosine AS far FROM pm) SELECT a.family, count(*) AS steps, count(*) FILTER (WHERE b.far + 1e-9 >= a.far) AS nested
 FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.family = b.family AND b.ordinal = a.ordinal + 1 GROUP BY a.family""")
def severity_support(spark, d):
    far = _metrics(spark, d).select("vec_id", "family", "ordinal", "instability")
    before = F.lag("instability").over(Window.partitionBy("vec_id", "family").orderBy("ordinal"))
    return far.withColumn("before", before).where("before IS NOT NULL").groupBy("family").agg(F.count("*").alias("steps"), F.count(F.when(F.col("instability") + 1e-9 >= F.col("before"), 1)).alias("nested"))


# --- classification and calibration ----------------------------------------------------------------------


def _clean(spark, d, temperature: float = 10.0) -> DataFrame:
    rows = pairs.samples(spark, d)
    p = pairs.probabilities(F.col("e"), pairs.centroids(rows), temperature)
    return rows.select("vec_id", "label", p.alias("p")).withColumn("predicted", S.argmax(F.col("p")))


_CLEAN = f"WITH {_pairs_sql()}, cl AS (SELECT * FROM pm WHERE family = 'gain' AND severity = 'sham')"


@query(f"{_CLEAN} SELECT count(*) AS n, round(avg((predicted = label)::INT), 6) AS accuracy FROM cl")
def clean_accuracy(spark, d):
    return _clean(spark, d).agg(F.count("*").alias("n"), r6(F.avg((F.col("predicted") == F.col("label")).cast("double")), "accuracy"))


@query(f"{_CLEAN}, g AS (SELECT a.range::INT AS target, b.range::INT AS predicted FROM range({CLASSES}) a, range({CLASSES}) b) SELECT g.target, g.predicted, count(cl.vec_id) AS n FROM g LEFT JOIN cl ON cl.label = g.target AND cl.predicted = g.predicted GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_clean(spark, d), CLASSES)


@query(f"""{_CLEAN}, f AS (SELECT c.range::INT AS class, count(*) FILTER (WHERE label = c.range) AS support, count(*) FILTER (WHERE predicted = c.range) AS said, count(*) FILTER (WHERE predicted = c.range AND label = c.range) AS hit FROM cl, range({CLASSES}) c GROUP BY 1),
 g AS (SELECT class, support, coalesce(hit / nullif(said, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM f) SELECT class, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM g""")
def class_prf(spark, d):
    return metrics.classification(_clean(spark, d), CLASSES).select("class", "support", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))


@query(f"""{_CLEAN}, b AS (SELECT least(floor(confidence * 15), 14)::INT AS bin, confidence, (predicted = label)::INT AS hit FROM cl)
 SELECT r.range::INT AS bin, count(b.bin) AS n, round(avg(confidence), 6) AS confidence, round(avg(hit), 6) AS accuracy FROM range(15) r LEFT JOIN b ON b.bin = r.range GROUP BY 1""")
def ece_bins(spark, d):
    return metrics.reliability(_clean(spark, d)).select("bin", "n", r6("confidence", "confidence"), r6("accuracy", "accuracy"))


@query(f"""{_CLEAN}, b AS (SELECT least(floor(confidence * 15), 14) AS bin, count(*) AS n, avg(confidence) AS c, avg((predicted = label)::INT) AS a FROM cl GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b""")
def ece_total(spark, d):
    return metrics.calibration_error(_clean(spark, d)).select(r6("ece", "ece"))


@query(f"{_CLEAN} SELECT round(avg(brier), 6) AS brier, round(avg(-ln(p_label)), 6) AS nll FROM cl")
def brier_nll(spark, d):
    own = F.get(F.col("p"), F.col("label"))
    square = S.total(F.transform("p", lambda x, k: (x - (k == F.col("label")).cast("double")) * (x - (k == F.col("label")).cast("double"))))
    return _clean(spark, d).agg(r6(F.avg(square), "brier"), r6(F.avg(-F.ln(F.greatest(own, F.lit(S.TINY)))), "nll"))


_SUMMARY = ["mean_js", "mean_entropy", "mean_changed_entropy", "mean_confidence_change", "mean_instability", "consistency", "prevalence", "change_q25", "change_median", "change_q75", "failures_more_confident"]
_SUMMARY_SQL = """count(*) AS n, count(DISTINCT vec_id) AS sources, round(avg(js), 6) + 0.0 AS mean_js, round(avg(entropy), 6) + 0.0 AS mean_entropy, round(avg(changed_entropy), 6) + 0.0 AS mean_changed_entropy, round(avg(confidence_change), 6) + 0.0 AS mean_confidence_change,
 round(avg(instability), 6) + 0.0 AS mean_instability, round(avg(consistent::INT), 6) + 0.0 AS consistency, sum(failure::INT)::BIGINT AS failures, sum(clean_correct::INT)::BIGINT AS clean_correct, round(sum(failure::INT) / nullif(sum(clean_correct::INT), 0), 6) + 0.0 AS prevalence,
 round(quantile_cont(confidence_change, 0.25), 6) + 0.0 AS change_q25, round(quantile_cont(confidence_change, 0.5), 6) + 0.0 AS change_median, round(quantile_cont(confidence_change, 0.75), 6) + 0.0 AS change_q75, round(avg((confidence_change > 0)::INT) FILTER (WHERE failure), 6) + 0.0 AS failures_more_confident"""


def _summary(frame: DataFrame, *by: str) -> DataFrame:
    return frame.select(*by, "n", "sources", "failures", "clean_correct", *[_no_zero(F.col(c)).alias(c) for c in _SUMMARY])


@query(f"WITH {_pairs_sql()} SELECT family, severity, {_SUMMARY_SQL} FROM pm WHERE severity <> 'sham' GROUP BY 1, 2")
def condition_metrics(spark, d):
    return _summary(metrics.condition_summary(_metrics(spark, d).where("severity <> 'sham'"), "family", "severity"), "family", "severity")


@query(f"WITH {_pairs_sql()} SELECT family, severity, label, {_SUMMARY_SQL} FROM pm WHERE severity <> 'sham' GROUP BY 1, 2, 3")
def condition_class_metrics(spark, d):
    return _summary(metrics.condition_summary(_metrics(spark, d).where("severity <> 'sham'"), "family", "severity", "label"), "family", "severity", "label")


@query(f"WITH {_pairs_sql()} SELECT family, severity, count(*) AS n, sum(failure::INT)::BIGINT AS failures FROM pm GROUP BY CUBE (family, severity)")
def condition_cube(spark, d):
    return _metrics(spark, d).cube("family", "severity").agg(F.count("*").alias("n"), F.sum(F.col("failure").cast("long")).alias("failures"))


@query(f"""WITH {_pairs_sql()} SELECT 'temperature 10' AS model, count(DISTINCT vec_id) AS n, round(avg(clean_correct::INT), 6) AS clean_accuracy, round(avg(changed_correct::INT) FILTER (WHERE family = 'resolution' AND severity = 'severe'), 6) AS severe_accuracy FROM pm""")
def headline_replay(spark, d):
    hard = (F.col("family") == "resolution") & (F.col("severity") == "severe")
    rows = _metrics(spark, d)
    return rows.agg(F.lit("temperature 10").alias("model"), F.count_distinct("vec_id").alias("n"), r6(F.avg(F.col("clean_correct").cast("double")), "clean_accuracy"), r6(F.avg(F.when(hard, F.col("changed_correct").cast("double"))), "severe_accuracy"))


@query(f"WITH {_pairs_sql()} SELECT family, severity, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS true_cluster, CASE WHEN changed_predicted < 5 THEN 'low' ELSE 'high' END AS predicted_cluster, count(*) AS n FROM pm WHERE failure GROUP BY ALL")
def macro_confusion(spark, d):
    cluster = lambda c: F.when(c < 5, "low").otherwise("high")
    rows = pairs.pairs(spark, d).withColumn("predicted", S.argmax(F.col("q"))).where((S.argmax(F.col("p")) == F.col("label")) & (F.col("predicted") != F.col("label")))
    return rows.groupBy("family", "severity", cluster(F.col("label")).alias("true_cluster"), cluster(F.col("predicted")).alias("predicted_cluster")).agg(F.count("*").alias("n"))


@query(f"""WITH {_pairs_sql()}, m AS (SELECT family || ':' || severity AS condition, avg(consistent::INT) AS stability FROM pm WHERE severity <> 'sham' GROUP BY 1) SELECT round(avg(stability), 6) AS mean_stability, round(min(stability), 6) AS worst_stability, (SELECT condition FROM m ORDER BY stability, condition LIMIT 1) AS worst_condition FROM m""")
def master_summary(spark, d):
    each = _metrics(spark, d).where("severity <> 'sham'").groupBy(F.concat_ws(":", "family", "severity").alias("condition")).agg(F.avg(F.col("consistent").cast("double")).alias("stability"))
    return each.agg(r6(F.avg("stability"), "mean_stability"), r6(F.min("stability"), "worst_stability"), F.min_by("condition", F.struct("stability", "condition")).alias("worst_condition"))


@query(f"""WITH {_pairs_sql()}, w AS (SELECT vec_id, family, max(js) FILTER (WHERE severity = 'mild') AS mild, max(js) FILTER (WHERE severity = 'severe') AS severe FROM pm GROUP BY 1, 2) SELECT vec_id, family, round(severe - mild, 6) + 0.0 AS effect FROM w""")
def severity_diff(spark, d):
    found = contracts.two_sided(_metrics(spark, d), "severity", "mild", "severe", "js", "vec_id", "family", same=("label",))
    return found.select("vec_id", "family", _no_zero(F.col("effect")).alias("effect"))


def _effects(spark, d, temperature: float) -> DataFrame:
    return contracts.two_sided(_metrics(spark, d, temperature), "severity", "mild", "severe", "js", "vec_id", "family", same=("label",))


_EFFECT = "SELECT vec_id, label, family, max(js) FILTER (WHERE severity = 'severe') - max(js) FILTER (WHERE severity = 'mild') AS effect FROM pm GROUP BY 1, 2, 3"


@query(f"WITH a AS (WITH {_pairs_sql(10)} {_EFFECT}), b AS (WITH {_pairs_sql(5)} {_EFFECT}), g AS (SELECT family, label, avg(a.effect - b.effect) AS e FROM a JOIN b USING (vec_id, label, family) GROUP BY 1, 2) SELECT family, count(*) AS groups, round(avg(e), 6) + 0.0 AS effect FROM g GROUP BY 1")
def cross_model_did(spark, d):
    met = contracts.matched(_effects(spark, d, 10.0), _effects(spark, d, 5.0).withColumnRenamed("effect", "other"), "vec_id", "family", same=("label",))
    groups = met.groupBy("family", "label").agg(F.avg(F.col("effect") - F.col("other")).alias("e"))
    return groups.groupBy("family").agg(F.count("*").alias("groups"), _no_zero(F.avg("e")).alias("effect"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS j FROM embeddings),
 c AS (SELECT a.j AS i, b.j AS j, covar_pop(a.v, b.v) AS c FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2)
 SELECT (SELECT count(*) FROM embeddings) AS n, round(sum(c * c) FILTER (WHERE i <= 32 AND j > 32) / sqrt(sum(c * c) FILTER (WHERE i <= 32 AND j <= 32) * sum(c * c) FILTER (WHERE i > 32 AND j > 32)), 6) AS cka FROM c""")
def linear_cka(spark, d):
    rows = pairs.samples(spark, d).select(F.slice("e", 1, 32).alias("x"), F.slice("e", 33, 32).alias("y"))
    return metrics.linear_cka(rows, "x", "y").select("n", r6("cka", "cka"))


# --- ranking ---------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'N'), k AS (SELECT count(*) AS n FROM c), u AS (SELECT v, count(*) AS m FROM c GROUP BY v), s AS (SELECT v, sum(m) OVER (ORDER BY v) AS upto FROM u)
 SELECT l_orderkey, l_linenumber, round(coalesce(upto, 0) / k.n, 9) AS percentile FROM (SELECT * FROM lineitem WHERE l_returnflag <> 'N') q ASOF LEFT JOIN s ON q.l_extendedprice >= s.v, k""")
def control_ecdf(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_returnflag") == "N").alias("control"))
    return metrics.control_ecdf(rows, "l_extendedprice", "control").select("l_orderkey", "l_linenumber", F.round("percentile", 9).alias("percentile"))


_RANKED = "SELECT d.lang, (l.quality = 0)::INT AS y, d.n_chars % 97 AS s FROM labels l JOIN documents d USING (doc_id)"


@query(f"""WITH r AS ({_RANKED}), t AS (SELECT lang, s, sum(y) AS pos, count(*) AS cnt FROM r GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(cnt) OVER w AS k FROM t WINDOW w AS (PARTITION BY lang ORDER BY s DESC)),
 g AS (SELECT lang, sum(cnt)::BIGINT AS n, sum(pos)::BIGINT AS positives, sum(pos * tp / k) AS a FROM c GROUP BY 1),
 u AS (SELECT x.lang, avg(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END) AS auroc FROM r x JOIN r z ON x.lang = z.lang AND x.y = 1 AND z.y = 0 GROUP BY 1)
 SELECT lang, n, positives, positives > 0 AND positives < n AS defined, positives < 20 AS underpowered, round(CASE WHEN positives > 0 AND positives < n THEN a / positives END, 6) AS average_precision, round(auroc, 6) AS auroc FROM g LEFT JOIN u USING (lang)""")
def average_precision(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("quality") == 0).cast("int").alias("y"), (F.col("n_chars") % 97).alias("s"))
    return metrics.ranking(rows, "y", "s", "lang").select("lang", "n", "positives", "defined", "underpowered", r6("average_precision", "average_precision"), r6("auroc", "auroc"))


@query(f"""WITH r AS ({_RANKED}), g AS (SELECT lang, count(*) AS n, sum(y)::BIGINT AS positives FROM r GROUP BY 1)
 SELECT lang, n, positives, CASE WHEN positives = 0 OR positives = n THEN 'single target class' WHEN positives < 20 THEN 'underpowered' ELSE 'defined' END AS gate FROM g""")
def detection_gate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("quality") == 0).cast("int").alias("y"), (F.col("n_chars") % 97).alias("s"))
    gate = F.when(~F.col("defined"), "single target class").when(F.col("underpowered"), "underpowered").otherwise("defined")
    return metrics.ranking(rows, "y", "s", "lang").select("lang", "n", "positives", gate.alias("gate"))


@query(f"""WITH d AS (SELECT d.source, (l.quality = 0)::INT AS y, d.n_chars % 97 AS s FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS number FROM d GROUP BY 1), k AS (SELECT count(*) AS m FROM g),
 w AS (SELECT r.range AS replicate, (('0x' || substr(sha256('1' || chr(0) || r.range || chr(0) || i.range), 1, 16))::UBIGINT % k.m)::BIGINT AS number, count(*) AS weight FROM range(2000) r, k, range(k.m) i GROUP BY 1, 2 UNION ALL SELECT -1, number, 1 FROM g),
 x AS (SELECT replicate, s, sum(weight * y) AS pos, sum(weight) AS cnt FROM d JOIN g USING (source) JOIN w USING (number) GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER o AS tp, sum(cnt) OVER o AS n FROM x WINDOW o AS (PARTITION BY replicate ORDER BY s DESC)),
 a AS (SELECT replicate, sum(pos * tp / n) / sum(pos) AS ap FROM c GROUP BY 1 HAVING sum(pos) > 0 AND sum(pos) < sum(cnt)),
 z AS (SELECT max(ap) FILTER (WHERE replicate < 0) AS e, quantile_cont(ap, 0.025) FILTER (WHERE replicate >= 0) AS lo, quantile_cont(ap, 0.975) FILTER (WHERE replicate >= 0) AS hi, count(*) FILTER (WHERE replicate >= 0) AS replicates FROM a)
 SELECT CASE WHEN replicates >= 1000 THEN round(e, 6) END AS estimate, CASE WHEN replicates >= 1000 THEN round(lo, 6) END AS lower, CASE WHEN replicates >= 1000 THEN round(hi, 6) END AS upper, replicates, replicates >= 1000 AS defined FROM z""")
def clustered_ap_ci(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").select("source", (F.col("quality") == 0).cast("int").alias("y"), (F.col("n_chars") % 97).alias("s"))
    return inference.clustered_ap(rows, "source", "y", "s").select(*[r6(c, c) for c in ("estimate", "lower", "upper")], "replicates", "defined")


@query("""WITH r AS (SELECT l_returnflag, rank() OVER a + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x, rank() OVER b + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem
 WINDOW a AS (PARTITION BY l_returnflag ORDER BY l_quantity), b AS (PARTITION BY l_returnflag ORDER BY l_discount)) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) + 0.0 AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    ranked = metrics.midranks(metrics.midranks(rows, "l_quantity", "x", "l_returnflag"), "l_discount", "y", "l_returnflag")
    return ranked.groupBy("l_returnflag").agg(F.count("*").alias("n"), _no_zero(F.corr("x", "y")).alias("rho"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-least(greatest(-1.5 + 0.8 * (l_quantity - 25) / 14 + 2.0 * (l_discount - 0.05) / 0.03, -40), 40))), 6) AS score FROM lineitem")
def logit_score(spark, d):
    z = -1.5 + 0.8 * (F.col("l_quantity") - 25) / 14 + 2.0 * (F.col("l_discount") - 0.05) / 0.03
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.sigmoid(z), "score"))


# --- paired tables, resampling, tests --------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice AS a, coalesce(p, 0) AS b FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def paired_full_match(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("p"))
    right = orders.join(sums, "o_orderkey", "left").select("o_orderkey", F.coalesce("p", F.lit(0.0)).alias("o_totalprice"))
    return inference.paired(orders, right, "o_orderkey", "o_totalprice")


@query("SELECT p_type FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part)")
def family_division(spark, d):
    rows = table(spark, d, "part")
    return reports.division(rows, "p_type", "p_brand", rows.select("p_brand").distinct().count())


_DRAWS = """g AS (SELECT l_suppkey, sum(l_extendedprice) AS s, count(*) AS n, row_number() OVER (ORDER BY l_suppkey) - 1 AS number FROM lineitem GROUP BY 1), k AS (SELECT count(*) AS m FROM g),
 w AS (SELECT r.range AS replicate, (('0x' || substr(sha256('1' || chr(0) || r.range || chr(0) || i.range), 1, 16))::UBIGINT % k.m)::BIGINT AS number, count(*) AS weight FROM range(2000) r, k, range(k.m) i GROUP BY 1, 2)"""


@query(f"WITH {_DRAWS} SELECT replicate::INT AS replicate, number, weight FROM w")
def bootstrap_weights(spark, d):
    return inference.draws(table(spark, d, "lineitem").select("l_suppkey").distinct(), 2000, 1)


@query(f"""WITH {_DRAWS}, m AS (SELECT replicate, sum(weight * s) / sum(weight * n) AS m FROM w JOIN g USING (number) GROUP BY 1)
 SELECT (SELECT round(sum(s) / sum(n), 4) FROM g) AS estimate, round(quantile_cont(m, 0.025), 4) AS lower, round(quantile_cont(m, 0.975), 4) AS upper, (SELECT count(*) FROM g) AS groups FROM m""")
def cluster_bootstrap_ci(spark, d):
    found = inference.cluster_bootstrap(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")
    return found.select(*[F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")], "groups")


@query("""WITH g AS (SELECT l_returnflag AS seed, l_suppkey, sum(l_extendedprice) AS s, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) - 1 AS number FROM lineitem GROUP BY 1, 2),
 e AS (SELECT seed, count(*) AS m, sum(s) / sum(n) AS mean, row_number() OVER (ORDER BY seed) - 1 AS pick FROM g GROUP BY 1), k AS (SELECT count(*) AS c FROM e),
 p AS (SELECT r.range AS replicate, t.range AS slot, (('0x' || substr(sha256('1' || chr(0) || 'seed' || chr(0) || r.range || chr(0) || t.range), 1, 16))::UBIGINT % k.c)::BIGINT AS pick FROM range(2000) r, k, range(k.c) t),
 w AS (SELECT replicate, slot, seed, (('0x' || substr(sha256('1' || chr(0) || replicate || chr(0) || slot || chr(0) || i.range), 1, 16))::UBIGINT % m)::BIGINT AS number, count(*) AS w FROM (SELECT * FROM p JOIN e USING (pick)) q, range(q.m) i GROUP BY 1, 2, 3, 4),
 a AS (SELECT replicate, slot, sum(w * s) / sum(w * n) AS m FROM w JOIN g USING (seed, number) GROUP BY 1, 2), b AS (SELECT replicate, avg(m) AS m FROM a GROUP BY 1)
 SELECT (SELECT round(avg(mean), 4) FROM e) AS estimate, round(quantile_cont(m, 0.025), 4) AS lower, round(quantile_cont(m, 0.975), 4) AS upper FROM b""")
def two_level_ci(spark, d):
    found = inference.two_level_bootstrap(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice")
    return found.select(*[F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")])


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS d FROM orders GROUP BY 1, 2), g AS (SELECT o_orderpriority, round(d, 2) AS d FROM f WHERE d IS NOT NULL AND round(d, 2) <> 0),
 r AS (SELECT o_orderpriority, d, rank() OVER (PARTITION BY o_orderpriority ORDER BY abs(d)) + (count(*) OVER (PARTITION BY o_orderpriority, abs(d)) - 1) / 2 AS k FROM g),
 s AS (SELECT o_orderpriority, count(*) AS n, coalesce(sum(k) FILTER (WHERE d > 0), 0) AS up, coalesce(sum(k) FILTER (WHERE d < 0), 0) AS down FROM r GROUP BY 1)
 SELECT o_orderpriority, n, least(up, down) AS statistic, round((up - down) / (n * (n + 1) / 2), 6) AS rank_biserial FROM s""")
def wilcoxon_stat(spark, d):
    at = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    cents = F.round((at("F") - at("O")) * 100) / 100  # as the SQL's round: F.round(x, 2) goes by the decimal text and takes 1.005 up
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(cents.alias("d")).where("d IS NOT NULL")
    return inference.wilcoxon(rows, "d", "o_orderpriority").select("o_orderpriority", "n", "statistic", r6("rank_biserial", "rank_biserial"))


_P = "SELECT n_regionkey AS family, n_nationkey AS test, CASE WHEN n_nationkey % 7 <> 0 THEN ((n_nationkey * 37 + 11) % 100) / 1000.0::DOUBLE END AS p FROM nation"


def _tests(spark, d) -> DataFrame:
    p = ((F.col("n_nationkey") * 37 + 11) % 100) / 1000.0
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), F.when(F.col("n_nationkey") % 7 != 0, p).alias("p"))


@query(f"""WITH t AS ({_P}), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM t WHERE p IS NOT NULL),
 h AS (SELECT family, test, p, least(1, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY r)) AS v FROM k) SELECT t.family, t.test, t.p, round(v, 6) AS holm_p, v <= 0.05 AS holm_rejected FROM t LEFT JOIN h USING (family, test)""")
def holm(spark, d):
    return inference.holm(_tests(spark, d), "p", "family").select("family", "test", "p", r6("holm_p", "holm_p"), "holm_rejected")


@query(f"""WITH t AS ({_P}), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM t WHERE p IS NOT NULL),
 h AS (SELECT family, test, least(1, min(p * m / r) OVER (ORDER BY r DESC)) AS v FROM k) SELECT t.family, t.test, t.p, round(v, 6) AS bh_p, v <= 0.05 AS bh_rejected FROM t LEFT JOIN h USING (family, test)""")
def benjamini_hochberg(spark, d):
    return inference.benjamini_hochberg(_tests(spark, d), "p").select("family", "test", "p", r6("bh_p", "bh_p"), "bh_rejected")


@query("""WITH e AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_orderstatus, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, count(v) AS n_seeds, count(v) = 5 AS defined FROM e GROUP BY 1""")
def seed_summary(spark, d):
    found = reports.seed_summary(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", 5)
    return found.select("o_orderstatus", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n_seeds", "defined")


# --- review ----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7' || chr(0) || c_custkey)) <= 5")
def hash_stratified_sample(spark, d):
    return reports.ranked_sample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ids.digest("7", F.col("c_custkey")), 5)


_RATED = "SELECT doc_id, quality = 1 AS first, (quality = 1) <> (('0x' || substr(sha256('rate' || chr(0) || doc_id), 1, 16))::UBIGINT % 10 = 0) AS second FROM labels"


def _rated(spark, d) -> DataFrame:
    flip = ids.choice(ids.digest("rate", F.col("doc_id")), 10) == 0
    first = F.col("quality") == 1
    return table(spark, d, "labels").select("doc_id", first.alias("first"), (first != flip).alias("second"))


@query(f"WITH r AS ({_RATED}) SELECT r.doc_id, first, second, CASE WHEN first = second THEN first ELSE toxic = 0 END AS decision FROM r JOIN labels USING (doc_id)")
def review_reconcile(spark, d):
    rated = _rated(spark, d)
    judged = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 0).alias("said"))
    return reports.reconcile(rated.select("doc_id", F.col("first").alias("said")), rated.select("doc_id", F.col("second").alias("said")), judged, "doc_id", "said")


@query(f"WITH s AS (SELECT count(*) AS n, avg((first = second)::INT) AS a, avg(first::INT) AS x, avg(second::INT) AS y FROM ({_RATED})) SELECT n, round(a, 6) AS agreement, round((a - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM s")
def cohen_kappa(spark, d):
    return metrics.cohen_kappa(_rated(spark, d), "first", "second").select("n", r6("agreement", "agreement"), r6("kappa", "kappa"))


@query("""WITH k AS (SELECT d.lang, d.source, count(*) AS n, sum(quality) AS k FROM labels JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.lang, d.source)), p AS (SELECT *, k / n AS p FROM k)
 SELECT lang, source, n, round(p, 6) AS rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) + 0.0 AS lower, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS upper FROM p""")
def acceptance_wilson(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return reports.acceptance(rows, "quality", 1.96, "lang", "source").select("lang", "source", "n", r6("rate", "rate"), _no_zero(F.col("lower")).alias("lower"), r6("upper", "upper"))


# --- selections and logs ---------------------------------------------------------------------------------


@query("""WITH u AS (SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1) SELECT * FROM u ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 4""")
def topk_unique(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return reports.top_unique(rows, "l_partkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 4)


@query("""WITH s AS (SELECT s_suppkey, s_acctbal, round(sum(l_extendedprice), 2) AS revenue FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
 SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.s_acctbal >= a.s_acctbal AND b.revenue >= a.revenue AND (b.s_acctbal > a.s_acctbal OR b.revenue > a.revenue))""")
def pareto(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").join(sums, "s_suppkey")
    return reports.pareto(rows, "s_acctbal", "revenue").select("s_suppkey", "s_acctbal", "revenue")


@query("""WITH t AS (SELECT user_id, ts::DATE AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2), v AS (SELECT user_id, ts::DATE AS epoch, max(value) AS best FROM events WHERE event_type = 'error' GROUP BY 1, 2)
 SELECT user_id, epoch::VARCHAR AS epoch, round(loss, 6) AS loss, best FROM t JOIN v USING (user_id, epoch)""")
def learning_curve(spark, d):
    rows = table(spark, d, "events").withColumn("epoch", F.to_date("ts").cast("string"))
    train = rows.groupBy("user_id", "epoch").agg(r6(F.avg("value"), "loss"))
    return reports.learning_curve(train, rows.where("event_type = 'error'").groupBy("user_id", "epoch").agg(F.max("value").alias("best")), ["user_id", "epoch"], "loss", "best")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
 s AS (SELECT user_id, k, value AS best, event_id AS best_step, 0 AS bad, NULL::BIGINT AS stopped_at FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN e.value > s.best + 0.5 THEN e.value ELSE s.best END, CASE WHEN e.value > s.best + 0.5 THEN e.event_id ELSE s.best_step END,
   CASE WHEN e.value > s.best + 0.5 THEN 0 ELSE s.bad + 1 END, CASE WHEN e.value <= s.best + 0.5 AND s.bad + 1 >= 5 THEN e.event_id END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1 WHERE s.stopped_at IS NULL)
 SELECT user_id, best, best_step, coalesce(stopped_at, -1) AS stopped_at FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def early_stop(spark, d):
    return reports.early_stop(table(spark, d, "events"), "user_id", "event_id", "value", 0.5, 5).withColumn("stopped_at", F.coalesce("stopped_at", F.lit(-1)))


@query("""WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 100 <> 7), e AS (SELECT doc_id AS path, CASE WHEN doc_id % 100 = 3 THEN sha256('changed') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 100 <> 5)
 SELECT coalesce(a.path, e.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unlisted' ELSE 'digest' END AS problem FROM a FULL JOIN e ON a.path = e.path WHERE a.path IS NULL OR e.path IS NULL OR a.h <> e.h""")
def manifest_verify(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    told = rows.withColumn("sha256", F.when(F.col("path") % 100 == 3, F.sha2(F.lit("changed"), 256)).otherwise(F.col("sha256")))
    return files.manifest_violations(told.where("path % 100 <> 5"), rows.where("path % 100 <> 7"))


@query("""WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id) AS upto FROM documents) SELECT doc_id, bytes, ((upto - bytes) // 1000000)::BIGINT AS part FROM r""")
def evidence_parts(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return files.parts(rows, 1_000_000).select(F.col("path").alias("doc_id"), "bytes", "part")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer)
 SELECT c_custkey, c_mktsegment, CASE WHEN k = 1 THEN 'reject' ELSE 'accept' END AS first, CASE WHEN k = 1 THEN 'reject' ELSE 'accept' END AS second, 'accept' AS final FROM r""")
def review_fill(spark, d):
    return synthetic.filled_reviews(table(spark, d, "customer"), "c_custkey", "c_mktsegment", "c_nationkey").select("c_custkey", "c_mktsegment", "first", "second", "final")


@query("SELECT event_type, median(value) AS median_value, round(median(value) * 253 * 50 / 3600, 6) AS hours FROM events WHERE event_id > 5 GROUP BY 1")
def step_time_median(spark, d):
    found = quantiles(table(spark, d, "events").where("event_id > 5"), "value", {"median_value": 0.5}, "event_type")
    return found.select("event_type", "median_value", r6(F.col("median_value") * 253 * 50 / 3600, "hours"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('3' || chr(0) || o_orderkey)) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, k // 64 AS batch, (k % 64 // 32)::BIGINT AS shard FROM r WHERE k < n // 64 * 64""")
def shard_assign(spark, d):
    """Places in a hashed order from counts of its 4,096 ranges, so no task sorts all rows."""
    rows = table(spark, d, "orders").select("o_orderkey", ids.digest("3", F.col("o_orderkey")).alias("h")).withColumn("range", F.substring("h", 1, 3))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("h")) - 1
    placed = rows.join(F.broadcast(before), "range").withColumn("k", k).where("k < all DIV 64 * 64")
    return placed.select("o_orderkey", F.expr("k DIV 64").alias("batch"), F.expr("k % 64 DIV 32").alias("shard"))
