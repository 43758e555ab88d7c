"""Language identification (operator 9): family first, then one-versus-one linear SVMs within it.

A text is a vector of hashed letter pairs and triples (square roots of counts,
unit length) of the whole text. A linear SVM for each family against the rest
picks the family; within it each pair of languages has an SVM of its own, and
most votes win (then the larger sum of margins, then the name).

Fitted on at most PER_LANG documents of each language, fewer where there are more
than SAMPLE / PER_LANG languages (all languages are learned), those with the
smallest hash of doc_id and text among rows with a language that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

DIM = 4096  # hashed n-grams
PER_LANG = 400  # bound of the sample for each language
SAMPLE = 8000  # documents of all languages together; two of each at least
CHUNK = 1 << 20  # bytes whose n-grams are counted at once

# Families of language codes; a code that is missing is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _letters() -> np.ndarray:
    """Bytes of lower-cased text as they are, but one value for all ASCII that is no letter."""
    table = np.arange(256, dtype=np.uint32)
    table[[c for c in range(128) if not chr(c).isalpha()]] = 32
    return table


_TABLE = _letters()


def vector(text: str) -> np.ndarray:
    """Unit vector of hashed letter pairs and triples."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    counts = np.zeros(DIM)
    for i in range(0, len(data) - 2, CHUNK):
        b = _TABLE[data[i : i + CHUNK + 2]]
        pairs = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA6B)
        triples = (pairs[:-1] * np.uint32(5) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        counts += np.bincount(triples >> np.uint32(20), minlength=DIM)
        counts += np.bincount(pairs * np.uint32(0x165667B1) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(counts)
    return out / max(np.linalg.norm(out), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM (squared hinge, classes of equal weight), by accelerated gradients."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    w = at = np.zeros(x.shape[1], x.dtype)
    c, step = x.dtype.type(c), x.dtype.type(1 / (1 + 2 * c * 2 * 0.5))
    for k in range(rounds):
        slack = np.maximum(x.dtype.type(0), 1 - y * (x @ at))
        new = at - step * (at - 2 * c * (x.T @ (weight * y * slack)))
        at, w = new + x.dtype.type(k / (k + 3)) * (new - w), new
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The family classifiers and the pairs within families."""
    langs_seen = sorted(set(langs))
    families: dict[str, list[str]] = {}
    for lang in langs_seen:
        families.setdefault(FAMILY_OF.get(lang, f"only {lang}"), []).append(lang)
    own = np.array([FAMILY_OF.get(lang, f"only {lang}") for lang in langs])
    tags = np.array(langs)
    model = {"families": families, "family": [], "pairs": {}}
    for name in families:
        model["family"].append(fit_svm(x, np.where(own == name, 1.0, -1.0)) if len(families) > 1 else np.zeros(DIM + 1))
        for a, b in combinations(families[name], 2):
            hit = (tags == a) | (tags == b)
            model["pairs"][a, b] = fit_svm(x[hit], np.where(tags[hit] == a, 1.0, -1.0))
    return model


def predict(model: dict, text: str | None) -> tuple[str, float]:
    if not has_letter(text) or not model["families"]:
        return "und", 0.0
    x = np.append(vector(text), 1.0)
    margins = np.array([w @ x for w in model["family"]])
    best = int(margins.argmax())
    langs = list(model["families"].values())[best]
    sure = 1.0 if len(margins) == 1 else 1 / (1 + np.exp(-2 * (margins[best] - np.delete(margins, best).max())))
    votes = {lang: [0, 0.0] for lang in langs}
    for a, b in combinations(langs, 2):
        m = model["pairs"][a, b] @ x
        votes[a if m > 0 else b][0] += 1
        votes[a][1] += m
        votes[b][1] -= m
    first = min(langs, key=lambda k: (-votes[k][0], -votes[k][1], k))
    if len(langs) > 1:
        sure *= 1 / (1 + np.exp(-2 * votes[first][1] / (len(langs) - 1)))
    return first, float(min(max(sure, 0.0), 1.0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = PER_LANG, most: int = SAMPLE) -> DataFrame:
    """lang, text of the documents to learn from.

    A first cut by a bound on the hash, from the number (about) of each language's different rows,
    leaves about twice as many as are wanted, so what is ranked within a language
    is small however many rows it has.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "langs")
    want = max(2, min(per_lang, most // max(counts.count(), 1)))
    share = F.least(F.lit(1.0), F.lit(2.0 * want + 50) / F.col("n"))
    near = rows.join(counts, "lang").where(F.shiftrightunsigned("h", 11) < share * float(1 << 53))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= want).select("lang", "text")


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """Model from the bounded sample; without labelled rows a model that knows no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    found = sample(docs, per_lang).mapInArrow(run, "lang string, x binary").collect()
    if not found:
        return {"families": {}, "family": [], "pairs": {}}
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    return fit(np.stack([np.frombuffer(r[1], np.float32) for r in found]), [r[0] for r in found])


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text, or one without a letter, is "und" with score 0, as is every text
    if no row is labelled. Only the text decides; equal texts get equal results,
    repeated rows repeat, and a null doc_id is not held out. An empty table gives
    an empty result.
    """
    model = train(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, that get a language; "und" and scores below least_score go.

    A table without labelled rows teaches no language: then every text with a letter
    stays. Null and empty texts go, repeated rows are treated alike, texts are read
    whole, columns of any name stay, and an empty table stays empty.
    """
    model = train(docs)

    def known_text(text: str | None) -> bool:
        if not model["families"]:
            return has_letter(text)
        lang, score = predict(model, text)
        return lang != "und" and score >= least_score

    @F.pandas_udf("boolean")
    def known(text):
        import pandas as pd

        return pd.Series([known_text(t) for t in text], dtype=bool)

    return docs.where(known("text"))
