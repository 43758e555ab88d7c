"""Licence scans (operator 3): a trained paragraph classifier, without user functions.

A paragraph is the lines up to a blank one. It is cut into sentences, and a sentence of more
than WIDTH words into windows of so many words that overlap by half, so words
around a statement cannot drown it, and a statement that breaks over lines stays whole.
Windows that pass a gate, which is made of the templates' own words and word pairs and of
general anchor words, are described by the hashed words and word pairs they
hold; a multinomial logistic regression with sparse weights gives a licence
family, another licence, or none. Its probabilities are calibrated by a
temperature, and the threshold below which the answer is "unknown" is chosen on
licences that it has not seen (STRANGE): at most LET_THROUGH of their variants
get a family. A prediction counts as confirmed if enough of the window's or the
template's word pairs are shared with a template of that family. A sentence has
the family of its best window, a paragraph those of its sentences; it is
"unknown" only if none of them has one.

Fitted on the driver on variants of the templates below, set into words of the
corpus, and on at most NEGATIVES windows of the corpus without an anchor word or
licence name (smallest hash first) of about NEGATIVE_DOCS documents.
"""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.native import let

DIM = 2048
NEGATIVES, NEGATIVE_DOCS = 400, 20_000  # bounds of what the classifier takes from the corpus
LET_THROUGH = 0.05  # share of variants of unseen licences that may get a family
VARIANTS = 30  # of each template
CONFIRMED = 0.5  # share of word pairs
WIDTH, STEP = 12, 4  # words of a window, and from one to the next
PADDING = (0, 0, 2, 5, 7)  # words of the corpus that a variant has on either side
SPACE, ENDS = r"[\x20\x09-\x0D]+", r"(?<=[.!?;:])[\x20\x09-\x0D]+"  # between words, between sentences

# Short statements that name a licence, by family.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www.apache.org licenses license-2.0"],
    "mit": ["released under the mit license", "licensed under the mit license see the license file", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "licensed under gpl v2 or later"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "distributed under the terms of the gnu lgpl", "licensed under lgpl v2.1 or later", "released under the gnu lgpl", "this library is covered by the lgpl"],
    "agpl": ["licensed under the gnu affero general public license version 3", "distributed under the terms of the gnu agpl", "licensed under agpl v3 or later", "released under the gnu agpl", "this program is covered by the agpl"],
    "bsd": ["licensed under the bsd 3 clause license", "licensed under the bsd 3-clause license", "released under the bsd license", "distributed under the bsd 2-clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution 4.0 international"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike 4.0 international"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial 4.0 international"],
    "public-domain": ["this is free and unencumbered software released into the public domain", "dedicated to the public domain under cc0 1.0 universal"],
    "proprietary": ["copyright all rights reserved no part may be reproduced without permission", "all rights reserved unauthorized copying is strictly prohibited"],
}
for _family, _names in {"apache": ["apache-2.0"], "mit": ["mit"], "gpl": ["gpl-2.0-or-later", "gpl-3.0-only"], "lgpl": ["lgpl-2.1-only"], "agpl": ["agpl-3.0-only"], "bsd": ["bsd-3-clause", "bsd-2-clause"], "mpl": ["mpl-2.0"], "cc-by": ["cc-by-4.0"], "cc-by-sa": ["cc-by-sa-4.0"], "cc-by-nc": ["cc-by-nc-4.0"]}.items():
    TEMPLATES[_family] = TEMPLATES[_family] + [f"spdx-license-identifier {n}" for n in _names]
# Licences of no family above, to learn what another licence is.
ANOTHER = [
    "licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx-license-identifier isc", "distributed under the boost software license version 1.0",
    "the boost software license applies to this library", "spdx-license-identifier bsl-1.0", "licensed under the eclipse public license version 2.0", "spdx-license-identifier epl-2.0", "subject to the terms of the common development and distribution license",
    "this font software is licensed under the sil open font license version 1.1", "licensed under the microsoft public license", "licensed under the wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "licensed under the terms of the vendor license agreement",
]
# Licences that only calibrate.
STRANGE = ["released under the artistic license 2.0", "licensed under the european union public licence version 1.2", "this library is under the zlib license", "spdx-license-identifier zlib", "licensed under the open data commons license", "licensed under the acme community license version 7", "use is subject to the example research license"]
ANCHORS = r"(?i)licen[sc]|copyright|all rights reserved|public domain|redistribut|\bgpl|\bcc[ -]?(?:by|0)|spdx|permission is hereby|free software|compliance with"
# Lines with an anchor word that grant nothing.
OTHERS = ["a driving licence is required for this job", "the poet took license with the facts", "software licensing costs rose last year", "the copyright office opened again on monday", "he worked in the public domain of politics", "taxes redistribute income", "in compliance with the rules of the court", "license to operate a taxi"]
OTHERS += ["she read the terms and went home to her family", "under the terms of the treaty the army left", "the version on the shelf is old", "students at mit built a robot", "the apache helicopter landed", "a herd of gnu crossed the river", "mozilla released a new browser", "the creative commons of the town", "the terms of the contract were kept", "the file is in the folder", "bsd is an operating system", "the form must be signed with the following conditions"]
PART = r"[^\p{L}\p{N}.-]+"
# Words that name a licence by themselves, and words that say nothing of one (a pair of two such is no sign).
NAMES = ["gnu", "gpl", "lgpl", "agpl", "mit", "apache", "bsd", "mozilla", "mpl", "creative commons", "cc0", "unlicense", "sharealike", "noncommercial", "unencumbered"]
PLAIN = set("a any as at be by can file following for free from in into is it may no not obtain of or part person program see source that the this to under use with without work you and are".split())


def gate() -> str:
    """Pattern that finds a line with an anchor word, a licence name, or a word pair of a template with a telling word in it."""
    pairs: dict[str, set[str]] = {}
    for text in (t for texts in TEMPLATES.values() for t in texts):
        w = text.split()
        for a, b in zip(w, w[1:]):
            if not {a, b} <= PLAIN:
                pairs.setdefault(a, set()).add(b)
    quoted = lambda x: x.replace(".", r"\.")
    tree = "|".join(f"{quoted(a)}{PART}(?:{'|'.join(map(quoted, sorted(bs)))})" for a, bs in sorted(pairs.items()))
    names = "|".join(n.replace(" ", PART) for n in NAMES)
    return rf"{ANCHORS}|(?<![\p{{L}}\p{{N}}])(?:(?:{names})(?!\p{{L}})|(?:{tree})(?![\p{{L}}\p{{N}}]))"


def tokens(line: str) -> list[str]:
    """Words as the column expression cuts them."""
    import regex

    return [w for w in (w.strip(".-") for w in regex.split(PART, line.lower())) if w]


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _hash(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode(), 42)


def _vector(line: str) -> np.ndarray:
    found = sorted({_hash(g) & (DIM - 1) for g in grams(tokens(line))})
    out = np.zeros(DIM)
    out[found] = 1 / np.sqrt(max(len(found), 1))
    return out


def fit(negatives: list[str]) -> dict:
    """Weights (classes, DIM), biases, temperature and threshold; class 0 is none."""
    rng = random.Random(5)
    classes = ["none", *TEMPLATES, "unknown"]
    lines: list[tuple[str, int]] = [(x, 0) for x in negatives]
    plain = [w for x in negatives for w in tokens(x)][:5000] or ["word"]

    def variants(text: str) -> list[str]:
        out = []
        for v in range(VARIANTS):
            words = [w for w in text.split() if v == 0 or rng.random() > 0.08]
            out.append(" ".join([rng.choice(plain) for _ in range(rng.choice(PADDING))] + words + [rng.choice(plain) for _ in range(rng.choice(PADDING))]))
        return out

    for c, texts in enumerate([*TEMPLATES.values(), ANOTHER], 1):
        lines += [(line, c) for text in texts for line in variants(text)]
    for text in OTHERS:
        lines += [(" ".join([w for w in text.split() if v == 0 or rng.random() > 0.1]), 0) for v in range(VARIANTS)]
    rng.shuffle(lines)
    x, y = np.stack([_vector(t) for t, _ in lines]), np.array([c for _, c in lines])
    fit_rows = np.arange(len(y)) % 4 > 0
    goal = np.eye(len(classes))[y]
    w, b = np.zeros((DIM, len(classes))), np.zeros(len(classes))
    for _ in range(250):
        z = x[fit_rows] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (goal[fit_rows] - p) / fit_rows.sum()
        w += 60 * (x[fit_rows].T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.002, 0)  # keeps weights sparse
        b += 6 * error.sum(0)
    held, truth = x[~fit_rows] @ w + b, y[~fit_rows]

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((held - held.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    held = np.stack([_vector(line) for text in STRANGE for line in variants(text)]) @ w + b
    p = probabilities(temperature)
    family = (p.argmax(1) > 0) & (p.argmax(1) < len(classes) - 1)
    taken = np.sort(np.where(family, p.max(1), 0.0))
    return {"classes": classes, "w": w, "b": b, "temperature": temperature, "threshold": max(0.5, float(taken[int((1 - LET_THROUGH) * len(taken))]) + 1e-9)}


def train(docs: DataFrame) -> dict:
    names = "|".join(NAMES).replace(" ", PART)
    one_in = max(1, docs.count() // NEGATIVE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(one_in)) == 0)
    lines = some.select(F.explode(F.flatten(F.flatten(F.transform(paragraphs(F.coalesce("text", F.lit(""))), lambda p: windows(p["t"]))))).alias("line"))
    lines = lines.where(~F.col("line").rlike(rf"{ANCHORS}|(?<![\p{{L}}\p{{N}}])(?:{names})(?!\p{{L}})") & (F.char_length("line") > 20))
    rows = lines.select(F.xxhash64("line").alias("h"), "line").distinct().orderBy("h", "line").limit(NEGATIVES).collect()
    return fit([r[1] for r in rows])


def paragraphs(text: Column) -> Column:
    """Array of (line, t): first line, from 0, and text of the paragraphs, whose lines are joined by spaces."""

    def between(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        edges = F.concat(F.array(F.lit(-1)), blank, F.array(F.size(lines)))
        part = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.struct((F.get(e, k) + 1).alias("line"), (F.get(e, k + 1) - F.get(e, k) - 1).alias("n")))
        found = let(edges, lambda e: F.filter(part(e), lambda p: p["n"] > 0))
        return F.transform(found, lambda p: F.struct(p["line"].alias("line"), F.array_join(F.slice(lines, p["line"] + 1, p["n"]), " ").alias("t")))

    return let(F.split(text, "\n"), between)


def windows(paragraph: Column) -> Column:
    """Array, for each sentence, of its windows."""
    last = lambda w: F.size(w) - STEP - 1
    cut = lambda s, w: F.when(F.size(w) <= WIDTH, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last(w), F.lit(0)), F.lit(STEP)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(WIDTH)), " ")))
    return F.transform(F.split(paragraph, ENDS), lambda s: let(F.split(s, SPACE), lambda w: cut(s, w)))


def _numbers(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


def shortest_of() -> list[int]:
    """For every class the word pairs of its shortest template that is a sentence."""
    return [1, *[min(len(t.split()) - 1 for t in texts if not t.startswith("spdx")) for texts in TEMPLATES.values()], 1]


def classify(line: Column, model: dict) -> Column:
    """Struct of family, probability and confirmed for one line."""
    classes, k = model["classes"], len(model["classes"])
    weights = _numbers(model["w"].reshape(-1))
    biases = F.array(*[F.lit(float(v)) for v in model["b"]])
    pairs = F.array(*[F.array(*[F.lit(h - (1 << 64) if h >> 63 else h) for h in sorted({_hash(g) for t in TEMPLATES.get(c, []) for g in grams(t.split()) if " " in g})] or [F.lit(0).cast("long")]).cast("array<bigint>") for c in classes])
    words = F.filter(F.transform(F.split(F.lower(line), PART), lambda w: F.regexp_replace(w, r"\A[.-]+|[.-]+\z", "")), lambda w: w != "")
    both = lambda w: F.concat(w, F.filter(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))), lambda g: g.contains(" ")))
    shortest = F.array(*map(F.lit, shortest_of()))

    def scored(hashes: Column) -> Column:
        places = F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(DIM - 1).cast("int")))
        norm = lambda p: F.sqrt(F.greatest(F.size(p), F.lit(1)).cast("double"))
        logit = lambda p, c: F.get(biases, c) + F.aggregate(p, F.lit(0.0), lambda a, j: a + F.get(weights, j * k + c)) / norm(p)
        logits = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: logit(p, c) / model["temperature"]))

        def best(z: Column) -> Column:
            top = F.array_max(z)
            c = (F.array_position(z, top) - 1).cast("int")
            p = 1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
            met = F.size(F.array_intersect(hashes, F.get(pairs, c)))
            return F.struct(c.alias("c"), p.alias("p"), (met / F.least(F.greatest((F.size(hashes) / 2).cast("int"), F.lit(1)), F.get(shortest, c))).alias("share"))

        return let(logits, best)

    def told(r: Column) -> Column:
        names = F.array(*[F.lit(c) for c in classes])
        family = F.when(r["c"] == 0, "none").when((r["c"] == k - 1) | (r["p"] < model["threshold"]) | (r["share"] < CONFIRMED), "unknown").otherwise(F.get(names, r["c"]))
        return F.struct(family.alias("family"), F.round(r["p"], 6).alias("probability"), (r["share"] >= CONFIRMED).alias("confirmed"))

    hashes = let(words, lambda w: F.transform(both(w), lambda g: F.xxhash64(g)))
    return let(let(hashes, scored), told)


def _best(found: Column) -> Column:
    """Of the results (probability, family, confirmed) of a sentence: the family of the highest probability, else unknown, else null."""
    said = lambda rs, test: F.array_max(F.filter(rs, test))
    return F.coalesce(said(found, lambda r: ~r["family"].isin("none", "unknown")), said(found, lambda r: r["family"] == "unknown"))


def _told(found: Column) -> Column:
    """Of the sentences' results of a paragraph: the best of each family, unknown only alone."""
    named = F.filter(found, lambda r: r["family"] != "unknown")
    each = lambda rs: F.transform(F.array_sort(F.array_distinct(F.transform(rs, lambda r: r["family"]))), lambda f: F.array_max(F.filter(rs, lambda r: r["family"] == f)))
    return let(F.when(F.size(named) > 0, named).otherwise(found), each)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, families (sorted, distinct; "unknown" for a licence paragraph of no certain family), paragraphs of every row.

    paragraphs: array of (line, family, probability, confirmed) of the paragraphs that
    the classifier does not take for ordinary text, a row for each of their families, by the
    first line, which counts from 0. Of windows, or families, of equal probability the last by
    name counts. Texts of any length are read whole. A null or empty text has none.
    Rows with a null doc_id and repeated rows come out each for itself, further columns play no
    part, whatever their names, and an empty table gives an empty result.
    """
    model = train(docs) if model is None else model
    text = F.coalesce("text", F.lit(""))
    scored = lambda line: let(classify(line, model), lambda r: F.struct(r["probability"].alias("probability"), r["family"].alias("family"), r["confirmed"].alias("confirmed")))
    sentence = lambda ws: _best(F.transform(F.filter(ws, lambda w: w.rlike(gate())), scored))
    results = lambda p: let(F.array_compact(F.transform(windows(p["t"]), sentence)), _told)
    rows = lambda p: F.transform(results(p), lambda r: F.struct(p["line"].alias("line"), r["family"].alias("family"), r["probability"].alias("probability"), r["confirmed"].alias("confirmed")))
    passed = F.filter(paragraphs(text), lambda p: p["t"].rlike(gate()))
    kind = "array<struct<line:int,family:string,probability:double,confirmed:boolean>>"
    found = F.when(text.rlike(gate()), F.flatten(F.transform(passed, rows))).otherwise(F.array().cast(kind))
    told = docs.select(F.col("doc_id").cast("long"), found.cast(kind).alias("paragraphs"))
    return told.select("doc_id", F.array_sort(F.array_distinct(F.transform("paragraphs", lambda r: r["family"]))).alias("families"), "paragraphs")
