"""Personal data (operator 10): base patterns, and boosted trees over high-recall candidates; no user functions.

Base spans are leftmost matches of four patterns that pass a check. Further
candidates (key-like tokens, groups of digits, spelled-out addresses, account
numbers) come from broad patterns that are run apart from each other, so they
may overlap. Gradient-boosted trees score them all on their form and context.
Spans above a calibrated threshold that do not overlap a base span are added; of
overlapping ones a sweep from the left keeps the one of the best score.

Patterns repeat groups possessively, which the matcher does in a loop and not by
recursion, and begin only where a run of their characters begins, so that texts
of any length are searched in linear time. No span crosses a line break.

The trees are trained on the driver on at most SAMPLE candidates, those with
the smallest hash of document and place. Their labels are weak: a candidate is
positive if a keyword or a check digit vouches for it. Half of the positives
appear once more without their context, so the form alone can tell. The trees
become one SQL expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.native import fresh, let, starts_of

KINDS = ["email", "ip", "card", "phone", "secret", "number", "contact", "account"]
# The base patterns, with possessive groups and starts at the head of a run (or behind a match); they have
# the same leftmost matches as the plain forms, since what follows a run does not depend on where in it a match begins.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of further candidates, each run by itself: spelled-out address, account number, key-like token (of
#: 16 or more characters with a digit anywhere), what an equals sign assigns within such a token.
GENERATORS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:[\[({] ?(?:dot|DOT) ?[\])}]|\.) ?[A-Za-z0-9-]++)++",
    r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}",
    r"(?<=[A-Za-z_]=)(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}={0,2}",
]
#: From every group of digits, the shortest number of 7 or more digits and the longest of up to 19; they overlap each other.
INNER = [r"(?<![0-9])(?=([0-9](?:[ ()./-]{0,2}[0-9]){6,18}?(?![0-9])))", r"(?<![0-9])(?=([0-9](?:[ ()./-]{0,2}[0-9]){6,18}(?![0-9])))"]
#: For each generator a pattern that is quick to miss and holds in every text with a match; a text without it is not searched.
GATES = [r"[\[({] ?(?:at|AT) ?[\])}]", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"[0-9](?:(?<=[A-Za-z0-9_+/=-]{9})|(?=[A-Za-z0-9_+/=-]{8}))", r"=[A-Za-z0-9_+/-]{16}"]
NUMBER = r"[0-9](?:[ ()./-]{0,2}[0-9]){6}"
CANDIDATE = "|".join([*GATES, NUMBER])
SECRET_WORDS = r"(?i)(?:token|secret|key|passw|pwd|auth|bearer|credential)"
CONTACT_WORDS = r"(?i)(?:phone|tel|fon|call|contact|mail|card|ssn|iban|account|konto|cuenta|carte|karte|tarjeta)"
CONTEXT = 24  # code points before a candidate
SAMPLE = 20_000  # bound of the candidates that the trees learn from
SAMPLE_DOCS = 20_000  # documents (about) among whose candidates these are taken
BLOCK = 1024  # code points of a block of text, or spans of a block of spans, so that no step costs the whole
TREES, DEPTH, RATE = 24, 3, 0.3
PRECISION = 0.97  # that the threshold must reach on the half of the sample kept for calibration
FEATURES = ["length", "digits", "digit_share", "upper_share", "distinct", "hex", "luhn", "separators", "has_at", "iban", "assigned", "secret_word", "contact_word", "quoted", "word_before"]


def found(text: Column, searches: list[tuple[str, bool, Column]]) -> Column:
    """For each search (pattern, whole, gate) the array of (s, e, t): code points at which its matches begin and end, and their text.

    whole: the match is the text, and matches do not overlap; else the first group
    of a pattern that consumes nothing is. A search whose gate is false finds nothing.
    """

    def searched(pattern: str, whole: bool, gate: Column) -> Column:
        led = text if whole else F.concat(F.lit("\x01"), text)  # no split drops an empty part at the front
        gaps = F.when(gate, F.transform(F.split(led, pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>"))
        told = F.when(gate, F.regexp_extract_all(led, F.lit(pattern), F.lit(0 if whole else 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(gaps.alias("g"), told.alias("m"), F.lit(int(whole)).alias("w"))

    def placed(r: Column) -> Column:
        g, m, w = r["g"], r["m"], r["w"]
        before = starts_of(F.transform(m, lambda t, i: F.get(g, i) + F.char_length(t) * w))
        return let(before, lambda at: F.transform(m, lambda t, i: _span(F.get(at, i) + F.get(g, i) + w - 1, t)))

    return F.transform(F.array(*[searched(*x) for x in searches]), placed)


def _span(start: Column, t: Column) -> Column:
    return F.struct(start.cast("long").alias("s"), (start + F.char_length(t)).cast("long").alias("e"), t.alias("t"))


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """12 to 19 digits whose weighted sum is a multiple of ten."""
    d = digits_of(t)
    value = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    total = F.aggregate(value, F.lit(0), lambda a, v: a + v)
    return F.char_length(d).between(12, 19) & (F.when(F.char_length(d).between(12, 19), total).otherwise(1) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Array, for the four base kinds, of arrays of (s, e, k) by place."""
    octets = lambda t: F.forall(F.split(t, r"\."), lambda p: p.cast("double") <= 255)
    phone = lambda t: F.char_length(digits_of(t)).between(9, 15)
    searches = [(EMAIL, True, text.contains("@")), (IP, True, text.rlike(r"\.[0-9]++\.[0-9]")), (CARD, True, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), (PHONE, True, text.rlike(r"\+[0-9]"))]
    checks = [None, octets, luhn, phone]

    def kind(spans: Column, k: int) -> Column:
        kept = F.filter(spans, lambda x: checks[k](x["t"])) if checks[k] else spans
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k")))

    return let(found(text, searches), lambda each: F.array(*[kind(F.get(each, F.lit(k)), k) for k in range(len(checks))]))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, n: Column) -> Column:
    """n code points from start on, from the blocks of a text."""
    first = F.floor(start / BLOCK).cast("int")
    inside = (start % BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, ((inside + n) / BLOCK).cast("int") + 1), ""), inside + 1, n.cast("int"))


def proposals(text: Column) -> Column:
    """Array of (s, e, t): candidates of every generator, overlapping ones too, each span once, by place."""
    each = [(p, True, text.rlike(gate)) for p, gate in zip(GENERATORS, GATES)] + [(p, False, text.rlike(NUMBER)) for p in INNER]
    once = lambda a: F.filter(a, lambda x, i: F.coalesce((x["s"] != F.get(a, i - 1)["s"]) | (x["e"] != F.get(a, i - 1)["e"]), F.lit(True)))
    return let(F.array_sort(F.flatten(found(text, each))), once)


def candidates(text: Column, finish=lambda features: features, kind: str = "array<double>") -> Column:
    """Array of (s, e, k, f) of the proposals; f is what finish (of the given kind) makes of their features."""
    num = lambda c: c.cast("double")

    def described(x: Column, blocks: Column) -> Column:
        t, n = x["t"], F.char_length(x["t"])
        d = F.char_length(digits_of(t))
        begin = F.greatest(x["s"] - CONTEXT, F.lit(0))
        before = piece(blocks, begin, x["s"] - begin)
        after = piece(blocks, x["e"], F.lit(1))
        iban = t.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3}")
        at = t.rlike(r"(?i)[\[({] ?at ?[\])}]")
        kind = F.when(at, KINDS.index("contact")).when(iban, KINDS.index("account")).when(t.rlike("[A-Za-z]"), KINDS.index("secret")).otherwise(KINDS.index("number"))
        feature = lambda b, a: F.array(
            num(n), num(d), d / n, F.char_length(F.regexp_replace(t, "[^A-Z]", "")) / n, F.size(F.array_distinct(F.split(t, ""))) / n,
            num(t.rlike("^[0-9a-fA-F]+$") & t.rlike("[a-fA-F]")), num(luhn(t)), num(F.char_length(F.regexp_replace(t, "[^ ()./-]", ""))), num(at), num(iban),
            num(b.rlike(r"[=:]\s*[\"']?$")), num(b.rlike(SECRET_WORDS)), num(b.rlike(CONTACT_WORDS)), num(b.rlike(r"[\"']$") & a.rlike(r"^[\"']")), num(b.rlike(r"[\p{L}\p{N}]$")),
        )
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), kind.alias("k"), let(let(before, lambda b: feature(b, after)), finish).alias("f"))

    all_of = lambda spans: let(blocks_of(text), lambda blocks: F.transform(spans, lambda x: described(x, blocks)))
    none = F.array().cast(f"array<struct<s:bigint,e:bigint,k:int,f:{kind}>>")
    return let(proposals(text), lambda spans: F.when(F.size(spans) == 0, none).otherwise(all_of(spans)))


def sweep(items: Column, state: Column, emitted: str, step) -> Column:
    """What step(state, item) -> struct(st, emit) emits over the items in order, nulls left out; block by block, so that no append copies all.

    A last item of null lets step emit what it still holds.
    """
    empty = F.array().cast(f"array<{emitted}>")
    grown = lambda a, r: F.struct(F.when(r["emit"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(r["emit"]))).alias("out"), r["st"].alias("st"))
    inside = lambda st, block: F.aggregate(block, F.struct(empty.alias("out"), st.alias("st")), lambda a, x: let(step(a["st"], x), lambda r: grown(a, r)))
    together = lambda a, r: F.struct(F.concat(a["done"], F.array(r["out"])).alias("done"), r["st"].alias("st"))
    width = BLOCK // 4

    def run(all_items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_items) - 1) / width).cast("int")), lambda b: F.slice(all_items, b * width + 1, F.lit(width)))
        return F.aggregate(blocks, F.struct(F.array(empty).alias("done"), state.alias("st")), lambda a, b: let(inside(a["st"], b), lambda r: together(a, r)), lambda a: F.flatten(a["done"]))

    return let(F.concat(items, F.array(F.lit(None))), run)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 where a keyword with an assignment or quotes, a check digit with a contact word, or an explicit form vouches."""
    at = {name: x[:, i] for i, name in enumerate(FEATURES)}
    key = (at["secret_word"] > 0) & ((at["assigned"] > 0) | (at["quoted"] > 0)) & (at["length"] >= 16) & (at["digits"] >= 2)
    checked = (at["luhn"] > 0) | (at["iban"] > 0) & (at["digit_share"] > 0.5)
    numbered = (at["contact_word"] > 0) & (at["digit_share"] > 0.6) & (at["digits"] >= 7)
    return ((key | checked | numbered | (at["has_at"] > 0)) & (at["word_before"] == 0)).astype(float)


def fit_trees(x: np.ndarray, y: np.ndarray) -> list:
    """Boosted regression trees on the logistic loss; a tree is a number or (feature, bound, tree if at most, tree if above)."""
    score, trees = np.zeros(len(y)), []
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1])) for j in range(x.shape[1])]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total = lambda m: (g[m].sum() ** 2) / (h[m].sum() + 1.0)
        leaf = float(RATE * g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 4:
            return leaf
        best = (1e-6, None)
        for j, cuts in enumerate(bounds):
            for c in cuts:
                low = rows[x[rows, j] <= c]
                if 0 < len(low) < len(rows):
                    gain = total(low) + total(rows[x[rows, j] > c]) - total(rows)
                    if gain > best[0]:
                        best = (gain, (j, float(c)))
        if best[1] is None:
            return leaf
        j, c = best[1]
        return j, c, grow(rows[x[rows, j] <= c], g, h, depth - 1), grow(rows[x[rows, j] > c], g, h, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        score += np.array([tree_value(tree, r) for r in x])
    return trees


def tree_value(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_sql(tree, features: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(F.get(features, F.lit(tree[0])) <= tree[1], tree_sql(tree[2], features)).otherwise(tree_sql(tree[3], features))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list, float]:
    """(trees, threshold on their sum); without candidates no trees and a threshold that nothing meets."""
    one_in = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(one_in)) == 0) & F.col("text").rlike(CANDIDATE))
    rows = some.select("doc_id", F.explode(candidates(F.col("text"))).alias("c"))
    rows = rows.select(F.xxhash64("doc_id", "c.s").alias("o"), F.col("c.f").alias("f")).orderBy("o", "f").limit(sample).collect()
    if not rows:
        return [], float("inf")
    x = np.array([r[1] for r in rows])
    y = weak_labels(x)
    order = np.array([r[0] for r in rows]) % 2 == 0
    bare = x[order & (y > 0)][::2].copy()
    bare[:, [FEATURES.index(n) for n in ("assigned", "secret_word", "contact_word", "quoted")]] = 0
    xs, ys = np.vstack([x[order], bare]), np.concatenate([y[order], np.ones(len(bare))])
    distinct, place, count = np.unique(np.hstack([xs, ys[:, None]]), axis=0, return_inverse=True, return_counts=True)
    keep = np.repeat(np.arange(len(distinct)), np.minimum(count, 8))  # equal rows count eight times at most: a repeated span is no further evidence
    trees = fit_trees(distinct[keep, :-1], distinct[keep, -1]) if len(keep) else []
    held = x[~order] if (~order).any() else x
    truth = weak_labels(held)
    scores = np.array([sum(tree_value(t, r) for t in trees) for r in held])
    ranked = np.argsort(-scores, kind="stable")
    right = np.cumsum(truth[ranked]) / np.arange(1, len(ranked) + 1)
    last = np.append(scores[ranked][1:] != scores[ranked][:-1], True)
    good = np.flatnonzero((right >= PRECISION) & last)
    return trees, max(float(scores[ranked][good[-1]]), 0.0) - 1e-9 if len(good) else float("inf")


_ITEM = "struct<s:bigint,f:int,e:bigint,k:int,o:double>"


def resolve(items: Column) -> Column:
    """Array of (s, e, k): the spans that stay of items (s, f, e, k, o), sorted; f is 0 for a base span, 1 for a candidate of score o.

    Candidates that overlap a base span go. From left to right, a candidate that
    overlaps the one held goes unless its score is better (or equal and it is
    longer); then the held one goes, and what that one had put out returns if it
    is clear of the new one.
    """
    nothing = F.lit(None).cast(_ITEM)
    start = F.struct(nothing.alias("held"), nothing.alias("out"), F.lit(0).cast("long").alias("wall"))

    def step(a: Column, x: Column) -> Column:
        held, out = a["held"], a["out"]
        clear = held.isNull() | (held["e"] <= x["s"])
        better = (x["o"] > held["o"]) | (x["o"] == held["o"]) & (x["e"] - x["s"] > held["e"] - held["s"])
        back = out["e"] <= x["s"]  # null if there is none
        state = lambda h, o, w: F.struct(h.alias("held"), o.alias("out"), w.alias("wall"))
        result = lambda st, emit: F.struct(st.alias("st"), emit.alias("emit"))
        return (
            F.when(x.isNull(), result(state(nothing, nothing, a["wall"]), held))
            .when(x["f"] == 0, result(state(nothing, nothing, F.greatest(a["wall"], x["e"])), F.when(clear, held).when(back, out)))
            .when(x["s"] < a["wall"], result(a, nothing))
            .when(clear, result(state(x, nothing, a["wall"]), held))
            .when(better & back, result(state(x, nothing, a["wall"]), out))
            .when(better, result(state(x, held, a["wall"]), nothing))
            .otherwise(result(a, nothing))
        )

    return F.transform(sweep(items, start, _ITEM, step), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def added(text: Column, base: Column, model: tuple[list, float]) -> Column:
    """Array of (s, e, k): the candidates above the threshold that stay beside the base spans and each other."""
    trees, threshold = model
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int>>")
    if not trees:
        return none
    score = lambda f: sum((tree_sql(t, f) for t in trees[1:]), tree_sql(trees[0], f))
    item = lambda x, f, o: F.struct(x["s"].alias("s"), F.lit(f).alias("f"), x["e"].alias("e"), x["k"].alias("k"), o.alias("o"))
    good = F.transform(F.filter(candidates(text, score, "double"), lambda c: c["f"] > threshold), lambda c: item(c, 1, c["f"]))
    all_items = lambda g: F.array_sort(F.concat(F.transform(base, lambda b: item(b, 0, F.lit(None).cast("double"))), g))
    return let(good, lambda g: F.when(F.size(g) == 0, none).otherwise(resolve(all_items(g))))


def find(docs: DataFrame, model: tuple[list, float] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (array of (s, e, k), by s then k) of every row.

    Places are code points, ends exclusive. A null or empty text has no spans:
    counts 0, the digest of the empty string, an empty string of spans. Texts are
    searched whole and apart from each other; repeated rows repeat, further
    columns play no part, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    model = train(rows) if model is None else model
    each = rows.select("doc_id", "text", base_spans(F.col("text")).alias("each")).select("*", F.flatten("each").alias("base"))
    more = added(F.col("text"), F.col("base"), model)
    ordered = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    each = each.select("doc_id", "each", ordered(F.col("base")).alias("base"), ordered(F.concat(F.col("base"), more)).alias("found"))
    counts = [F.size(F.get("each", F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return each.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text, base and added, replaced by its kind in square brackets; a null text stays null.

    Of overlapping spans the first by place gives the mark, and the rest of the
    later one goes with it. Columns but text stay as they are, repeated rows
    repeat, and an empty table stays empty.
    """
    model = train(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    names = F.array(*[F.lit(k) for k in KINDS])

    kind = "struct<s:bigint,e:bigint,k:int>"

    def merge(held: Column, x: Column) -> Column:
        """Spans that overlap become one of the first one's kind."""
        span = lambda s, e, k: F.struct(s.alias("s"), e.alias("e"), k.alias("k"))
        meets = held.isNotNull() & (x["s"] < held["e"])
        return F.struct(F.when(meets, span(held["s"], F.greatest(held["e"], x["e"]), held["k"])).otherwise(x).alias("st"), F.when(~F.coalesce(meets, F.lit(False)), held).alias("emit"))

    def cut(spans: Column, blocks: Column) -> Column:
        """The parts before spans, each with the mark of its span, and the rest."""
        end = lambda i: F.when(i > 0, F.get(spans, i - 1)["e"]).otherwise(F.lit(0).cast("long"))
        marked = F.transform(spans, lambda x, i: F.concat(piece(blocks, end(i), x["s"] - end(i)), F.lit("["), F.get(names, x["k"]), F.lit("]")))
        last = F.element_at(spans, -1)["e"]
        return F.concat(F.array_join(marked, ""), piece(blocks, last, F.char_length(text) - last))

    base, spans, merged = (fresh(docs, name) for name in ("base", "spans", "merged"))
    steps = docs.withColumn(base, F.flatten(base_spans(text)))
    steps = steps.withColumn(spans, F.array_sort(F.concat(base, added(text, F.col(base), model))))
    steps = steps.withColumn(merged, F.when(F.size(spans) > 0, sweep(F.col(spans), F.lit(None).cast(kind), kind, merge)))
    changed = F.when(F.col(merged).isNull(), F.col("text")).otherwise(let(blocks_of(text), lambda b: cut(F.col(merged), b)))
    return steps.withColumn("text", changed).drop(base, spans, merged)
