"""Quality rules (operator 5): a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.native import WHITE, let, words

# Common function words of the languages met.
STOP_WORDS = {
    "en": "the of and to in is was for that on with as it at by this be are or an from not",
    "de": "der die das und ist nicht ein eine von mit zu den dem des auf für im sich als auch bei durch über",
    "fr": "le la les de des et un une du en que qui dans pour par sur au aux avec est ce il elle",
    "es": "el la los las de del y que en un una por con para se su al es como lo más",
}

#: (rule, measure, least, most); a document must meet all of them. None: no bound.
RULES = [
    ("words", "n_words", 20, 1_000_000),
    ("mean word length", "mean_word", 2.0, 20.0),
    ("symbols for each word", "symbol_ratio", None, 0.1),
    ("exclamation marks for each word", "shout_ratio", None, 0.3),
    ("share of stop words", "stop_ratio", 0.02, None),
    ("share of lines that repeat", "dup_line_ratio", None, 0.5),
    ("share of lines that begin with a bullet", "bullet_ratio", None, 0.9),
    ("share of lines that end in an ellipsis", "ellipsis_ratio", None, 0.5),
]
WINDOW = 8  # words of a window


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in windows found twice or more; windows are compared by a hash of their words' hashes."""

    def positions(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, d: F.coalesce(F.get(s, i + d)["h"] == F.get(s, i)["h"], F.lit(False))
        found = lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i, -1) | same(s, i, 1), x["i"])), lambda p: p.isNotNull())
        return F.array_sort(let(ordered, found))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

    each = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - WINDOW), lambda i: F.xxhash64(*[F.get(e, i + k) for k in range(WINDOW)]))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered))
    return F.when(F.size(tokens) < WINDOW, F.lit(0).cast("long")).otherwise(let(let(each, windows), count))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def measures(text: Column) -> Column:
    """Struct of what the rules look at, of one text (null: no words)."""
    whole = F.coalesce(text, F.lit(""))
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = lambda xs: F.size(xs).cast("long")
    return let(
        words(text),
        lambda w: let(
            lines,
            lambda ls: F.struct(
                n(w).alias("n_words"),
                F.char_length(F.regexp_replace(whole, WHITE, "")).cast("long").alias("word_chars"),
                F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (n(ls) - n(F.array_distinct(ls))).alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.regexp_count(whole, F.lit("!")).cast("long").alias("n_shouts"),
                n(F.filter(w, lambda x: F.lower(x).isin(stop))).alias("n_stop"),
                n(ls).alias("n_lines"),
                n(F.filter(ls, lambda x: x.rlike(r"^\s*(?:[-*•‣]|\d+[.)])\s"))).alias("n_bullets"),
                n(F.filter(ls, lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))).alias("n_ellipses"),
            ),
        ),
    )


def score(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules for every row.

    A null text has no words and fails. Texts are measured whole and apart from
    each other, so ties, repeated rows and further columns play no part; an empty
    table gives an empty result.
    """
    m = docs.select(F.col("doc_id").cast("long"), measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    value = {
        "n_words": F.col("n_words"),
        "mean_word": _share(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _share(F.col("n_symbols"), F.col("n_words")),
        "shout_ratio": _share(F.col("n_shouts"), F.col("n_words")),
        "stop_ratio": _share(F.col("n_stop"), F.col("n_words")),
        "dup_line_ratio": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_ratio": _share(F.col("n_bullets"), F.col("n_lines")),
        "ellipsis_ratio": _share(F.col("n_ellipses"), F.col("n_lines")),
    }
    failed = []
    for rule, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (value[measure] < least)
        if most is not None:
            bad = bad | (value[measure] > most)
        failed.append(F.when(bad, F.lit(rule)))
    broken = F.array_compact(F.array(*failed))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return m.select(*counts, base.alias("base_failed"), (~base & (F.size(broken) == 0)).alias("kept"), broken.alias("failed_rules"))
