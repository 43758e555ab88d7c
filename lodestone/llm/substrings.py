"""Substring deduplication by sliding sentence spans (operator 8).

A text is cut into sentences: a word that ends in an ending mark, or a line break
behind a word, closes one. Sentences of WINDOW words or more are cut once more at
words that their own hash picks: the least of every WINDOW words in a row begins a
part. What decides a cut lies within WINDOW words of it, so of a repeated passage
all but fewer than WINDOW words at each end is cut alike wherever it begins and
ends, and every repeat of MIN_WORDS + 2 * WINDOW - 1 = 50 or more words holds a
common span.

Spans are runs of consecutive parts with at least min_words words: from every part the
shortest such run that begins there, and to every part the shortest that ends
there, so a repeated passage is covered to its outermost common cuts. Words, cuts
and spans of a block of texts are found together by array operations on code points.

Spans are joined globally by 96 bits of hash of their words (lower-cased), as a
merge of one range-partitioned sort. The first occurrence of a span by document
and position stays; parts that a later occurrence covers go.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

MIN_WORDS = 25
WINDOW = 13  # words: most of a part
BLOCK = 250_000  # code points of the texts handled together; a longer text is a block by itself
PLAIN = 0x3001  # code points from here on are neither white space nor lower-cased
SPACE = np.array([chr(c).isspace() for c in range(PLAIN)])
LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(PLAIN)], np.uint64)
BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]  # odd, so they have inverses


def _mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Parts(NamedTuple):
    """The parts of a block of texts."""

    whose: np.ndarray  # place of the text of every part
    at: np.ndarray  # code point of its text at which a part begins
    bound: np.ndarray  # word at which every part begins, and the number of words
    hashes: np.ndarray  # of the words
    first: np.ndarray  # first part of every text, and the number of parts


def parts_of(texts: list[str]) -> Parts:
    """Sentences of the texts, long ones in parts of at most WINDOW words."""
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])  # of the texts
    low = np.minimum(cp, PLAIN - 1)
    space = SPACE[low] & (cp < PLAIN)
    edge = np.flatnonzero(np.diff(space, prepend=True))  # words begin and end in turn
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return Parts(*[np.zeros(0, np.int64)] * 2, np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    size = end - start
    letters = np.where(cp < PLAIN, LOWER[low], cp)[~space] + np.uint64(1)
    inside = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    hashes = _mix(np.add.reduceat(letters * _powers(BASES[0], int(size.max()))[inside], np.cumsum(size) - size))
    lines = np.cumsum(cp == 10)
    cut = np.ones(n, bool)
    cut[1:] = np.isin(cp[end[:-1] - 1], [33, 46, 63]) | (lines[start[1:]] > lines[end[:-1] - 1])
    sentence = np.cumsum(cut)
    if n >= WINDOW:
        rank, m = _mix(hashes ^ BASES[2]), n - WINDOW + 1
        least, where = rank[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, WINDOW):  # the least of every WINDOW words, the last of equal ones
            hit = rank[k : m + k] <= least
            least[hit] = rank[k : m + k][hit]
            where[hit] = k
        whole = sentence[:m] == sentence[WINDOW - 1 :]
        cut[(np.arange(m) + where)[whole]] = True
    words = np.flatnonzero(cut)
    whose = np.searchsorted(begins, start[words], side="right") - 1
    first = np.searchsorted(whose, np.arange(len(texts) + 1))
    at = start[words] - begins[whose]
    at[first[:-1][np.diff(first) > 0]] = 0  # white space at the front belongs to the first part
    return Parts(whose, at, np.append(words, n), hashes, first)


def sentences(text: str) -> list[str]:
    """Consecutive parts that make up a text; one without words is one part, an empty one none."""
    at = [*parts_of([text]).at.tolist(), len(text)] if text.strip() else [0, len(text)][: 2 * bool(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def spans_of(texts: list[str], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of every span of the texts: place of the text, first part, part after the last, two halves of the hash."""
    p = parts_of(texts)
    n = len(p.whose)
    part = np.arange(n)
    begin, until = p.bound[p.first[p.whose]], p.bound[p.first[p.whose + 1]]  # words of the part's text
    ahead, back = p.bound[:-1] + min_words, p.bound[1:] - min_words
    to, since = np.searchsorted(p.bound, ahead), np.searchsorted(p.bound, back, side="right") - 1
    forth, upto = ahead <= until, back >= begin
    runs = np.unique(np.concatenate([part[forth] * (n + 1) + to[forth], since[upto] * (n + 1) + part[upto] + 1]))
    i, j = runs // (n + 1), runs % (n + 1)
    a, b = p.bound[i], p.bound[j]
    found = []
    for base, words in ((BASES[1], p.hashes), (BASES[2], _mix(p.hashes))):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)))])
        found.append(_mix((sums[b] - sums[a]) * _powers(inverse, len(words) + 1)[a] + (b - a).astype(np.uint64)))
    whose = p.whose[i]
    return whose, (i - p.first[whose]).astype(np.int32), (j - p.first[whose]).astype(np.int32), found[0].view(np.int64), (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spans(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, ...]]:
    """(first part, part after the last, two halves of the hash) of every span."""
    return list(zip(*(x.tolist() for x in spans_of([text], min_words)[1:])))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK code points."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


def _span_rows(docs: DataFrame, min_words: int, identity: list[Column]) -> DataFrame:
    names = ["doc_id", "th", "tl", "i", "j", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for a, b in _blocks(texts):
                whose, *found = spans_of(texts[a:b], min_words)
                at = pa.array(whose + a, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *map(pa.array, found)], names)

    return docs.select(F.col("doc_id").cast("long"), *identity, "text").mapInArrow(run, "doc_id long, th long, tl int, i int, j int, h long, g int")


def _identity(docs: DataFrame) -> list[Column]:
    """th, tl: 96 bits of the text that tell rows of one doc_id apart; zero where every doc_id has one row, as then nothing needs telling apart."""
    text = F.coalesce("text", F.lit(""))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    told = ids.where(F.col("doc_id").isNull() | (F.col("n") > 1)).isEmpty()
    return [(F.lit(0) if told else F.xxhash64(text)).cast("long").alias("th"), (F.lit(0) if told else F.hash(text)).cast("int").alias("tl")]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of the packed spans in the order of hash and place.

    Yields the spans that follow another place of their hash (edge false), and as
    edges the first place of the partition's first hash and of its last one: what
    earlier partitions hold can only change the former.
    """
    names = ["edge", "lead", "h", "gt", "doc_id", "th", "ij"]
    first = None  # row of the first place of the hash at hand, as Arrow
    lead = True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names[2:]}
        n = batch.num_rows
        gt = cols["gt"].to_numpy()
        key = [cols["h"].to_numpy(), gt >> 32]
        nil = np.asarray(cols["doc_id"].is_null())
        place = [nil, cols["doc_id"].fill_null(0).to_numpy(), cols["th"].to_numpy(), gt & 0xFFFFFFFF, cols["ij"].to_numpy() >> 32]
        new = np.ones(n, bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
        if first is not None:
            new[0] = (key[0][0], key[1][0]) != first[0]
        starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the hash began in an earlier batch
        other = np.zeros(n, bool)
        for k, c in enumerate(place):
            base = c[np.maximum(starts, 0)]
            if first is not None:
                base = np.where(starts < 0, first[1][k], base)
            other |= c != base
        at = np.flatnonzero(other)
        no, take = pa.array(np.zeros(len(at), bool)), pa.array(at)
        # The hashes have done their work here; only the edges need them further on.
        yield pa.RecordBatch.from_arrays([no, no, pa.array(np.zeros(len(at), np.int64)), pa.array(gt[at] & 0xFFFFFFFF), *(cols[c].take(take) for c in names[4:])], names)
        if starts[-1] >= 0:
            k = int(starts[-1])
            first = ((key[0][k], key[1][k]), [c[k] for c in place], [cols[c].slice(k, 1) for c in names[2:]])
        if lead:
            yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([True]), *[cols[c].slice(0, 1) for c in names[2:]]], names)
            lead = False
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([False]), *first[2]], names)


def repeated_spans(table: DataFrame) -> DataFrame:
    """doc_id, th, tl, i, j of the spans (of _span_rows) that are not at the first place of their hash.

    The table meets itself in one global sort by hash and place: a hash that a
    large share of the documents hold goes over many partitions, as its places
    differ. Two rows for each partition settle the hashes on the borders. Pairs of
    small numbers travel as one.
    """
    two = lambda a, b: (F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long").bitwiseAND(0xFFFFFFFF)))
    high = lambda c: F.shiftright(c, 32).cast("int")
    low = lambda c: (F.shiftright(F.shiftleft(F.col(c), 32), 32)).cast("int")
    packed = table.select("h", two("g", "tl").alias("gt"), "doc_id", "th", two("i", "j").alias("ij"))
    order = ["h", high("gt"), F.asc_nulls_last("doc_id"), "th", low("gt"), high("ij")]
    met = materialize(packed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_meet, "edge boolean, lead boolean, h long, gt long, doc_id long, th long, ij long"), "repeats")
    met = met.select("edge", "lead", "h", high("gt").alias("g"), "doc_id", "th", low("gt").alias("tl"), high("ij").alias("i"), low("ij").alias("j"))
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th", "tl", "i")
    edges = met.where("edge").withColumn("first", F.min(place).over(Window.partitionBy("h", "g")))
    late = edges.where(F.col("lead") & (place != F.col("first")))
    return met.where("not edge").select("doc_id", "th", "tl", "i", "j").unionByName(late.select("doc_id", "th", "tl", "i", "j"))


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (array of first and after-last part), text of every row.

    n_sentences and n_removed count the parts of `sentences`. A null or empty
    text has none and becomes or stays empty. The first
    occurrence is that of the smallest doc_id (null last), then 96 bits of
    hash of the text, then position; rows that repeat both doc_id and text are one document and all
    returned alike. A document none of whose parts repeat keeps its text to
    the letter. An empty table gives an empty result; other columns play no part.
    """
    identity = _identity(docs)
    later = repeated_spans(materialize(_span_rows(docs, min_words, identity), "spans"))
    gone = later.groupBy("doc_id", "th", "tl").agg(F.array_sort(F.collect_set(F.struct("i", "j"))).alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n_all, n_gone = [], []
            for a, b in _blocks(texts):
                p = parts_of(texts[a:b])
                for k, text in enumerate(texts[a:b]):
                    at = [*p.at[p.first[k] : p.first[k + 1]].tolist(), len(text)]
                    lost = {x for r in removed[a + k] for x in range(r["i"], r["j"])}
                    n_all.append(max(len(at) - 1, int(bool(text))))
                    n_gone.append(len(lost))
                    if lost:
                        texts[a + k] = "".join([text[at[x] : at[x + 1]] for x in range(len(at) - 1) if x not in lost])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_all, pa.int64()), pa.array(n_gone, pa.int64()), batch.column(2), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), *identity, F.coalesce("text", F.lit("")).alias("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.th") == F.col("g.th")) & (F.col("d.tl") == F.col("g.tl"))
    met = rows.join(gone.alias("g"), same, "left")
    kind = "array<struct<i:int,j:int>>"
    return met.select("d.doc_id", "d.text", F.coalesce("g.removed", F.array().cast(kind)).alias("removed")).mapInArrow(run, f"doc_id long, n_sentences long, n_removed long, removed {kind}, text string")
