"""Phrase collocations from sketch bounds and automata (operator 12).

Phrases of 2 to MOST_WORDS words that occur LEAST times in a language, scored by
their weakest cut. Three passes:

1. Every partition counts its phrases (single words too) in the cells of a hashed
   sketch; the cells' sums are upper bounds of the phrases' counts. Counters stop at
   LEAST, which settles the same cells, so a partition sends three bytes for a cell
   it has met. Cells that reach LEAST remain as one bitmap of a size bound by
   MOST_BITS, which is broadcast. The width follows the text; beyond MOST_BITS more
   phrases pass than need to, and results stay as they are.
2. Each block of text compiles the phrases in it whose bounds (of the phrase and of
   every phrase inside it) reach LEAST into an Aho-Corasick automaton, every phrase
   between delimiters, and scans itself, overlapping matches included. So an
   automaton is as large as a block allows, however many phrases the corpus has.
3. Counts are summed over all blocks, and the threshold is applied to true counts.

Cuts, containment and the ranking are joins and aggregates of the counted phrases.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

DELIMITERS = b".,;:!?\n\x0b\x0c\r"
LEAST, MOST_WORDS, FIRST = 30, 4, 2000  # occurrences and words of a phrase, phrases returned a language
KEPT_SHARE = (80, 100)  # share of a phrase's count from which a longer phrase stands for it
CHARS_A_CELL, LEAST_BITS, MOST_BITS, CHUNK_BITS = 8, 16, 28, 16
BLOCK = 6_000_000  # bytes of text that are scanned by one automaton
SALTS = 64  # parts in which the candidates of a language are cut to the first ones
_DELIMITER = re.compile(b"[" + re.escape(DELIMITERS) + b"]")
_TABLE = bytes.maketrans(DELIMITERS + b"\t", b"\n" * len(DELIMITERS) + b" ")


@dataclass
class Block:
    """The words of some texts of one language, in order."""

    words: list[bytes]
    ids: np.ndarray  # a number for each word, equal for equal words
    first: list[bytes]  # the word of each number
    room: np.ndarray  # words from here to the end of the piece
    cells: list[np.ndarray]  # 64-bit hashes of the phrases of 1, 2, ... words that start here (garbage beyond room)


def split(text: bytes) -> list[list[bytes]]:
    """Words of the pieces of a text, A-Z lower-cased; pieces without words are left out."""
    return [w for p in text.lower().translate(_TABLE).split(b"\n") if (w := p.split())]


def read(language: str, texts: list[bytes]) -> Block:
    words: list[bytes] = []
    lengths: list[int] = []
    for text in texts:
        for piece in split(text):
            words += piece
            lengths.append(len(piece))
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    seed = xxhash.xxh64_intdigest(language.encode())
    single = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
    room = np.repeat(np.cumsum(np.array(lengths, np.int64)), lengths) - np.arange(len(words))
    own = single[ids]
    cells = [own]
    for k in range(1, MOST_WORDS):
        longer = cells[-1].copy()
        longer[: len(own) - k] = (longer[: len(own) - k] ^ (longer[: len(own) - k] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own[k:]
        cells.append(longer)
    return Block(words, ids, list(known), room, cells)


def _cells(block: Block, k: int, bits: int) -> np.ndarray:
    """Sketch cells of the phrases of k + 1 words."""
    h = block.cells[k]
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, about BLOCK bytes at a time in all; longer texts are cut at delimiters."""
    held: defaultdict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for language, whole in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for text in cut(whole):
                if size and size + len(text) > BLOCK:
                    yield from held.items()
                    held.clear()
                    size = 0
                held[language].append(text)
                size += len(text)
    yield from held.items()


def cut(text: bytes) -> Iterator[bytes]:
    """Parts of a text that end at a delimiter, BLOCK bytes and up to the next delimiter each."""
    at = 0
    while len(text) - at > BLOCK and (end := _DELIMITER.search(text, at + BLOCK)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def sketch(texts: DataFrame, bits: int, least: int = LEAST) -> np.ndarray:
    """Bitmap (a byte for eight cells) of the cells whose phrases occur `least` times or more, taken together."""
    chunk = min(CHUNK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = np.zeros(1 << bits, np.uint8), False
        for language, held in blocks(batches):
            block = read(language, held)
            for k in range(MOST_WORDS):
                cells, n = np.unique(_cells(block, k, bits)[block.room > k], return_counts=True)
                counts[cells] = np.minimum(counts[cells] + n, least)
                met = met or len(cells) > 0
        for at in range(1 << (bits - chunk) if met else 0):
            part = counts[at << chunk : (at + 1) << chunk]
            places = np.flatnonzero(part)
            if len(places):
                sparse = places.astype("<u2").tobytes() + part[places].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sparse if 3 * len(places) < len(part) else part.tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(1 << chunk, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["chunk", "heavy"])
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != now:
                    if now >= 0:
                        yield done()
                    now, total = at, np.zeros(1 << chunk, np.int64)
                if len(counts) == 1 << chunk:
                    total += np.frombuffer(counts, np.uint8)
                else:
                    n = len(counts) // 3
                    total[np.frombuffer(counts, "<u2", n)] += np.frombuffer(counts, np.uint8, n, 2 * n)
        if now >= 0:
            yield done()

    parts = texts.mapInArrow(count, "chunk long, counts binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk long, heavy binary")
    heavy = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << chunk) // 8
    for row in parts.toArrow().to_pylist():  # 2 ** bits bits in all
        heavy[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["heavy"], np.uint8)
    return heavy


def candidates(block: Block, heavy: np.ndarray, bits: int) -> list[bytes]:
    """The different phrases of two words or more in a block that no bound of the sketch rules out."""
    found, before, number, v = [], None, block.ids, len(block.first)
    for k in range(MOST_WORDS):
        cells = _cells(block, k, bits)
        passed = (block.room > k) & ((heavy[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 > 0)
        if k:
            passed &= before
            passed[:-1] &= before[1:]
            at = np.flatnonzero(passed)
            _, one, number_at = np.unique(number[at] * v + block.ids[at + k], return_index=True, return_inverse=True)
            number = np.zeros_like(block.ids)
            number[at] = number_at
            found += [b" ".join(block.words[i : i + k + 1]) for i in at[one].tolist()]
        before = passed
    return found


def scan(block: Block, phrases: list[bytes]) -> np.ndarray:
    """Occurrences of each phrase in a block, overlapping ones included."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode()} ", i)
    if not phrases:
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    ends = (np.flatnonzero(block.room == 1) + 1).tolist()
    guarded = b" \n ".join(b" ".join(block.words[a:b]) for a, b in zip([0, *ends], ends))
    hits = np.fromiter((i for _, i in automaton.iter(f" {guarded.decode()} ")), np.int64)
    return np.bincount(hits, minlength=len(phrases))


def counted(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of k words with f >= least, and (lang, n) with all words of a language."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (size // CHARS_A_CELL).bit_length()))
    heavy = sketch(texts, bits, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, held in blocks(batches):
            block = read(language, held)
            if not block.words:
                continue
            phrases = candidates(block, heavy, bits)
            every = block.first + phrases + [b""]
            sizes = [1] * len(block.first) + [p.count(b" ") + 1 for p in phrases] + [0]
            times = np.concatenate([np.bincount(block.ids), scan(block, phrases), [len(block.words)]])
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(every)), pa.array(every).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(times, pa.int64())], ["lang", "phrase", "k", "f"])

    rows = texts.mapInArrow(run, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    rows = materialize(rows.where((F.col("f") >= least) | (F.col("k") == 0)), "phrases")
    return rows.where("k > 0"), rows.where("k = 0").select("lang", F.col("f").alias("n"))


def _joined(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of every phrase of two words or more: its cut of the lowest score, of equal ones the first."""
    words = F.split("phrase", " ")
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select("*", _joined(words, F.lit(1), F.col("cut")).alias("left"), _joined(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, out: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(out))
    both = parts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    score = F.expr(f"(cast(2000000 as decimal(7, 0)) * {wide('a')}) div ({wide('l')} + {wide('r')})")
    least = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.any_value("k").alias("k"), F.any_value("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def inside(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: the greatest count of a longer phrase for each phrase of two words or more inside it."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: _joined(words, s, n))))
    return phrases.where("k > 2").select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score and a descending, phrase ascending.

    A null lang is `und`, as one so named; a null text is empty. A language without
    a phrase of `least` occurrences has no rows. Ties in score and count go by the
    phrase's bytes. Repeated rows count each time; texts of any length are read
    whole; doc_id and other columns play no part, whatever their names. An empty
    table gives an empty result.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    phrases, totals = counted(texts, least)
    share, of = KEPT_SHARE
    found = scored(phrases).join(inside(phrases), ["lang", "phrase"], "left")
    found = found.where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * of < F.col("a").cast("decimal(20,0)") * share))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
