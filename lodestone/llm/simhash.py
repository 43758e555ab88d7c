"""SimHash near-duplicates by multi-index hashing (operator 4).

A fingerprint is cut into SEGMENTS. Of two fingerprints within the radius, one
segment at least differs in no more than radius / SEGMENTS bits. A table holds
every distinct fingerprint under the value of each of its segments; around each
segment the small Hamming ball is enumerated, its values are looked up in the
table, and complete distances are verified. A ball of one bit is searched from
the fingerprint that has the bit unset, so that no pair is met from both sides.

Values that more than HOT fingerprints share are not compared in pairs. The
fingerprints that meet there enter a table under every whole key within half the
radius: two of one key are within the radius of each other, and two within the
radius have a key in common, so each is tied to the least of its key. Links grow
with the fingerprints and never with the square of a group, and none is lost.
Every table here grows with the documents, so joins sort and none is broadcast.
Components follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.native import fresh
from lodestone.operators.components import connected_components
from lodestone.storage import materialize

CHUNK = 1 << 16  # shingles whose bits are counted at once
SEGMENTS = 2
HOT = 64  # fingerprints of one segment value that are compared in pairs


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles, A-Z lower-cased; bit set if set in over half of the hashes; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    parts = [b" ".join(x) for x in zip(*(w[i:] for i in range(shingle)))] if len(w) >= shingle else [b" ".join(w)]
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(parts), CHUNK):
        h = np.array([digest(p, 42) for p in parts[i : i + CHUNK]], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp (64 bits as a signed number) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t or b"", shingle) for t in texts], pa.int64())], ["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(run, "doc_id long, th long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def ball_masks(width: int, bits: int) -> list[int]:
    """Changes of at most `bits` of the low `width` bits, none first, as signed numbers."""
    masks = [sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(width), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


def tied(prints: DataFrame, radius: int) -> DataFrame:
    """u < v: links that give the same components as all pairs within radius, by whole keys within half the radius."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(64, radius // 2)])
    table = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("entry"))
    least = table.groupBy("entry").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).where("u < most").drop("most")
    near = table.join(least.hint("merge"), "entry").where((F.col("u") < F.col("fp")) & (_distance("u", "fp") <= radius))
    return near.select("u", F.col("fp").alias("v"))


def links(prints: DataFrame, radius: int = 2, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """u < v: links between distinct fingerprints of column fp that give the same components as all pairs within radius."""
    if radius not in (0, 2, 4) or segments not in (1, 2, 4, 8):
        raise ValueError("radius must be 0, 2 or 4, segments 1, 2, 4 or 8")
    width, ball = 64 // segments, radius // segments
    low = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    parts = F.array(*[F.shiftrightunsigned("fp", s * width).bitwiseAND(low) for s in range(segments)])
    own = prints.select("fp", F.posexplode(parts).alias("segment", "value"))
    held = materialize(own.groupBy("segment", "value").agg(F.count("*").alias("n")), "segments")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(width, ball)[1:]]).cast("array<bigint>")
    upward = lambda m: (F.col("value").bitwiseAND(m) == 0) | (F.bit_count(m) > 1)
    probes = own.select("fp", "segment", F.explode(F.transform(F.filter(masks, upward), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    met = materialize(probes.join(held.hint("merge"), ["segment", "value"]), "met")
    wanted = met.select("segment", "value", "n").unionByName(held.where("n > 1")).distinct()
    owners = materialize(own.join(wanted.hint("merge"), ["segment", "value"]), "owners")
    members = met.unionByName(owners)
    pairs = members.where(F.col("n") <= hot).join(owners.select("segment", "value", F.col("fp").alias("v")).hint("merge"), ["segment", "value"])
    near = pairs.where((F.col("fp") != F.col("v")) & (_distance("fp", "v") <= radius)).select(F.least("fp", "v").alias("u"), F.greatest("fp", "v").alias("v"))
    return near.unionByName(tied(members.where(F.col("n") > hot).select("fp").distinct(), radius)).distinct()


def labelled(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, th, fp, component (a fingerprint), component_id of every row."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    parts = connected_components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = prints.join(parts.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    grouped = materialize(grouped, "groups")
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(grouped.join(least.hint("merge"), "component").select("fp", "component", "component_id").hint("merge"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and are linked like others, as are
    texts of fewer words than a shingle, which hash as a whole. Equal fingerprints
    are one node, so copies cost nothing. Rows with a null doc_id take part; their
    component is null if it has no other doc_id. Repeated rows repeat; texts of
    any length are read whole; other columns play no part. An empty table gives an
    empty result.
    """
    found = labelled(docs, shingle, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each component of labels (doc_id, th, component): the smallest doc_id (null last), then hash of the text."""
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th")
    rows = labels.groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    keep = materialize(rows.groupBy("component").agg(F.min(F.struct(place.alias("at"), "n")).alias("k")).select("k.at.doc_id", "k.at.th", "k.n"), "kept")
    th, again = fresh(docs, "th"), fresh(docs, "again")
    marked = docs.withColumn(th, text_hash())
    kept = marked.join(keep.alias("k"), marked["doc_id"].cast("long").eqNullSafe(F.col("k.doc_id")) & (marked[th] == F.col("k.th")), "left_semi")
    if not keep.where("n > 1").isEmpty():  # rows that repeat both doc_id and text
        kept = kept.withColumn(again, F.row_number().over(Window.partitionBy("doc_id", th).orderBy("doc_id"))).where(F.col(again) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of docs for each component: the smallest doc_id (null last), then hash of the text.

    Columns stay as they are, whatever their names; null and empty texts are one
    component; of repeated rows one stays. An empty table stays empty.
    """
    return keep_least(docs, labelled(docs, shingle, radius))
