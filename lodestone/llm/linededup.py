"""Line deduplication (operator 2), without user functions.

Occurrences of long lines (two 64-bit hashes of the line's key, document,
position) are range-partitioned by hash with a secondary sort by document, the
largest first, and position; running window functions over that order stream
the document that a line's first occurrences come from and count the documents.
A line kept by enough documents loses its occurrences elsewhere. What goes back
to the texts is a sparse bitmap of 64-bit words for each document that loses
lines, and no text.

Keys of many occurrences (more than HOT_ROWS, or HOT_SHARE of all, as a sample
tells; a matter of balance, not of results) do not enter the sort: their totals
come from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.native import STRIPPED, ascii_lower
from lodestone.storage import materialize

HOT_ROWS, HOT_SHARE = 200_000, 1 / 2048  # occurrences of a key, whichever is less, beyond which it is hot
SAMPLED = 20_000_000  # occurrences (about) of the sample, at most


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, h1, h2 for every line whose key has min_chars code points."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("doc_id", "th", "pos", F.trim("line", F.lit(STRIPPED)).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    return keys.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(found: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, th, pos of the occurrences to drop."""
    n = found.count()
    share = min(0.05, max(SAMPLED / max(n, 1), 100 / HOT_ROWS))
    hot = materialize(found.sample(share, 11).groupBy("h1").count().where(F.col("count") > max(20, share * min(HOT_ROWS, HOT_SHARE * n))).select("h1"), "hot")
    by_key = Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("doc_id"), "pos")
    stream = (
        found.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2")
        .withColumn("keeper", F.first("doc_id").over(by_key))
        .withColumn("rank", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("doc_id"))))
        .withColumn("n_docs", F.max("rank").over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    drops = [stream.where(F.col("n_docs") >= min_docs)]
    if not hot.isEmpty():
        often = found.join(hot, "h1", "left_semi")
        once = often.select("h1", "h2", "doc_id").distinct()
        totals = once.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        drops.append(often.join(totals, ["h1", "h2"]))
    return _union([d.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "th", "pos") for d in drops])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bitmaps(drops: DataFrame) -> DataFrame:
    """doc_id, th, dropped: map of word number to the 64 bits of lines 64 * number and on; words without a bit are left out."""
    bits = drops.groupBy("doc_id", "th", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits"))
    return bits.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _dropped(bitmap: Column, pos: Column) -> Column:
    word = F.coalesce(F.try_element_at(bitmap, F.shiftright(pos, 6)), F.lit(0).cast("long"))
    return F.getbit(word, pos % 64) == 1


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, th, dropped for the documents that lose lines."""
    return bitmaps(dropped_lines(materialize(occurrences(docs, min_chars), "lines"), min_docs))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: bool = True) -> DataFrame:
    """All columns of docs with text (less its dropped lines), and n_lines, n_dropped if counts.

    Lines are what line feeds separate; a null or empty text has one empty line
    and becomes or stays empty. A key is a line stripped of white space at both
    ends with A-Z lower-cased; keys of min_chars code points in at least min_docs
    different doc_ids stay in the largest of these only, with all their lines
    there. Rows with the same doc_id count as one document, a null doc_id as the
    smallest; repeated rows are treated alike and all returned. The columns
    n_lines and n_dropped replace others of these names. An empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    left = (docs.drop("n_lines", "n_dropped") if counts else docs).withColumn("text", text).alias("d")
    marks = keep_bitmaps(docs, min_chars, min_docs).alias("m")
    joined = left.join(marks, F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.th")), "left")
    dropped, lines = F.col("m.dropped"), F.split(F.col("d.text"), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~_dropped(dropped, i)), "\n")
    count = F.aggregate(F.map_values(dropped), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    columns = [F.when(dropped.isNull(), F.col("d.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in left.columns]
    if not counts:
        return joined.select(*columns)
    return joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(count, F.lit(0).cast("long")).alias("n_dropped"))
