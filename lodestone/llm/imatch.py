"""I-Match fingerprints with randomised lexicons (operator 6), without user functions.

Document frequencies are counted over all documents. The lexicon is the terms
whose share of documents lies in a band, BAND; since the shares of all terms add
up to the mean number of distinct terms of a document, at most that mean
divided by the band's lower end can qualify (200 times that mean), however large the
corpus is, and the lexicon can be sent to every executor. It is laid out as a
two-probe hash table in one array, so that a look-up costs the same for any size.

A fingerprint is the signatures of SUBSETS random subsets of the lexicon, each
a hash of the document's sorted distinct terms in it. Subsets of several rates
leave few terms of short as of long documents; likeness is the share of equal
signatures among those that are empty in neither or in one only. A text without a
term of the lexicon has a hash of its own in place of the first signature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.native import bucket_of, let

BAND = (0.005, 0.3)  # least and largest share of documents
BROADCAST = 1_000_000  # buckets up to which their first documents (12 bytes each) are broadcast
BUCKET_ROWS = 50_000  # documents of a bucket at which more buckets than tasks are made
RATES = [8, 16, 32, 64, 128, 256]  # a subset holds one in so many terms of the lexicon
SUBSETS = 48
EMPTY = "00000000"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: lower-cased runs of letters and digits."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Hashes of the terms whose share of all documents lies in the band, and that two documents hold at least."""
    each = docs.select(terms(F.col("text")).alias("t"))
    counted = each.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rows = docs.count()
    least = max(2, band[0] * rows)  # a term of one document says nothing of others
    return counted.where((F.col("n") >= least) & (F.col("n") <= max(band[1] * rows, 1))).select("term").toArrow()["term"].to_pylist()


def hash_table(keys: list[int]) -> np.ndarray:
    """Array of a power of two in which a key stands at one of two places given by its bits (cuckoo hashing); free places hold a value that stands nowhere else."""
    bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
    while True:
        size, table = 1 << bits, {}
        for key in keys:
            at = key & (size - 1)
            for _ in range(200):
                key, held = table.get(at), key
                table[at] = held
                if key is None:
                    break
                one, two = key & (size - 1), key >> 32 & (size - 1)
                at = two if at == one else one
            else:
                break
        else:
            out = np.zeros(size, np.int64)
            # A free place holds a number whose two places are others, so that it matches no look-up.
            for at in range(size):
                out[at] = table.get(at, at ^ 1 | (at ^ 1) << 32)
            return out
        bits += 1


def lexicon_table(keys: list[int]) -> Column:
    """The hash table as a constant: an expression of one string, which the optimizer folds once."""
    return F.split(F.lit(",".join(map(str, hash_table(keys).tolist()))), ",").cast("array<long>")


def signatures(text: Column, table: Column, size: int) -> Column:
    """The fingerprint of a text: 8 hex digits for each subset, EMPTY for one without terms."""
    mask = F.lit(size - 1).cast("long")
    held = lambda slots, h: (F.get(slots, h.bitwiseAND(mask).cast("int")) == h) | (F.get(slots, F.shiftright(h, 32).bitwiseAND(mask).cast("int")) == h)
    inside = let(table, lambda slots: F.array_sort(F.filter(terms(text), lambda h: held(slots, h))))

    masks = F.array(*[F.lit(RATES[k % len(RATES)] - 1).cast("long") for k in range(SUBSETS)])
    digits = lambda p: F.when(F.size(p) == 0, F.lit(EMPTY)).otherwise(F.lower(F.lpad(F.hex(F.greatest(F.xxhash64(p).bitwiseAND(0xFFFFFFFF), F.lit(1).cast("long"))), 8, "0")))
    one = lambda kept, k: let(F.filter(kept, lambda h: F.xxhash64(k, h).bitwiseAND(F.get(masks, k)) == 0), digits)
    alone = F.rpad(digits(F.array(F.coalesce(text, F.lit("")))), 8 * SUBSETS, "0")
    each = lambda kept: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: one(kept, k)), "")
    return let(inside, lambda kept: F.when(F.size(kept) == 0, alone).otherwise(each(kept)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures, 0 to 1; 1 for equal fingerprints."""
    part = lambda x, k: F.substring(x, k * 8 + 1, F.lit(8))
    count = lambda test: F.size(F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: test(part(a, k), part(b, k))))
    same, used = count(lambda x, y: (x == y) & (x != EMPTY)), count(lambda x, y: (x != EMPTY) | (y != EMPTY))
    return F.when(a == b, F.lit(1.0)).otherwise(same / F.greatest(used, F.lit(1)))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, fingerprint of every row; equal texts have equal fingerprints, a null text that of the empty one."""
    keys = lexicon(docs, band)
    return docs.select(F.col("doc_id").cast("long"), signatures(F.col("text"), lexicon_table(keys), len(hash_table(keys))).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is that of the next smaller doc_id, after the last the
    first; rows with equal doc_id follow by a hash of their text, null doc_ids
    come last, and a table of one row is its own next. A null text counts as
    empty. An empty table gives an empty result.

    Documents go to buckets of consecutive doc_ids (borders are quantiles); the
    first document of a bucket is sent along to the bucket before it as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keys = lexicon(docs, band)
    table, size = lexicon_table(keys), len(hash_table(keys))
    n_rows = rows.count()
    buckets = max(1, min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // BUCKET_ROWS), n_rows))
    one_in = max(1, n_rows // (8 * buckets))
    sampled = np.sort(rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").toArrow()["doc_id"].to_numpy())
    bounds = np.unique(sampled[np.arange(1, buckets) * len(sampled) // buckets]).tolist() if len(sampled) else []
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    firsts = sorted(rows.groupBy("bucket").agg(F.max("doc_id")).collect())  # a row for each bucket
    # The first documents of a bucket go to the next higher bucket too, those of the highest to the lowest.
    sends = spark.createDataFrame([(first, firsts[(i + 1) % len(firsts)][0]) for i, (_, first) in enumerate(firsts)], "first long, target int")
    sends = F.broadcast(sends) if len(firsts) <= BROADCAST else sends
    rows = rows.join(sends, F.col("doc_id").eqNullSafe(F.col("first")), "left").drop("first")
    marked = rows.withColumn("fingerprint", signatures(F.col("text"), table, size))
    sent = marked.withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("ghost"))))))).drop("bucket", "target").select("*", "to.*").drop("to")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    nexts = sent.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where("ghost = 0")
    n = F.char_length("text")
    third = (n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    both = nexts.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = both.select("*", signatures(F.col("edited"), table, size).alias("edited_fingerprint"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
