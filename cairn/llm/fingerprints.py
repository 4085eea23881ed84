"""Operator 8, document fingerprints: a threshold-scaled sketch. DataFrame only.

A fingerprint keeps every shingle hash in the lowest ``1 / SCALE`` of the 64-bit range. Whether a
hash is kept depends on the hash alone, so fingerprints merge by union, and the share of one that is
found in another estimates containment between texts of very different sizes.

A text all of whose hashes lie above the threshold would have an empty sketch (a text of n shingles
does so with probability (1 - 1 / SCALE) ** n, 26 % at ten shingles). It keeps its smallest hash
instead, as a stand-in outside the rule, so that short texts can be told apart; a merge drops it as
soon as a hash below the threshold is there. A stand-in says nothing of how much of a text another
holds: where one side has only a stand-in and the other has hashes below the threshold, containment
of the stand-in's text is unknown and given as null by ``containment``, not as 0; ``likeness``, which
the contract wants as a number, counts such a pair as having nothing in common.

Shingles are five words in a row (runs of anything but ASCII white space, A-Z lowered); with fewer
words, the whole sequence. The next document's text comes from a window over buckets of ids: a bucket
also gets the first row of the next one, so its last row finds its neighbour without a global sort.
Buckets are ranges that Spark cuts the ids alone into, ``BUCKETS`` for each of the session's shuffle partitions, and
one small row of each is all that the driver and a broadcast hold: their number is the cluster's width, not the input's
size, and a bucket that is larger than memory is sorted on disk.

Odd rows: a null or empty text, or one of white space alone, has an empty fingerprint, whose likeness
to any other is 1 if that is empty too and else 0; rows of one id follow each other by text; null ids
come first; equal texts have equal fingerprints; a single row is its own next; an empty table gives
an empty result. Ids must be numbers. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bucket_of, text_or_empty

SHINGLE_WORDS = 5
SCALE = 8
#: Buckets for each shuffle partition.
BUCKETS = 2
#: The lowest 64-bit number, and the kept part of the range above it.
LOWEST = -(2**63)
THRESHOLD = LOWEST + 2**64 // SCALE
_A_Z, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, lowered A-Z only."""
    return F.filter(F.split(F.translate(text, _A_Z, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """The hash of every shingle of a word array, in order."""
    n = F.size(words)
    full = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*(words[i + k] for k in range(SHINGLE_WORDS))))
    short = F.array(F.xxhash64(F.concat_ws(" ", words), n))
    return F.when(n >= SHINGLE_WORDS, full).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def kept(hashes: Column) -> Column:
    """The fingerprint out of shingle hashes: sorted and distinct."""
    low = F.filter(hashes, lambda h: h < F.lit(THRESHOLD).cast("long"))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of both texts together."""
    return kept(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts' shingles."""
    common, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, common / either).otherwise(F.lit(1.0)).cast("double")


def stand_in(a: Column) -> Column:
    """Whether a fingerprint is only the smallest hash of a text that has none below the threshold."""
    return (F.size(a) > 0) & (F.array_min(a) >= F.lit(THRESHOLD).cast("long"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for a text without words, null if a is a
    stand-in that b, by its rule, need not have kept."""
    unknown = stand_in(a) & (F.size(b) > 0) & ~stand_in(b)
    return F.when(~unknown, F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))).cast("double")


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "sketch") -> DataFrame:
    """The columns of ``docs`` and the fingerprint of their text as ``name``, in two projections, so
    that the words and the hashes are worked out once."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    staged = docs.select(row, words_of(text_or_empty(text_col)).alias("words")).select("row", shingle_hashes(F.col("words")).alias("hashes"))
    return staged.select("row.*", kept(F.col("hashes")).alias(name))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def id_ranges(rows: DataFrame, ranges: int) -> tuple[bool, list]:
    """Whether there are null ids, and the least id of each of at most ``ranges`` ascending ranges of about as many rows.

    Equal ids share a range. Only the ids are shuffled.
    """
    ids = rows.select("doc_id").repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).select("doc_id", F.spark_partition_id().alias("range"))
    found = ids.groupBy("range").agg(F.max(F.col("doc_id").isNull()).alias("has_null"), F.min("doc_id").alias("low")).collect()  # a row a range
    return any(r["has_null"] for r in found), sorted(r["low"] for r in found if r["low"] is not None)


def with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of (doc_id, text) with sketch, next_text and next_sketch in ascending id; the last row's
    next is the first. A bucket's sentinel is the first row of the next bucket that has any; it comes
    in before the sketches are made, so that each row's is made once."""
    has_null, lows = id_ranges(rows, buckets)
    bounds = lows[1:]  # nulls and the ids of the first range are one bucket
    placed = rows.withColumn("bucket", bucket_of("doc_id", bounds))
    # The first id of each bucket, and the bucket before it (the last one before the first).
    heads = [(None if has_null or not lows else lows[0], len(bounds)), *((low, i) for i, low in enumerate(bounds))]
    heads = rows.sparkSession.createDataFrame(heads, T.StructType([T.StructField("head", rows.schema["doc_id"].dataType), T.StructField("bucket", T.IntegerType())]))
    found = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head"]))  # one row a bucket
    one = Window.partitionBy("doc_id").orderBy("text")  # of rows of one id the first by text
    found = found.withColumn("rank", F.row_number().over(one)).where("rank = 1").drop("rank", "head").withColumn("sentinel", F.lit(1))
    placed = fingerprint(placed.withColumn("sentinel", F.lit(0)).unionByName(found))
    order = Window.partitionBy("bucket").orderBy("sentinel", F.col("doc_id").asc_nulls_first(), "text")
    return (
        placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
        .where("sentinel = 0").drop("bucket", "sentinel")
    )


def fingerprints_with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), buckets)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "sketch", "next_sketch"
    )
    edited = fingerprint(edited, "edited", "edited_sketch")
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )
