"""Operator 12, target-distribution importance resampling over a dictionary of distinct features.

Features are the runs of ``least`` to ``most`` consecutive words of a whole text, counted once for
each document. The dictionary has one row for each distinct feature of corpus and target, with its
number in both; there its bucket is worked out, once. Buckets sum the dictionary, gains are a row
for each bucket, and each feature gets its bucket's gain. Gains are then joined back to the documents'
counts: features that make up a 65,536-th of all features or more (at most so many, proven by their
share) by broadcast, the rare ones by a shuffle on the feature. So frequent words are never shuffled and no
rare one can fill a task. A document's gains are summed task by task before they meet.

A feature of more than ``LONGEST`` bytes goes by its SHA-256 and its CRC, worked out where it is
counted, so that no shuffle or broadcast carries long strings.

The draw adds Gumbel noise, a hash of seed and id, and takes the highest scores: rows are sorted by
ranges and numbered inside each range, and only the ranges' row counts (one number a partition) reach
the driver.

Odd rows: a null or empty text, or one without words, has no features and weight 0; a null id hashes as
an empty one, ranks behind equal scores and is otherwise a row like any other; repeated rows each count, and each can be
drawn; without any target features all gains follow the formula. An empty corpus gives an empty result.
Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import map_rows, stored
from cairn.llm.vectors import join_weighted

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: A feature that at least this share of all features makes up is frequent.
FREQUENT = 65_536
#: Bytes of a feature that is joined by itself; no feature begins with MARK.
LONGEST, MARK = 128, b" "
#: A-Z become a-z; 0-9, a-z and all bytes of other than ASCII characters stay; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_counts(text: str | None, least: int, most: int) -> tuple[int, Counter]:
    """Number of words, and of each feature, as UTF-8 bytes."""
    words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
    found: Counter = Counter()
    for n in range(least, most + 1):
        found.update(words if n == 1 else (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
    return len(words), found


def key_of(feature: bytes) -> bytes:
    """What a feature is joined by: itself or, if it is long, its SHA-256 and CRC."""
    return feature if len(feature) <= LONGEST else MARK + f"{hashlib.sha256(feature).hexdigest()} {zlib.crc32(feature)}".encode()


def bucket(key, buckets: int):
    """CRC of a feature's bytes, modulo ``buckets``; a long one's is part of its key."""
    long_crc = F.substring_index(key, " ", -1).cast("long")
    return F.when(F.startswith(key, F.lit(MARK.decode())), long_crc).otherwise(F.crc32(key.cast("binary"))) % buckets


def counted(texts: DataFrame, least: int, most: int) -> DataFrame:
    """row, doc_id, n_words, n_features, features (arrays of keys and numbers) of every row; ``texts`` has row, doc_id, text."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, total, keys, numbers = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, found = feature_counts(text, least, most)
                words.append(n)
                total.append(found.total())
                keys.append([key_of(f).decode() for f in found])
                numbers.append(list(found.values()))
            arrays = [batch.column("row"), batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(total, pa.int64()), pa.array(keys, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_words", "n_features", "keys", "numbers"])

        return work

    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_rows(texts, ["row", "doc_id", "text"], make, f"row long, doc_id {kind}, n_words long, n_features long, keys array<string>, numbers array<long>")


def exploded(counts: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("keys", "numbers")).alias("p")
    return counts.select("row", pairs).select("row", F.col("p.keys").alias("key"), F.col("p.numbers").alias("number"))


def dictionary(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """key, in_corpus, in_target, bucket of every distinct feature."""
    zero = F.lit(0).cast("long")
    both = corpus.select("key", F.col("number").alias("c"), zero.alias("t")).unionByName(target.select("key", zero.alias("c"), F.col("number").alias("t")))
    return both.groupBy("key").agg(F.sum("c").alias("in_corpus"), F.sum("t").alias("in_target")).withColumn("bucket", bucket(F.col("key"), buckets))


def gains(words: DataFrame, buckets: int, corpus_total: int, target_total: int) -> DataFrame:
    """bucket, gain: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket in use, ``buckets`` rows at most."""
    ratio = (F.col("t") + 1).cast("double") * (corpus_total + buckets) / ((F.col("s") + 1).cast("double") * (target_total + buckets))
    return words.groupBy("bucket").agg(F.sum("in_corpus").alias("s"), F.sum("in_target").alias("t")).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(seed: str):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, most: int) -> DataFrame:
    """``scored`` (stored) with ``rank``: 1, 2, 3... for the ``most`` highest scores, ties to smaller ids; null for the others."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.desc("n_features")]
    sorted_rows = scored.where("eligible").repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the row's place in it below.
    placed = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "resampling-sorted")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").withColumn("rank", F.when(place <= most, place))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where("not eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` is null for those not drawn. ``target`` has a ``text``."""
    counts = stored(counted(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")), least, most), "resampling-counts")
    aim = stored(counted(target.select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text")), least, most), "resampling-target")
    each = exploded(counts)
    words = stored(dictionary(each, exploded(aim), buckets), "resampling-dictionary")
    totals = words.agg(F.coalesce(F.sum("in_corpus"), F.lit(0)), F.coalesce(F.sum("in_target"), F.lit(0))).first()
    by_bucket = F.broadcast(gains(words, buckets, *totals))  # ``buckets`` rows
    gained = stored(words.where("in_corpus > 0").join(by_bucket, "bucket").select("key", "gain", "in_corpus"), "resampling-gains")
    sums = join_weighted(each, gained, ["key"], "in_corpus", totals[0], FREQUENT).groupBy("row").agg(F.sum(F.col("gain") * F.col("number")).alias("weight"))
    rows = counts.select("row", "doc_id", "n_words", "n_features").join(sums, "row", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    scored = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    scored = stored(scored, "resampling-scored")
    n = scored.where("eligible").count()
    return drawn(scored, percent * n // 100).drop("eligible")
