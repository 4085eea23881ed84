"""Operator 4, sharding: vector bin packing of groups of equal texts over (bytes, tokens, rows).

The law that holds is ``bytes``: shard sizes are near equal. Equal texts form a group, and groups are
placed whole. A group above ``1 / (shards * FINENESS)`` of all bytes or of all rows has a bucket of
its own; there can be only ``2 * shards * FINENESS`` of these. All other groups are hashed into
``BUCKETS`` buckets by their text. What a task has to number is kept small: a large group is dealt out
by row into pieces below that limit. They go to one shard together; only a group above a whole
shard's share of bytes or rows, which no shard could take, parts. So the number of pieces is bounded,
whatever the input, and so is all that reaches the driver. There buckets are taken from large to
small, and each goes to the shard whose residual capacity has the largest dot product with it.

Slots: a piece's first slot is the number of rows placed before it in its shard (on the driver), and
rows are numbered within their piece, so no task sees a whole shard.

Odd rows: a null text has size 16 and crc 0 and meets the empty texts; repeated rows each get a slot
of their own; null ids are placed like any others; an empty table gives an empty result. Only the id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import stored, text_or_empty, unsigned_crc

BUCKETS = 8192
FINENESS = 8
#: Weight of bytes, tokens and rows in the dot product.
WEIGHTS = (1.0, 0.15, 0.15)


def place(sizes: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """A shard for each piece (rows of ``sizes``: bytes, tokens, rows), largest bytes first.

    Sizes and capacities are shares of the totals. A shard's residual capacity may fall below zero;
    then it is merely less fit than the others. Ties go to the lowest shard.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    share = sizes / np.maximum(sizes.sum(axis=0), 1)
    residual = np.full((shards, share.shape[1]), 1.0 / shards)
    where = np.zeros(len(sizes), np.int64)
    scale = np.array(weights)
    for i in np.lexsort((np.arange(len(sizes)), *(-share.T[::-1]))):
        where[i] = int((residual @ (share[i] * scale)).argmax())
        residual[where[i]] -= share[i]
    return where


def shard_documents(docs: DataFrame, *, shards: int = 40, text_col: str = "text", id_col: str = "doc_id", overhead: int = 16) -> DataFrame:
    """id, size, text_crc32, n_tokens, law, shard, slot, grown_shard of every row."""
    text = F.col("text")
    measured = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).select(
        id_col, (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), unsigned_crc(text).alias("text_crc32"),
        (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long").alias("n_tokens"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(measured, "shard-rows")
    spark = docs.sparkSession

    # A group is known by two hashes of its text and its size.
    key = ["group", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size"))
    totals = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    limits = {c: max(1, totals[c] // (shards * FINENESS)) for c in ("bytes", "n")}
    large = groups.where((F.col("bytes") > limits["bytes"]) | (F.col("n") > limits["n"])).orderBy(*key).collect()  # 2 * shards * FINENESS at most
    own, torn = [], set()
    for bucket, r in enumerate(large, BUCKETS):
        own.append((*(r[k] for k in key), bucket, max(-(-r[c] // limits[c]) for c in limits)))
        if any(r[c] > -(-totals[c] // shards) for c in limits):
            torn.add(bucket)
    alone = spark.createDataFrame(own or [(0, -1, -1, 0, 1)], "group long, text_crc32 long, size long, large int, parts long")
    pieces = (
        rows.join(F.broadcast(alone), key, "left")
        .withColumn("bucket", F.coalesce("large", F.pmod("group", F.lit(BUCKETS)).cast("int")))
        .withColumn("piece", F.coalesce(F.pmod("row", "parts"), F.lit(0)).cast("int"))
    )
    found = (
        pieces.groupBy("bucket", "piece").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        .orderBy("bucket", "piece").collect()
    )
    # The pieces of a group go to one shard together, unless no shard could take them.
    together: dict[tuple, list] = {}
    for r in found:
        together.setdefault((r["bucket"], r["piece"] if r["bucket"] in torn else -1), []).append(r)
    sizes = [[sum(r[c] for r in rows_) for c in ("size", "tokens", "n")] for rows_ in together.values()]
    where = place(np.array(sizes, np.float64).reshape(-1, 3), shards)
    first, placed = np.zeros(shards, np.int64), []
    for rows_, shard in zip(together.values(), where.tolist(), strict=True):
        for r in rows_:
            placed.append((r["bucket"], r["piece"], shard, int(first[shard])))
            first[shard] += r["n"]
    plan = spark.createDataFrame(placed or [(-1, 0, 0, 0)], "bucket int, piece int, shard int, first_slot long")
    in_piece = Window.partitionBy("bucket", "piece").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size", "row")
    return (
        pieces.withColumn("at", F.row_number().over(in_piece) - 1)
        .join(F.broadcast(plan), ["bucket", "piece"])
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
        )
    )
