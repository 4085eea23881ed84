"""The opN_ queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.bpe import bpe_round_trip
from cairn.llm.codes import compress
from cairn.llm.common import read_table, shared_path
from cairn.llm.fingerprints import fingerprints_with_neighbours
from cairn.llm.importance import resample
from cairn.llm.media import media_features, write_media_column
from cairn.llm.multi_index import nearest_rows
from cairn.llm.near_dedup import near_duplicates
from cairn.llm.oracle import near_dedup_sql, resampling_sql, secret_scan_sql, vector_codes_sql
from cairn.llm.packing import pack_documents
from cairn.llm.quality import held_out, score_quality, train_quality
from cairn.llm.secrets import digest, scan_secrets
from cairn.llm.sharding import shard_documents
from cairn.llm.token_counts import token_counts
from cairn.llm.token_store import read_store, write_store


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every document; a null or empty text has none."""
    return token_counts(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a net that learns from labels of rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    net = train_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, net)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document; a null text has none."""
    return digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, CRC, shard and slot of every document in 40 shards under the law ``bytes``; equal texts stay together where a shard can hold them."""
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept of every document; one without words is linked with nothing and kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of what they decode to, of every document."""
    return bpe_round_trip(read_table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and CRC of the ids of every document, from the files of a store that is written first; damaged files raise an error."""
    path = shared_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text."""
    return fingerprints_with_neighbours(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1,024 tokens; every window of 64 of them holds the sources in their shares."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored container of every text says, read back by its own tables."""
    return media_features(write_media_column(read_table(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every kept vector, the errors of its label and the digest of the codebooks."""
    return compress(read_table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, drawn towards the texts of ``benchmark``; rank is null for those not drawn."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors found nearest, by inner product, to each one whose id is divisible by 20."""
    return nearest_rows(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality": op2_quality,
        "op3_secret_scan": op3_secret_scan,
        "op4_sharding": op4_sharding,
        "op5_near_dedup": op5_near_dedup,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_token_store": op7_token_store,
        "op8_fingerprints": op8_fingerprints,
        "op9_packing": op9_packing,
        "op10_media": op10_media,
        "op11_vector_codes": op11_vector_codes,
        "op12_resampling": op12_resampling,
        "op13_neighbours": op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    """The others need a trained net, a tokenizer, a 64-bit hash, a greedy placement or an index that may
    miss; tests hold them against brute force, exact round trips, held-out labels or measured recall."""
    return {"op3_secret_scan": secret_scan_sql(), "op5_near_dedup": near_dedup_sql(), "op11_vector_codes": vector_codes_sql(), "op12_resampling": resampling_sql()}
