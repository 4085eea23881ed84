"""The corpus pipeline: quality filter, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and rereads it as the next stage's docs. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, stored
from cairn.llm.near_dedup import near_duplicates
from cairn.llm.packing import pack_documents
from cairn.llm.quality import score_quality, train_quality
from cairn.llm.secrets import redact, scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of the documents it is given."""
    net = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, net, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    # Rows without an id are linked with nothing and stay.
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind in brackets, n_chars counted anew."""
    scanned = redact(scan_secrets(docs, keep=COLUMNS, with_text=True), "clean")
    clean = F.when(F.col("text").isNotNull(), F.col("clean")).alias("text")
    n_chars = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return scanned.select("doc_id", clean, "lang", "source", n_chars)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, with their token ids, in full sequences that hold the corpus's mixture of sources over every window."""
    return pack_documents(docs, with_ids=True)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("secrets", secret_redaction), ("packing", packing)]

#: SQL cannot express the stages (a trained network, minhash, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
