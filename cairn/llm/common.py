"""Shared plumbing of the training-data operators: reading, shared storage, Arrow batches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bound of one Arrow batch sent to a Python worker, so that very long texts cannot fill it; small,
#: as a worker shares an executor's memory with sorts and shuffles.
BATCH_BYTES = 2 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a cluster's warehouse is taken, which they share as well; only a
    local session (one JVM, as in tests) gets a temporary folder of this machine, kept for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.cairn.scratch", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cairn-scratch"
        spark.conf.set("spark.cairn.scratch", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows; a tighter setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    try:
        if now is None or int(now.rstrip("b")) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except ValueError:  # given with a unit: the user's own choice
        pass


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: T.StructType,
) -> DataFrame:
    """``mapInArrow`` over a projection; ``make`` runs once per task and returns the batch function.

    An empty batch yields nothing, so an empty table gives an empty result of the stated schema.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                yield work(batch)

    return df.select(*columns).mapInArrow(run, schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unsigned_crc(column):
    """CRC-32 of the UTF-8 bytes, 0 .. 2^32 - 1."""
    return F.crc32(column.cast("binary"))


def bucket_of(column: str, bounds: list):
    """The number of bounds that are at most the value: bucket order is value order; nulls are first.

    The bounds stand in groups of about the square root of their number, as one folded literal: a
    row is held against the groups' first bounds, then against one group.
    """
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    kind = "bigint" if all(isinstance(b, int) for b in bounds) else "double"
    table = F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")
    value = F.col(column)
    group = F.size(F.filter(F.transform(table, lambda g: g[0]), lambda b: b <= value)) - 1
    inside = F.size(F.filter(F.element_at(table, group + 1), lambda b: b <= value))
    return F.when(value.isNull() | (group < 0), F.lit(0)).otherwise(group * F.lit(wide) + inside).cast("int")
