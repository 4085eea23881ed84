"""Freshness: new files by a stream, edits and deletions by comparing fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import shared_path, stored


def refresh(spark: SparkSession, folder: str, pattern: str, schema, sink: str, checkpoint: str, build, files: int = 64) -> None:
    """Bring ``sink`` up to date with the files that came to a folder since ``checkpoint`` was written.

    Each micro-batch of new files is turned into rows by ``build`` and written as a part named after the
    batch, so a batch that is run again after a failure replaces its own part and no other. Nothing is
    gathered on the driver.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_totals(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Counts and sums of each event type over the files of a folder that match, read as a file stream: each
    micro-batch leaves its partial sums, and these are summed."""
    root = shared_path(spark, "stream")
    parts = lambda batch: batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).alias("total"))
    refresh(spark, folder, pattern, schema, f"{root}/parts", f"{root}/checkpoint", parts)
    return spark.read.parquet(f"{root}/parts").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def windowed_counts(stream: DataFrame, minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """Tumbling windows with a watermark, for an event-time stream of (ts, event_type)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").count()


def tree_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Files, bytes and modification times of a tree, by directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.sum(F.unix_micros("modificationTime")).alias("stamp"))


def stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """Directories that differ between two fingerprints: added, removed or edited."""
    old, new = (d.select("directory", F.struct("n_files", "bytes", "stamp").alias(n)) for d, n in ((before, "old"), (now, "new")))
    return old.join(new, "directory", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("directory")


# Following a tree with its edits and deletions.
#
# A followed sink has three folders. ``data/version=N`` has the rows of the files that version N added or
# edited, ``changes/version=N`` a row for each file that it added, edited or deleted, and ``commits`` one row, in one file, for
# each version that is whole. What is not committed counts for nothing: a run that dies before that leaves
# the sink as it was, and the next one writes the same version again.

#: Spark's condition for a file that was listed and is gone.
_GONE = "FAILED_READ_FILE.FILE_NOT_EXIST"


def listing(spark: SparkSession, folders: list[str], pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below some folders, those of display names among them; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
    trees = [read.load(f).select("path", "length", F.unix_micros("modificationTime").alias("modified")) for f in folders]
    return reduce(DataFrame.unionByName, trees).distinct()


def _versions(spark: SparkSession, sink: str) -> list[int]:
    try:
        return sorted(r["version"] for r in spark.read.schema("version int").parquet(f"{sink}/commits").distinct().collect())  # one row a version
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def followed_files(spark: SparkSession, sink: str) -> DataFrame | None:
    """(path, length, modified, version) of the files that the sink has; ``version`` is the one that wrote a file's rows. None for a new sink."""
    versions = _versions(spark, sink)
    if not versions:
        return None
    changes = spark.read.parquet(*(f"{sink}/changes/version={v}" for v in versions))
    last = changes.groupBy("path").agg(F.max_by(F.struct("length", "modified", "version", "state"), "version").alias("c")).select("path", "c.*")
    return last.where("state <> 'deleted'").drop("state")


def differences(known: DataFrame | None, now: DataFrame) -> DataFrame:
    """(path, length, modified, state) of the files that were added, edited (by size or time) or deleted since."""
    if known is None:
        return now.select("path", "length", "modified", F.lit("added").alias("state"))
    old, new = known.select("path", F.struct("length", "modified").alias("old")), now.select("path", F.struct("length", "modified").alias("new"))
    both = old.join(new, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("edited")
    return both.select("path", "new.length", "new.modified", state.alias("state"))


def follow(now: DataFrame, sink: str, build: Callable[[DataFrame], DataFrame]) -> int | None:
    """Bring the sink to what ``now`` (path, length, modified) lists; gives the version written, none if nothing differs.

    ``build`` makes rows, with their ``path``, of the files that are new or edited; no other is read. Deleted
    files leave a row in ``changes`` that hides what they had.
    """
    spark = now.sparkSession
    version = max(_versions(spark, sink), default=0) + 1
    # Worked out once: the tree may change while its files are read.
    delta = stored(differences(followed_files(spark, sink), now).withColumn("version", F.lit(version)), "differences")
    if delta.isEmpty():
        return None
    build(delta.where("state <> 'deleted'").select("path")).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{sink}/data/version={version}")
    delta.write.mode("overwrite").parquet(f"{sink}/changes/version={version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{sink}/commits")
    return version


def followed(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of all files that are there, each from the version that wrote them last."""
    versions = _versions(spark, sink)
    if not versions:
        raise ValueError(f"nothing was ever written to {sink}")
    rows = spark.read.parquet(*(f"{sink}/data/version={v}" for v in versions))
    return rows.join(followed_files(spark, sink).select("path", "version"), ["path", "version"], "left_semi").drop("version")


def follow_stream(clock: DataFrame, folders: list[str], sink: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, seconds: int = 2):
    """A running query that looks at the folders at each micro-batch of ``clock`` (a rate stream, say) and follows them.

    A file that goes away while it is read stops that look, of which nothing is committed; the next one no longer lists it.
    """

    def look(batch: DataFrame, _: int) -> None:
        try:
            follow(listing(batch.sparkSession, folders), sink, build)
        except (Py4JJavaError, PySparkException) as problem:
            if _GONE not in str(problem):
                raise

    return clock.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
