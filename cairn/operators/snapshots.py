"""Snapshots of a rule corpus: line endings, manifests, verification, installation, status cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.parse import nodes, round_trip, tokens
from cairn.operators.textsearch import snapshot_diff


def line_endings(text: Column) -> Column:
    """crlf, lf, cr, mixed or none."""
    crlf, lf, cr = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("(?<!\r)\n")), F.regexp_count(text, F.lit("\r(?!\n)"))
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("cr")


def line_count(text: Column) -> Column:
    """Lines of a text; an end of line at the very end begins none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")) - F.when(text.rlike("[\r\n]$"), 1).otherwise(0))


def manifest_of(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Number, bytes, lines and a digest of each snapshot (or group): the digest is the sum of the files' own,
    as 64-bit numbers, so it needs no order and no one task sees all files."""
    own = F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", F.regexp_replace("content", "\r\n", "\n")), 256), 1, 12), 16, 10).cast("bigint")
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("bytes"), F.sum(line_count(F.col("content"))).alias("n_lines"), F.sum(own).cast("decimal(38,0)").cast("string").alias("digest"))


def changed_paths(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(state, n, paths) of a comparison: paths of each state but the unchanged ones."""
    found = snapshot_diff(current, incoming)
    return found.groupBy("state").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("state") != "unchanged", F.col("path")))).alias("paths"))


def verified_files(files: DataFrame) -> DataFrame:
    """(path, state, error): whether each file can be parsed and its tokens make up its text."""
    docs = files.select(F.col("path").alias("doc"), F.col("content").alias("text"))
    bad = nodes(docs).where("error is not null").select("doc", "error")
    lossless = round_trip(tokens(docs).where("error is null"), docs)
    joined = lossless.join(bad, "doc", "left")
    state = F.when(F.col("error").isNotNull(), "FAILED").when(~F.col("lossless"), "CHANGED").otherwise("OK")
    return joined.select(F.col("doc").alias("path"), state.alias("state"), "error")


def install(files: DataFrame, target: str) -> dict:
    """Write a snapshot to ``target``, as a whole or not at all.

    The files are verified first; a file that fails stops everything. They are written beside the target, and
    then two renames put them in its place; if the second fails, the first is undone.
    """
    spark = files.sparkSession
    failed = verified_files(files).where("state <> 'OK'").orderBy("path").limit(20).collect()
    if failed:
        raise ValueError("not installed: " + "; ".join(f"{r.path}: {r.error or r.state}" for r in failed))
    make = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old, place = make(target + ".fresh"), make(target + ".old"), make(target)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for leftover in (fresh, old):
        system.delete(leftover, True)
    files.write.parquet(target + ".fresh")
    had = system.exists(place)
    if had and not system.rename(place, old):
        raise OSError(f"{target} cannot be moved")
    try:
        if not system.rename(fresh, place):
            raise OSError(f"{target} cannot be put in place")
    except Exception:
        if had:
            system.rename(old, place)
        raise
    system.delete(old, True)
    return manifest_of(spark.read.parquet(target)).first().asDict()


def write_status(spark: SparkSession, status: dict[str, str], path: str) -> None:
    """A small JSON table with the time of the check."""
    spark.createDataFrame([tuple(status.values())], ", ".join(f"{k} string" for k in status)).withColumn("checked_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """The status that was written, if it is not older than so many seconds; no row otherwise."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.json(path)
    except AnalysisException:
        return spark.createDataFrame([], "checked_at timestamp")
    return found.withColumn("checked_at", F.to_timestamp("checked_at")).where(F.unix_seconds(F.current_timestamp()) - F.unix_seconds("checked_at") < seconds)


def duration(seconds: Column) -> Column:
    """1h 02m, 3m 04s or 5s."""
    s = F.floor(seconds).cast("int")
    hours, minutes = F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int")
    return F.when(s >= 3600, F.format_string("%dh %02dm", hours, (minutes % 60).cast("int"))).when(s >= 60, F.format_string("%dm %02ds", minutes, (s % 60).cast("int"))).otherwise(F.format_string("%ds", s))


def as_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """Each row as one JSON text, without the fields that are null."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true", "pretty": str(pretty).lower()}).alias("json"))
