"""Readers: the driver's Parquet tables, text trees, manifests, archives."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch of whole texts that goes to a Python worker.
BATCH_BYTES = 16 * 1024 * 1024


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already says how."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(2**31 - 1), str(2**63 - 1), "-1"):
        spark.conf.set(key, str(BATCH_BYTES))


#: What one task parses at most, about, in rows; so many characters of text count as a row.
PIECE, CHARACTERS = 150_000, 50


def spread(df: DataFrame, text: str) -> DataFrame:
    """Deal rows out where they come in fewer parts than there are cores, or in parts of more than about PIECE: work in Python on
    a row costs far more than moving it, and a task must not grow with the table."""
    rows, characters = df.agg(F.count("*"), F.sum(F.length(text))).first()
    pieces = -(-(rows + (characters or 0) // CHARACTERS) // PIECE)
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, pieces)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the session names for what driver and executors share; a session of
    one JVM that names none gets a temporary one, a cluster its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.cairn.scratch", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cairn-scratch"
        spark.conf.set("spark.cairn.scratch", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back with the same schema."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row a line: ``keep``, line (from 1) and txt; CRLF counts as one line end."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n", "\n")
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "txt")).select(*keep, (F.col("at") + 1).cast("bigint").alias("line"), "txt")


def text_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files under a folder: rel_path, text, length, modified; read byte-exactly, in no order.

    ``rel_path`` is what follows the folder in a file's path, whatever characters either has.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = re.sub(r"^file:/*", "/", path.rstrip("/")) + "/"
    whole = F.regexp_replace("path", r"^file:/*", "/")
    relative = whole.substr(F.length(F.substring_index(whole, root, 1)) + F.lit(len(root) + 1), F.length(whole))
    return files.select(relative.alias("rel_path"), F.decode("content", "UTF-8").alias("text"), "length", F.col("modificationTime").alias("modified"))


def descriptor(text: Column) -> Column:
    """``key="value"`` lines as a map of lower-case keys; the last of repeated keys counts."""
    pattern = r'(?m)^[ \t]*([\w.-]+)[ \t]*=[ \t]*"([^"]*)"'
    entries = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lower(F.regexp_extract(m, pattern, 1)).alias("key"), F.regexp_extract(m, pattern, 2).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest; a missing one is an empty frame."""
    try:
        return spark.read.json(path, multiLine=True)
    except Exception as problem:  # a path that is not there is an answer, anything else is not
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], "commit string")
        raise


def archive_members(spark: SparkSession, path: str, member_pattern: str) -> DataFrame:
    """Members of tar.gz archives whose name matches: archive, rel_path, content, error.

    An archive that cannot be read gives one row with its ``error`` after the members read so far; it
    stops no other.
    """
    import io
    import tarfile
    import zlib

    schema = "archive string, rel_path string, content binary, error string"
    names = ["archive", "rel_path", "content", "error"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]

    def members(name: str, content: bytes):
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                for member in archive:
                    found = re.search(member_pattern, member.name)
                    if member.isfile() and found:
                        yield name, found.group(1) if found.groups() else member.name, archive.extractfile(member).read(), None
        except (tarfile.TarError, OSError, EOFError, zlib.error) as problem:
            yield name, None, None, str(problem)

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in members(name, content):  # one member at a time: archives may be large
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, schema)
