"""Operator 7, token-ID output: a content-addressed store of id streams.

Layout under one folder, all Parquet:

    chunks/    digest, payload   unique chunks, each stored once; payload: ids, little-endian,
                                 16 bits wide if the vocabulary allows, else 32
    recipes/   doc_id, part, before, n_tokens, crc, digests, root   in ascending doc_id order:
                                 parts follow each other, and ``before`` counts the ids of the
                                 documents before this one in its part
    manifest/  part, first, n_docs, n_tokens, root   the ids before the part, and a Merkle root over
                                 its documents
    summary/   n_parts, n_docs, n_tokens, n_chunks, width, root   one row, written last; the root is
                                 the Merkle root over the parts

A document's stream (its ids and the end id) is cut where a rolling hash of the last ``WINDOW`` ids
has ``CUT_BITS`` zero bits, at least ``LEAST`` and at most ``MOST`` ids apart, so equal passages give
equal chunks wherever they stand. A chunk's address is the BLAKE2b digest of its payload; a
document's root is the Merkle root of its chunks' digests, and its leaf in the part's tree covers its
id, its number of ids, their CRC-32 and that root.

Reading first holds the recipes against the manifest, and the manifest and the number of chunks
against the summary. Then every payload is checked against its address, every document against its
root, its number of ids and its CRC. A chunk, recipe, manifest or summary that is missing, added or
changed raises an error; nothing is dropped. ``read_store`` gets a document's CRC-32 (of its ids as
32-bit numbers) from those of its chunks' payloads, as CRCs combine along the recipe, so payloads
are read once and never shuffled; ``read_ids`` rebuilds the ids themselves and checks them likewise.

Odd rows: a null or empty text is the end id alone; rows of one id follow each other by their root; a
null id sorts first; repeated rows each have a recipe and share the chunks; an empty table gives an
empty store and result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bounded_batches, map_rows, shared_path, text_or_empty
from cairn.llm.encoder import worker_encoder
from cairn.llm.shingles import mixed

WINDOW, CUT_BITS, LEAST, MOST = 16, 8, 128, 4096
#: Digests that a writing task remembers in order not to stage a chunk twice.
SEEN = 200_000
#: A chunk that more than one in so many recipe entries names is joined by broadcast: fewer than
#: HOT chunks can be.
HOT = 500
#: The CRC-32 polynomial, reflected (a fixed value of the format).
POLYNOMIAL = np.uint32(0xEDB88320)
_NUMBERS = mixed(np.arange(1 << 17, dtype=np.uint64) + np.uint64(77))


class StoreError(ValueError):
    """The files of a store do not belong together."""


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Neighbours are hashed together, level by level; an odd one out moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [address(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStack:
    """The same root over a stream of leaves, holding one node a level."""

    def __init__(self):
        self._levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, held in enumerate(self._levels):
            if held is None:
                self._levels[i] = leaf
                return
            self._levels[i], leaf = None, address(held + leaf)
        self._levels.append(leaf)

    def root(self) -> bytes:
        node = None
        for held in self._levels:
            if held is not None:
                node = held if node is None else address(held + node)
        return node or b""


def cuts(ids: np.ndarray, at: np.ndarray | None = None) -> list[list[int]]:
    """Ends of the chunks of each stream: stream i is ``ids[at[i]:at[i + 1]]`` (one stream by default)."""
    bounds = [0, len(ids)] if at is None else at.tolist()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_NUMBERS[ids.astype(np.int64) & 0x1FFFF], dtype=np.uint64)])
    rolling = sums[WINDOW:] - sums[:-WINDOW]
    marks = np.flatnonzero((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    first = np.searchsorted(marks, np.array(bounds[:-1]) + WINDOW).tolist()
    upto = np.searchsorted(marks, bounds[1:]).tolist()
    marks, out = marks.tolist(), []
    for last, end, a, b in zip(bounds[:-1], bounds[1:], first, upto, strict=True):
        ends = []
        for mark in [*marks[a:b], end]:
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark > last and (mark == end or mark - last >= LEAST):
                last = mark
                ends.append(mark)
        out.append(ends)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), modulo the CRC's, all reflected."""
    product, one = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.uint32), np.uint32(1)
    for bit in range(31, -1, -1):
        product ^= np.where(a >> np.uint32(bit) & one, b, np.uint32(0))
        b = (b >> one) ^ np.where(b & one, POLYNOMIAL, np.uint32(0))
    return product


def _powers(n: int) -> list[np.ndarray]:
    """x to the powers 8, 16, 32 ..."""
    power = np.array(1 << 23, np.uint32)
    out = [power]
    for _ in range(n - 1):
        out.append(power := _times(power, power))
    return out


_POWERS = _powers(44)


def shifted_crcs(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 comes to when so many bytes follow: XOR them to get the CRC of the whole."""
    out, left, bit = crcs.astype(np.uint32), n_bytes.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _times(out[odd], _POWERS[bit])
        left, bit = left >> 1, bit + 1
    return out


def _leaf(doc_id, n_tokens: int, crc: int, root: bytes) -> bytes:
    return address(f"{doc_id}:{n_tokens}:{crc}:".encode() + root)


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def write_store(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the store."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    chunk = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("payload", T.BinaryType())])
    recipe = [T.StructField("n_tokens", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType())]
    schema = T.StructType([id_field, *recipe, T.StructField("width", T.IntegerType()), T.StructField("fresh", T.ArrayType(chunk))])

    def make():
        encoder, seen = worker_encoder(tokenizer), set()
        width = encoder.dtype.itemsize

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at = encoder.encode(batch.column(1).to_pylist(), end_id)
            packed, wide = memoryview(ids.tobytes()), memoryview(ids.astype("<u4").tobytes())
            digests, sizes, roots, crcs, new, new_sizes = [], [], [], [], [], []
            for start, ends in zip(at.tolist(), cuts(ids, at), strict=False):
                own, crc, before = [], zlib.crc32(wide[4 * start : 4 * ends[-1]]), len(new)
                for end in ends:
                    payload = packed[start * width : end * width]
                    digest = address(payload)
                    own.append(digest)
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        new.append((digest, payload))
                    start = end
                digests += own
                sizes.append(len(own))
                roots.append(merkle_root(own))
                crcs.append(crc)
                new_sizes.append(len(new) - before)
            fresh = pa.StructArray.from_arrays([pa.array([d for d, _ in new], pa.binary()), pa.array([bytes(p) for _, p in new], pa.binary())], names=["digest", "payload"])
            columns = [pa.array(np.diff(at)), pa.array(crcs, pa.int64()), _lists(pa.array(digests, pa.binary()), sizes), pa.array(roots, pa.binary()), pa.array([width] * len(roots), pa.int32()), _lists(fresh, new_sizes)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

        return work

    spark = docs.sparkSession
    staged_at = shared_path(spark, "token-staging")
    map_rows(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), ["doc_id", "text"], make, schema).write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema(schema).parquet(staged_at)
    staged.select(F.inline("fresh")).dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    placed = T.StructType([id_field, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), *recipe])

    def number(batches):
        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(1).to_numpy()
                before = upto + np.cumsum(sizes) - sizes
                upto += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), pa.array(before), *batch.columns[1:]], names=placed.names)

    bounded_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # All keys are distinct, so rows of one id spread over parts, too.
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("row")]
    ordered = staged.drop("fresh", "width").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.drop("row").mapInArrow(number, placed).write.parquet(f"{path}/recipes")
    _write_manifest(spark, path, staged)
    # The store is whole and reads nothing from the staged rows any more.
    stale = spark._jvm.org.apache.hadoop.fs.Path(staged_at)
    stale.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stale, True)


_PART = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType())])
_SUMMARY = "n_parts int, n_docs long, n_tokens long, n_chunks long, width int, root binary"


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{what}")
    except AnalysisException as error:  # no such folder, or no file in it
        raise StoreError(f"the store has no {what}: {error}") from error


def _parts_of(spark: SparkSession, recipes: DataFrame) -> list:
    """Number of documents and ids and the Merkle root of each part; a part is a range of the ids, so
    there are as many as shuffle partitions when the store was written."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for part, before, doc_id, n, crc, root in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                held = found.setdefault(part, [0, 0, MerkleStack()])
                held[0] += 1
                held[1] += n
                held[2].add(_leaf(doc_id, n, crc, root))
        if found:
            rows = sorted(found)
            columns = [pa.array(rows, pa.int32()), *(pa.array([found[p][i] for p in rows], pa.int64()) for i in (0, 1)), pa.array([found[p][2].root() for p in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_PART.names)

    bounded_batches(spark)
    columns = recipes.select("part", "before", "doc_id", "n_tokens", "crc", "root")
    return sorted(columns.repartition("part").sortWithinPartitions("part", "before").mapInArrow(run, _PART).collect(), key=lambda r: r["part"])


def _write_manifest(spark: SparkSession, path: str, staged: DataFrame) -> None:
    parts, rows, first = _parts_of(spark, spark.read.parquet(f"{path}/recipes")), [], 0
    for r in parts:
        rows.append((r["part"], first, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        first += r["n_tokens"]
    spark.createDataFrame(rows, "part int, first long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    some = staged.select("width").first()
    summary = (len(rows), sum(r["n_docs"] for r in parts), first, spark.read.parquet(f"{path}/chunks").count(), some["width"] if some else 2, merkle_root([r[4] for r in rows]))
    spark.createDataFrame([summary], _SUMMARY).coalesce(1).write.parquet(f"{path}/summary")


def verify_store(spark: SparkSession, path: str):
    """(summary, ids before each part) if recipes, manifest, chunk count and summary agree; else StoreError."""
    summaries = _read(spark, path, "summary").collect()
    if len(summaries) != 1:
        raise StoreError(f"the store has {len(summaries)} summaries")
    (summary,) = summaries
    manifest = sorted(_read(spark, path, "manifest").collect(), key=lambda r: r["part"])  # one row a part
    if (len(manifest), sum(r["n_docs"] for r in manifest), sum(r["n_tokens"] for r in manifest)) != (summary["n_parts"], summary["n_docs"], summary["n_tokens"]):
        raise StoreError("the manifest does not match the summary")
    if merkle_root([bytes(r["root"]) for r in manifest]) != bytes(summary["root"]):
        raise StoreError("the manifest does not match its Merkle root")
    if _read(spark, path, "chunks").count() != summary["n_chunks"]:
        raise StoreError(f"the store does not have its {summary['n_chunks']} chunks")
    found = [(r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in _parts_of(spark, _read(spark, path, "recipes"))]
    wanted = [(r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in manifest]
    if found != wanted:
        raise StoreError(f"recipes of parts {sorted({p[0] for p in set(found) ^ set(wanted)})} do not match the manifest")
    return summary, {r["part"]: r["first"] for r in manifest}


def _recipes(spark: SparkSession, path: str, firsts: dict[int, int]) -> DataFrame:
    """The recipes with the absolute start of each document; one broadcast row a part."""
    starts = spark.createDataFrame(list(firsts.items()), "part int, first long")
    return _read(spark, path, "recipes").join(F.broadcast(starts), "part").withColumn("start", F.col("first") + F.col("before")).drop("first", "before")


def _checked(chunks: DataFrame, width: int) -> DataFrame:
    """digest, n ids and crc (of 32-bit ids) of chunks, their payloads checked."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, crcs = [], []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if address(payload) != digest:
                    raise StoreError(f"chunk {digest.hex()} does not match its address")
                sizes.append(len(payload) // width)
                crcs.append(zlib.crc32(payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4")))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=schema.names)

        return work

    return map_rows(chunks, ["digest", "payload"], make, schema)


def _with_chunks(pieces: DataFrame, chunks: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every recipe entry with what ``read`` makes of its chunk (nulls if there is none); chunks named by
    a large share of all entries, such as that of the empty text, are joined by broadcast."""
    # All that are named by more than one in HOT entries are among the most frequent ones of the sketch.
    found = pieces.select(F.xxhash64("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {2 * HOT}, {100 * HOT})").alias("top"), F.count("*").alias("n")).first()
    hot = [r["item"] for r in found["top"] or [] if r["count"] > max(1000, found["n"] // HOT)]  # fewer than HOT
    if not hot:
        return pieces.join(read(chunks), "digest", "left")
    is_hot = F.xxhash64("digest").isin(hot)
    few = F.broadcast(read(chunks.where(is_hot)))
    return pieces.where(is_hot).join(few, "digest", "left").unionByName(pieces.where(~is_hot).join(read(chunks.where(~is_hot)), "digest", "left"))


def _missing(found: list, n_tokens: int) -> bool:
    return not found or any(p is None for p in found) or sum(found) != n_tokens


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, checked."""
    summary, firsts = verify_store(spark, path)
    recipes = _recipes(spark, path, firsts)
    schema = T.StructType([recipes.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    pieces = recipes.select("start", F.posexplode("digests").alias("at", "digest"))
    # n_tokens is at least 1, so a start belongs to one recipe.
    joined = _with_chunks(pieces, _read(spark, path, "chunks"), lambda chunks: _checked(chunks, summary["width"]))
    gathered = joined.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "n", "crc"))).alias("pieces"))
    both = recipes.select("doc_id", "start", "n_tokens", "crc", "root").join(gathered, "start", "left")
    both = both.select("doc_id", "start", "n_tokens", "crc", "root", F.col("pieces.digest").alias("digests"), F.col("pieces.n").alias("sizes"), F.col("pieces.crc").alias("crcs"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, roots, digests, sizes = (batch.column(i).to_pylist() for i in (2, 4, 5, 6))
            for n_tokens, root, own, found in zip(tokens, roots, digests, sizes, strict=True):
                if _missing(found, n_tokens):
                    raise StoreError("a document has chunks that the store lacks")
                if merkle_root(own) != root:
                    raise StoreError("a recipe does not match its Merkle root")
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in sizes])])
            counts, crcs = batch.column(6).flatten().to_numpy(), batch.column(7).flatten().to_numpy()
            ends = np.repeat(np.cumsum(counts)[bounds[1:] - 1], np.diff(bounds))
            whole = np.bitwise_xor.reduceat(shifted_crcs(crcs, 4 * (ends - np.cumsum(counts))), bounds[:-1]).astype(np.int64)
            if (whole != batch.column(3).to_numpy()).any():
                raise StoreError("the chunks of a document do not make up its ids")
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(whole)], names=schema.names)

        return work

    return map_rows(both, both.columns, make, schema)


def read_ids(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """doc_id, start and the ids of whole documents (of all, or of those named), rebuilt and checked."""
    summary, firsts = verify_store(spark, path)
    recipes = _recipes(spark, path, firsts)
    if doc_ids is not None:
        recipes = recipes.where(F.col("doc_id").isin(doc_ids))
    pieces = _with_chunks(recipes.select("start", F.posexplode("digests").alias("at", "digest")), _read(spark, path, "chunks"), lambda chunks: chunks)
    whole = pieces.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("pieces"))
    both = recipes.select("doc_id", "start", "n_tokens", "crc", "digests", "root").join(whole, "start", "left").withColumn("payloads", F.col("pieces.payload")).drop("pieces")
    schema = T.StructType([recipes.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
    width = summary["width"]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for n_tokens, crc, digests, root, found in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if _missing([p and len(p) // width for p in found or []], n_tokens) or [address(p) for p in found] != digests or merkle_root(digests) != root:
                    raise StoreError("a document's chunks are missing or changed")
                ids = np.frombuffer(b"".join(found), f"<u{width}").astype("<u4")
                if zlib.crc32(ids) != crc:
                    raise StoreError("the chunks of a document do not make up its ids")
                out.append(ids.tolist())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=schema.names)

        return work

    return map_rows(both.select("doc_id", "start", "n_tokens", "crc", "digests", "root", "payloads"), ["doc_id", "start", "n_tokens", "crc", "digests", "root", "payloads"], make, schema)
