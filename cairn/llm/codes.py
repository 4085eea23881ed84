"""Operator 11, vector code compression: weighted Lloyd over the distinct parts of integer vectors.

A vector's components become integers, floor(scale * x), and the vector is cut into equal consecutive
parts. Equal parts of one position are one row with a weight: the rounds of Lloyd's algorithm see
each distinct part once, whatever the number of its copies. Each round assigns the distinct parts to
the nearest entries of their position's codebook and moves the entries to the weighted means; a
task sums its own parts, so that a row for each entry and Arrow batch is all that is shuffled. The
codebooks (parts x entries x components integers) are all that the driver holds. Finally codes and
errors are joined back to the vectors part by part and summed.

Parts that a 1,024-th of all vectors or more share are joined by broadcast (at most 1,024 for each
position, proven by their share), all others by a shuffle on the part; labels likewise.

Odd rows: vectors that are null or empty, or hold null or non-finite components, are dropped, and so
are those of another length than most; a length that ``parts`` does not divide is filled up
with zeros; integers are held within +-2^26, beyond which squared distances would overflow. The
codebooks start from the smallest ids that are not null, each id once (of several vectors of one
id the smallest); fewer ids give fewer entries, none give one entry of zeros. Rows without an id and
repeated rows are coded like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_rows, stored
from cairn.llm.vectors import SLOTS, join_weighted, matrix, usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers beyond this would let squared distances overflow.
MOST = 1 << 26
#: Code digits that fit one long.
DIGITS = 8


def integer_parts(vec: str, size: int, parts: int, scale: int):
    """The parts of a vector as arrays of integers."""
    width = -(-size // parts)
    whole = F.transform(F.col(vec), lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), width * parts - size)) if width * parts > size else whole
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(filled, i * width + 1, width))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower of equals, and the squared distance; exact."""
    best, code = None, np.zeros(len(parts), dtype=np.int64)
    for k, entry in enumerate(book):
        distance = ((parts - entry) ** 2).sum(axis=1)
        if best is None:
            best = distance
        else:
            closer = distance < best
            best = np.where(closer, distance, best)
            code[closer] = k
    return code, best


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids."""
    ids = [r["vec_id"] for r in rows.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 1, width), dtype=np.int64)
    found = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("parts").alias("parts")).orderBy("vec_id").collect()
    return np.array([r["parts"] for r in found], dtype=np.int64).transpose(1, 0, 2)


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every used entry at the floor of the weighted mean of its parts."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            pos, weight = np.asarray(batch.column("pos")), np.asarray(batch.column("weight"))
            part, out = matrix(batch.column("part"), np.int64), []
            for p in np.unique(pos):
                of = pos == p
                code, _ = nearest(part[of], books[p])
                for k in np.unique(code):
                    own = code == k
                    out.append((int(p), int(k), int(weight[of][own].sum()), (part[of][own] * weight[of][own, None]).sum(axis=0).tolist()))
            names = ["pos", "code", "n", "sums"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=names)

        return work

    width = books.shape[2]
    partial = map_rows(distinct, ["pos", "part", "weight"], make, "pos int, code int, n long, sums array<long>")
    sums = partial.groupBy("pos", "code").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    new = books.copy()
    for r in sums.collect():  # one row for each entry in use
        new[r["pos"], r["code"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """The distinct parts with their ``code`` and ``err``, the squared distance to it."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            pos, part = np.asarray(batch.column("pos")), matrix(batch.column("part"), np.int64)
            code, err = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
            for p in np.unique(pos):
                of = pos == p
                code[of], err[of] = nearest(part[of], books[p])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32)), pa.array(err)], names=[*batch.schema.names, "code", "err"])

        return work

    return map_rows(distinct, ["pos", "part", "weight"], make, "pos int, part array<int>, weight long, code int, err long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def hex_code(parts: int):
    """Two hex digits for each part, in order: codes are summed at their place, so any order of rows will do."""
    words = []
    for at in range(0, parts, DIGITS):
        n = min(DIGITS, parts - at)
        place = F.call_function("shiftleft", F.col("code").cast("long"), (F.lit(n - 1 + at) - F.col("pos")) * 8)
        words.append(F.lower(F.lpad(F.hex(F.sum(F.when(F.col("pos").between(at, at + n - 1), place).otherwise(F.lit(0)))), 2 * n, "0")))
    return F.concat(*words)


def compress(vectors: DataFrame, vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector. ``entries`` is 256 at most, as two hex digits name one."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, one part or more, no negative number of rounds")
    source, size, total = usable(vectors.select("vec_id", "label", vec), vec)
    if not total:
        return source.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = stored(source.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", integer_parts(vec, size, parts, scale).alias("parts")), "codes-vectors")
    books = first_books(rows, parts, entries, -(-size // parts))
    each = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    distinct = stored(each.groupBy("pos", "part").agg(F.count("*").alias("weight")), "codes-distinct")
    for _ in range(rounds):
        books = moved(distinct, books)
    # A position has ``total`` parts, so a hot part is held against that; there are at most SLOTS hot ones a position.
    coded = join_weighted(each, stored(assigned(distinct, books), "codes-assigned"), ["pos", "part"], "weight", total, SLOTS)
    summed = stored(coded.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), hex_code(parts).alias("code"), F.sum("err").alias("error")), "codes-summed")
    labels = stored(summed.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "codes-labels")
    out = join_weighted(summed, labels, ["label"], "rows", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
