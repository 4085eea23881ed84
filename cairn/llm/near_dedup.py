"""Operator 5, MinHash near-dedup with tensored banding.

Two collections of ``TABLES`` half keys, of ``WIDTH`` minhashes each, are computed per document. A
table key joins a half key of the first collection with one of the second; the ``OFFSETS`` pairings
used give TABLES * OFFSETS tables of 2 * WIDTH minhashes out of 2 * TABLES * WIDTH minhashes in all.
At the threshold (0.75) a pair shares a half key with probability 0.42 and misses every table with
a probability of 14 in a million.

1. Equal shingle sets are one class; its smallest id stands for it from here on.
2. Half keys that a single class has are dropped: no table key made of them can be shared. So only
   classes that may have a neighbour pay for table keys.
3. First round: every member of a bucket is paired with the smallest one. The pairs are confirmed on
   the full shingle sets, and confirmed links are joined into components.
4. Second round: in buckets that still hold two components or more, members of different components
   are paired, once each, if the bound that their bitmaps set to the intersection allows the
   threshold; it is never below the intersection, so no link is lost. They are confirmed likewise,
   and components joined again.
   Pairs inside one component need no link, so a large group of copies is never expanded to pairs.

Odd rows: a null or empty text, or one of white space alone, has no shingles and is linked with
nothing; a row without an id is linked with nothing and kept, with a null component; rows of one id
share that id's component; repeated rows give repeated results; an empty table gives an empty
result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bounded_batches, map_rows, stored, text_or_empty
from cairn.llm.components import connected_components
from cairn.llm.shingles import Bitmaps, TensoredMinHash, bitmap, shingle_set

TABLES, WIDTH, OFFSETS = 24, 3, 6
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 1024


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_id (of the whole set), halves and bits of each row."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("halves", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()),
    ])

    def make():
        hashes = TensoredMinHash(TABLES, WIDTH)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids, halves, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text)
                sizes.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                halves.append(hashes.halves(found)[0] if len(found) else None)
                bits.append(bitmap(found) if len(found) else None)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(halves, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=schema.names
            )

        return work

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), ["doc_id", "text"], make, schema)


def _packed_sets(texts: DataFrame) -> DataFrame:
    schema = T.StructType([texts.schema["doc_id"], T.StructField("shingles", T.BinaryType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=schema.names)

        return work

    return map_rows(texts, ["doc_id", "text"], make, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    id_type = pairs.schema["lo"].dataType
    schema = T.StructType([T.StructField("lo", id_type), T.StructField("hi", id_type)])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=schema.names)

        return work

    both = pairs.join(sets.select(F.col("doc_id").alias("lo"), F.col("shingles").alias("lo_set")), "lo").join(sets.select(F.col("doc_id").alias("hi"), F.col("shingles").alias("hi_set")), "hi")
    return map_rows(both, ["lo", "hi", "lo_set", "hi_set"], make, schema)


def _crossing(placed: DataFrame, mixed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within the buckets of ``mixed``, each pair from its first shared table.

    A bucket is cut into blocks of about ``BLOCK`` members, and a task compares two blocks (or one
    with itself) at a time, so its memory does not depend on the size of the bucket.
    """
    id_type = reps.schema["rep"].dataType
    schema = T.StructType([T.StructField("lo", id_type), T.StructField("hi", id_type)])
    spark = placed.sparkSession
    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = F.floor((F.col("size") - 1) / BLOCK).cast("int")  # the last block
    members = placed.join(mixed.select("key", blocks.alias("last")).hint("shuffle_hash"), "key").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("last") + 1).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select("key", "i", "j", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "component")
    members = members.join(reps.select("rep", F.col("n").alias("size"), "halves", "bits"), "rep")
    fields = ["key", "b1", "b2", "own", "i", "j", "rep", "component", "size", "halves", "bits"]
    members = members.select(*fields).repartition(wide, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def compared(group: pa.Table) -> pa.RecordBatch:
        col = {c: group.column(c).combine_chunks() for c in fields}
        own, size, halves = col["own"].to_numpy(), col["size"].to_numpy(), col["halves"].flatten().to_numpy().reshape(-1, 2 * TABLES)
        bitmaps = Bitmaps(col["bits"].to_pylist(), size)
        i, j = col["i"][0].as_py(), col["j"][0].as_py() - TABLES
        ids, parts = col["rep"].to_numpy(zero_copy_only=False), col["component"].to_numpy(zero_copy_only=False)
        one_block = col["b1"][0].as_py() == col["b2"][0].as_py()
        side = np.arange(len(own)) if one_block else np.flatnonzero(own == col["b1"][0].as_py())
        rest = side if one_block else np.flatnonzero(own == col["b2"][0].as_py())
        lo, hi = [], []
        for x in side:
            to = rest[rest > x] if one_block else rest
            small, large = np.minimum(size[x], size[to]), np.maximum(size[x], size[to])
            to = to[(parts[to] != parts[x]) & (100 * small >= percent * large)]
            if not len(to):
                continue
            common = bitmaps.most_common(x, to)
            to = to[100 * common >= percent * (size[x] + size[to] - common)]
            if not len(to):
                continue
            same = halves[to] == halves[x]
            # The table of the first shared half key that has a partner, then of its first partner.
            left, right = same[:, :TABLES], same[:, TABLES:]
            tables = np.stack([np.roll(right, -d, axis=1) & left for d in range(OFFSETS)], axis=2).reshape(len(to), -1)
            here = tables.argmax(axis=1) == i * OFFSETS + (j - i) % TABLES
            lo += [min(ids[x], ids[y]) for y in to[here]]
            hi += [max(ids[x], ids[y]) for y in to[here]]
        return pa.RecordBatch.from_arrays([pa.array(lo, arrow_id), pa.array(hi, arrow_id)], names=schema.names)

    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [batch.column(fields.index(c)).to_numpy() for c in ("key", "b1", "b2")]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cuts], axis=0)) + 1
            if held and any(held[-1].column(fields.index(c))[-1].as_py() != batch.column(fields.index(c))[0].as_py() for c in ("key", "b1", "b2")):
                yield compared(pa.Table.from_batches(held))
                held = []
            start = 0
            for end in changes.tolist():
                yield compared(pa.Table.from_batches([*held, batch.slice(start, end - start)]))
                held, start = [], end
            held.append(batch.slice(start))
        if held:
            yield compared(pa.Table.from_batches(held))

    bounded_batches(spark)
    return members.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    rows = stored(sketches(docs, id_col=id_col, text_col=text_col), "dedup-sketches")
    has_set = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(has_set.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "dedup-classes")
    # Two rows of one id may have different sets: each set has a class of its own, linked below.
    reps = (
        has_set.join(classes, "set_id").where("doc_id = rep").groupBy("set_id").agg(F.min("rep").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("bits").alias("bits"))
    )
    reps = stored(reps, "dedup-reps")

    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    halves = reps.select("rep", F.posexplode("halves").alias("at", "half")).repartition(wide, "half")
    shared = halves.groupBy("half").agg(F.count("*").alias("members")).where("members > 1")
    live = halves.join(shared.hint("shuffle_hash"), "half").select("rep", F.struct("at", "half").alias("h"))
    both = live.groupBy("rep").agg(F.collect_list("h").alias("h"))  # 2 * TABLES at most for each set of the id
    first, second = (F.filter("h", lambda x: x["at"] < TABLES), F.filter("h", lambda x: x["at"] >= TABLES))
    matched = lambda x, y: F.pmod(y["at"] - TABLES - x["at"], F.lit(TABLES)) < OFFSETS
    keys = F.flatten(F.transform(first, lambda x: F.transform(F.filter(second, lambda y: matched(x, y)), lambda y: F.struct(x["at"].alias("i"), y["at"].alias("j"), F.xxhash64(x["half"], y["half"]).alias("key")))))
    members = both.select("rep", F.explode(keys).alias("k")).select("rep", "k.*").repartition(wide, "key")
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first"))
    buckets = stored(members.join(buckets.where("size > 1").hint("shuffle_hash"), "key"), "dedup-buckets")

    pairs = stored(buckets.where("rep <> first").select(F.col("first").alias("lo"), F.col("rep").alias("hi")).distinct(), "dedup-pairs-1")
    named = buckets.select(F.col("rep").alias("doc_id")).distinct()
    needed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(named, "doc_id", "left_semi")
    sets = stored(_packed_sets(needed).dropDuplicates(["doc_id"]), "dedup-sets")
    links = stored(_confirmed(pairs, sets, percent), "dedup-links-1")
    found = connected_components(links, "dedup-components-1")

    # Second round: across components, within buckets that have several.
    placed = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = placed.select("key", "i", "j", "rep", "component").repartition(wide, "key")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    more = stored(_crossing(placed, mixed, reps, percent), "dedup-pairs-2")
    second_links = stored(_confirmed(more.join(pairs, ["lo", "hi"], "left_anti"), sets, percent), "dedup-links-2")
    every = links.unionByName(second_links) if not second_links.isEmpty() else links
    if every is not links:
        found = connected_components(every, "dedup-components-2")

    by_set = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    return (
        rows.join(by_set, "set_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
