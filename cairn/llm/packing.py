"""Operator 9, mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' ids, in ascending order of the documents' ids. In each
window a queue may send its quantum, the share of ``window`` tokens that the target mixture gives it.
What it does not send stays as its deficit: a queue saves up until it can send ``least`` tokens, so that
documents of rare sources are not cut to scraps, and the part of a token that a quantum has beyond whole ones is
carried on. A queue with a quantum of q tokens has its turn every p = ceil(least / q) windows and then sends p q tokens. Queues
begin as if they had saved for a part of their period already, so that rare ones take turns in different windows. An empty queue is passed over. Windows
follow each other without a gap, and the stream they make is cut into sequences of ``length`` tokens;
only the very last one is not full. It is padded, unless its size is a power of two. The mixture holds over
every stretch of a window, and for a queue with a period p over p windows, its horizon.

As turns are fixed, the state before any window has a closed form: after t turns a queue of T
tokens has sent min(T, floor(t * p * q)); the fraction is the deficit carried over. Hence
a document's place follows from its place in its queue, deficits carry across windows and across
partitions exactly, and no task walks through the queue of a hot source. Runs have ``least`` tokens or more (but a queue's last), so
there are no more of them than tokens / ``least``, whatever the number of sources.

The target mixture is each source's share of all tokens, or the weights given. A smaller ``window``
mixes sources more closely and cuts documents more often; with ``window`` = ``length`` and ``least`` = 1 every sequence holds
every source.

Odd rows: a null or empty text is the end id alone; a null source is a queue of its own; documents
of one id follow each other by a hash of their text; repeated rows are packed once each; an empty
table gives an empty result. Columns other than the id, the text and the source are not read and
cannot clash.

Every source has a queue of its own at any number of them. Up to ``QUEUES``, the driver and every
task hold totals and quanta. With more, these are a Spark table, and a document's runs get their
places from a running sum over all runs, sorted by window, queue and position; both ways give the
same places.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bounded_batches, stored, text_or_empty
from cairn.llm.encoder import worker_encoder

LENGTH, WINDOW, LEAST, QUEUES = 1024, 65_536, 1024, 1024
BASES = 200_000
#: Rows of an output batch, about.
ROWS = 20_000
#: Binary places of a quantum; deficits are exact to this fraction of a token.
PLACES = 16
#: States of queues (windows times queues) that are worked out at a time.
STATES = 1 << 20


def phase(queue: str) -> int:
    """Where in its period a queue begins, before the remainder by the period."""
    return zlib.crc32(queue.encode())


class RoundRobin:
    """Places of queue positions in the packed stream. ``totals``: tokens of each queue, by number; ``phases`` part their turns."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, least: int = LEAST, phases: list[int] | None = None):
        self.totals = np.array(totals, np.int64)
        shares = np.array(weights if weights is not None else totals, np.float64)
        shares = np.where(self.totals > 0, np.maximum(shares, 0), 0)
        if shares.sum() <= 0:
            shares = (self.totals > 0).astype(np.float64)
        shares = shares / max(shares.sum(), 1)
        # A queue with tokens sends something in the end, or it would never be empty.
        quanta = np.where(self.totals > 0, np.maximum(1, np.ceil(shares * window * 2**PLACES)), 1).astype(np.int64)
        self.periods = np.maximum(1, -((-least << PLACES) // quanta))
        self.turns = self.periods * quanta  # what a queue sends at a turn
        self.phases = np.array(phases if phases is not None else [0] * len(totals), np.int64) % self.periods

    def sent(self, w: int) -> np.ndarray:
        """Tokens that each queue has sent before window ``w``."""
        return np.minimum(self.totals, ((w + self.phases) // self.periods * self.turns) >> PLACES)

    def runs(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs, each of one turn, of spans of ``n`` tokens from position ``first`` of a queue:
        (number of the span, position in the queue, length, place in the stream), span by span."""
        turn = lambda at, size: (((at + 1) << PLACES) - 1) // size  # noqa: E731  in which token ``at`` is sent
        low, high = turn(first, self.turns[queue]), turn(first + np.maximum(n, 1) - 1, self.turns[queue])
        counts = np.where(n <= 0, 0, high - low + 1)
        span = np.repeat(np.arange(len(n)), counts)
        step = np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts, counts)
        size, begin, end = self.turns[queue][span], first[span], first[span] + n[span]
        t = low[span] + step
        at = np.maximum(begin, (t * size) >> PLACES)
        length = np.minimum(end, ((t + 1) * size) >> PLACES) - at
        w = (t + 1) * self.periods[queue][span] - self.phases[queue][span] - 1  # the window of that turn
        own = queue[span]
        windows, which = np.unique(w, return_inverse=True)
        place, block = np.empty(len(span), np.int64), max(1, STATES // max(1, len(self.totals)))
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(0, len(windows) + block, block))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            some = order[a:b]
            here = windows[i * block : (i + 1) * block, None]
            before, after = self.sent(here), self.sent(here + 1)
            earlier = np.cumsum(after - before, axis=1) - (after - before)  # by the queues before, in this window
            k = which[some] - i * block
            place[some] = before.sum(axis=1)[k] + earlier[k, own[some]] + at[some] - before[k, own[some]]
        return span, at, length, place


def encoded_queues(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row a document: its packed ids, its queue, and its place in the part of that queue that
    its own task read. Parts are ranges of (queue, document id), so a hot source spreads over tasks
    and places do not depend on how the input was cut into files."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("queue", T.StringType()), T.StructField("part", T.IntegerType()),
        T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches):
        encoder, part, ends = worker_encoder(tokenizer), TaskContext.get().partitionId(), {}
        width = encoder.dtype.itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = encoder.encode(batch.column(2).to_pylist(), end_id)
            queues, sizes, places = batch.column(1).to_pylist(), np.diff(bounds), []
            for queue, n in zip(queues, sizes.tolist(), strict=True):
                places.append(ends.get(queue, 0))
                ends[queue] = places[-1] + n
            rows = len(sizes)
            packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * rows, pa.int32()), pa.array(places, pa.int64()), pa.array(sizes), pa.array([width] * rows, pa.int32()), packed], names=schema.names
            )

    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0none")).alias("queue"), text_or_empty(text_col).alias("text"))
    # The row number only keeps repeated rows from meeting in one part.
    order = [F.col("queue"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ranged = frame.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "queue", "text").mapInArrow(run, schema)


def _quanta(by_queue: DataFrame, weights: dict[str, float] | None, window: int, least: int) -> DataFrame:
    """queue, period, turn (what it sends at one) and phase, as ``RoundRobin`` works them out."""
    if weights is None:
        shares = by_queue.select("queue", F.col("total").cast("double").alias("share"))
    else:
        given = by_queue.sparkSession.createDataFrame([(q, float(w)) for q, w in weights.items()], "queue string, weight double")
        shares = by_queue.join(given, "queue", "left").select("queue", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("share"))
    found = shares.agg(F.sum("share").alias("all"), F.count("*").alias("n")).first()
    share, whole = (F.col("share"), found["all"]) if found["all"] > 0 else (F.lit(1.0), float(found["n"]))
    quanta = shares.select("queue", F.greatest(F.lit(1).cast("long"), F.ceil(share / F.lit(max(whole, 1.0)) * F.lit(float(window)) * F.lit(float(2**PLACES)))).alias("quantum"))
    periods = quanta.withColumn("period", F.greatest(F.lit(1).cast("long"), F.expr(f"({least << PLACES} + quantum - 1) div quantum")))
    return periods.select("queue", "period", (F.col("period") * F.col("quantum")).alias("turn"), (F.crc32(F.col("queue").cast("binary")) % F.col("period")).alias("phase"))


def _placed_runs(rows: DataFrame, quanta: DataFrame, id_type: T.DataType) -> DataFrame:
    """doc_id, doc_tokens, start, place, width and ids of every run of a document within a turn.

    Runs are dealt out by ranges of (window, queue, position), which are all distinct, so a window or
    a queue of any size spreads over tasks; the driver holds one sum for each range.
    """
    fields = [T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "start", "w", "position", "size")), T.StructField("queue", T.StringType()),
              T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType(fields)

    def windows(first: int, n: int, period: int, size: int, phase: int):
        """(window, position, size) of the runs of ``n`` tokens from position ``first`` of a queue."""
        at, end = first, first + n
        while at < end:
            turn = (((at + 1) << PLACES) - 1) // size
            upto = min(end, ((turn + 1) * size) >> PLACES)
            yield (turn + 1) * period - phase - 1, at, upto - at
            at = upto

    def split(batches):
        for batch in batches:
            out = [[] for _ in fields]

            def made(out=out, batch=batch):
                kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=schema.names)

            for doc_id, queue, at, n, width, packed, base, *turns in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                for w, position, size in windows(base + at, n, *turns):
                    start = position - base - at
                    values = (doc_id, n, start, w, position, size, queue, width, packed[start * width : (start + size) * width])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    if len(out[0]) >= ROWS:
                        yield made()
                        for column in out:
                            column.clear()
            if out[0]:
                yield made()

    ranged_schema = T.StructType([*fields, T.StructField("range", T.IntegerType()), T.StructField("before", T.LongType())])

    def summed(batches):
        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(5).to_numpy()
            before = upto + np.cumsum(sizes) - sizes
            upto += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(before, pa.int64())], names=ranged_schema.names)

    wide = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["w", "queue", "position"]
    runs = rows.join(quanta, "queue").select("doc_id", "queue", "at", "n", "width", "ids", "base", "period", "turn", "phase").mapInArrow(split, schema)
    ranged = stored(runs.repartitionByRange(wide, *order).sortWithinPartitions(*order).mapInArrow(summed, ranged_schema), "packing-runs")
    starts, upto = [], 0
    for r in sorted(ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()):
        starts.append((r["range"], upto))
        upto += r["size"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, first long"))
    return ranged.join(starts, "range").select("doc_id", "doc_tokens", "start", (F.col("first") + F.col("before")).alias("place"), "width", "ids")


def pack_documents(
    docs: DataFrame, *, weights: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, least: int = LEAST, tokenizer: str | None = None, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to of every piece."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = stored(encoded_queues(docs, tokenizer, end_id, id_col, text_col, source_col), "packing-ids")
    spark = docs.sparkSession

    # Where each part of a queue begins: queues times parts, summed and numbered by Spark.
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    by_queue = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    totals = {r["queue"]: r["total"] for r in by_queue.limit(QUEUES + 1).collect()}
    few = len(totals) <= QUEUES
    everything = sum(totals.values()) if few else by_queue.agg(F.sum("total").alias("total")).first()["total"]
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("padded_to", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []),
    ])
    last = max(0, everything - 1) // length
    rest = everything - last * length
    last_size = rest if rest & (rest - 1) == 0 else length

    def pieces(doc_ids, doc_tokens, starts, sizes, places, ids, at):
        """Batches of the pieces of runs: their document (id and tokens), start in it, size and place,
        and where in ``ids`` each begins."""
        counts = (places + np.maximum(sizes, 1) - 1) // length - places // length + 1
        counts[sizes <= 0] = 0
        run = np.repeat(np.arange(len(sizes)), counts)
        step = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        sequence = places[run] // length + step
        begin = np.maximum(places[run], sequence * length)
        size = np.minimum(places[run] + sizes[run], (sequence + 1) * length) - begin
        done = begin - places[run]
        at, raw = at[run] + done, memoryview(ids.view(np.uint8))
        for a in range(0, len(run), ROWS):
            some = slice(a, a + ROWS)
            crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[some].tolist(), (at[some] + size[some]).tolist(), strict=True)]
            columns = [doc_ids.take(pa.array(run[some])), starts[run[some]] + done[some], size[some], np.array(crcs, np.int64), doc_tokens[run[some]], sequence[some], begin[some] % length]
            columns.append(np.where(sequence[some] == last, last_size, length))
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                upto = np.concatenate([[0], np.cumsum(size[some])])
                gathered = ids[np.repeat(at[some] - upto[:-1], size[some]) + np.arange(upto[-1])]
                columns.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(gathered.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def unpacked(packed: pa.Array, widths: pa.Array):
        """(all ids of the rows, where each row's begin): one width in a batch, the vocabulary's."""
        rows = packed.to_pylist()
        width = widths[0].as_py()
        sizes = np.array([len(x) // width for x in rows], np.int64)
        return np.ascontiguousarray(np.frombuffer(b"".join(rows), f"<u{width}").astype("<u4")), np.cumsum(sizes) - sizes

    bounded_batches(spark)
    # One small row for each queue and reading task: broadcast while that is at most BASES rows.
    if parts.count() <= BASES:
        bases = F.broadcast(bases)
    joined = rows.join(bases, ["queue", "part"]).select("doc_id", "queue", "at", "n", "width", "ids", "base")
    if not few:
        runs = _placed_runs(joined, _quanta(by_queue, weights, window, least), docs.schema[id_col].dataType)

        def run_placed(batches):
            for batch in batches:
                if batch.num_rows:
                    ids, at = unpacked(batch.column(5), batch.column(4))
                    sizes = np.diff(np.append(at, len(ids)))
                    yield from pieces(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), sizes, batch.column(3).to_numpy(), ids, at)

        return runs.mapInArrow(run_placed, schema)

    queues = sorted(totals)
    robin = RoundRobin([totals[q] for q in queues], [weights.get(q, 0.0) for q in queues] if weights is not None else None, window, least, [phase(q) for q in queues])
    number = {q: i for i, q in enumerate(queues)}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, begins = unpacked(batch.column(5), batch.column(4))
            queue = np.array([number[q] for q in batch.column(1).to_pylist()], np.int64)
            n = batch.column(3).to_numpy()
            first = batch.column(6).to_numpy() + batch.column(2).to_numpy()
            span, at, size, place = robin.runs(queue, first, n)
            start = at - first[span]
            yield from pieces(batch.column(0).take(pa.array(span)), n[span], start, size, place, ids, begins[span] + start)

    return joined.mapInArrow(run, schema)
