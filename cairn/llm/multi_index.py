"""Operator 13, approximate nearest neighbours: an inverted multi-index over two vector halves.

Each half of a vector is quantised by a codebook of its own; a cell is a pair of centroids, so K + K
centroids part the space into K x K cells. A query scores all centroids of both halves, then walks pairs of centroids in
order of summed score with a heap, until the cells it has passed hold the share of all rows that the index
was given. Every row of those cells is reranked by its exact inner product.

The index is fitted on at most ``sample`` rows (whose ids hash lowest); every row is indexed. How much of
the index a query visits is measured on the same sample, not guessed: the least share that finds
``recall`` of the exact neighbours of ``trials`` sample rows among the sample. Neighbours in a thin
sample lie farther away than in all rows, so the share rather errs on the safe side. Where vectors
form groups it is small; where they have no structure it is large, and a search then costs a large
part of all pairs.

Rows are ordered by cell and cut into shards of about ``shard_rows``: a cell with many rows, or
many copies of one vector, is spread over several, small cells share one. A query is sent once to each
shard that holds some of its cells, as vector and lowest visited score; queries of one shard are cut into chunks that meet copies of its
rows, so no task holds more than a shard's rows and a chunk's queries. Of a shard only those of a query's best k leave
it that may be among the k best of all: a query knows a score that k other rows reach, the one of rank k + 1 among the
sample's rows in visited cells (one of which may be itself). Centroids, cell sizes (K at most MOST_CENTROIDS: 8 MB) and
the sample are all that driver and tasks hold besides.

Odd rows: vectors that are null, empty or zero, hold null or non-finite components, or are of another length
than most take no part. Repeated rows are found like any other; a query's own row is told by its
place, so that a second row of the same id can be found. Rows without an id rank behind ties and are
no queries. With fewer candidates than k all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import map_rows, stored
from cairn.llm.vectors import matrix, usable

NEIGHBOURS, EVERY = 20, 20
SAMPLE, TRIALS, RECALL = 16_384, 256, 0.96
ROUNDS, LEAST_CENTROIDS, MOST_CENTROIDS, CELL_ROWS = 8, 8, 1024, 32
SHARD_ROWS, CHUNK_QUERIES = 2048, 4096
#: Scores within this of the lowest visited one count as visited, whatever the last bits of a sum.
SLACK = 1e-9
#: Queries that are scored against a shard at once.
BLOCK = 256


def halves(x: np.ndarray) -> list[np.ndarray]:
    cut = x.shape[1] // 2
    return [x[:, :cut], x[:, cut:]]


def quantised(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def learned(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from rows at even distances; centroids without rows stay."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = quantised(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=column, minlength=k) for column in x.T], axis=1) if x.shape[1] else np.zeros((k, 0))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def lowest_visited(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> float:
    """The summed score at which the cells passed, best pair first, hold ``wanted`` rows.

    Pairs are taken from a heap that starts with the two best centroids; a pair brings in the next
    centroid of the second half, and the first of a row brings in the next row.
    """
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b, of = first[rows].tolist(), second[columns].tolist(), sizes[rows][:, columns].tolist()
    heap, held, score = [(-(a[0] + b[0]), 0, 0)], 0, 0.0
    while heap and held < wanted:
        negative, i, j = heapq.heappop(heap)
        score = -negative
        held += of[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return score


def measured_share(x: np.ndarray, books: list[np.ndarray], k: int, trials: int, recall: float) -> float:
    """The least share of the rows, by cells in order of score, that holds ``recall`` of the trials' k nearest."""
    of = [quantised(h, c) for h, c in zip(halves(x), books, strict=True)]
    needed = []
    for q in np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int):
        exact = x @ x[q]
        exact[q] = -np.inf
        near = np.argsort(-exact, kind="stable")[: min(k, len(x) - 1)]
        score = sum((c @ h[0])[o] for c, o, h in zip(books, of, halves(x[q : q + 1]), strict=True))
        # How many rows lie in cells that are passed before each neighbour's.
        needed.append((score[None, :] > score[near, None] + SLACK).sum(axis=1))
    every = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    return (every[int(np.ceil(recall * len(every))) - 1] + 1) / len(x) if len(every) else 1.0


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; -inf is no score."""
    n = int((scores > -np.inf).sum())
    if n > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.flatnonzero(scores > -np.inf)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def nearest_rows(vectors: DataFrame, vec: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS, sample: int = SAMPLE, trials: int = TRIALS, recall: float = RECALL, shard_rows: int = SHARD_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the largest inner product found for each row whose id ``every`` divides."""
    given = vectors.select("vec_id", F.col(vec).alias("v"))
    source, size, total = usable(given.where(F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))), "v")
    kind, v_kind = (given.schema[c].dataType.simpleString() for c in ("vec_id", "v"))
    if not total:
        return source.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    fitted = source.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toPandas()["v"]  # ``sample`` rows at most
    x = np.array(fitted.tolist(), dtype=np.float64)
    n_centroids = int(np.clip(np.sqrt(total / CELL_ROWS), LEAST_CENTROIDS, min(MOST_CENTROIDS, len(x)))) if len(x) >= LEAST_CENTROIDS else len(x)
    books = [learned(h, n_centroids) for h in halves(x)]
    share = measured_share(x, books, k, trials, recall)

    def make_cells():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            first, second = (quantised(h, c) for h, c in zip(halves(matrix(batch.column("v"), np.float64)), books, strict=True))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array((first * n_centroids + second).astype(np.int32))], names=[*batch.schema.names, "cell"])

        return work

    numbered = source.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    index = stored(map_rows(numbered, ["row", "vec_id", "v"], make_cells, f"row long, vec_id {kind}, v {v_kind}, cell int"), "multi-index")
    sizes = np.zeros(n_centroids * n_centroids, dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # one row a cell, MOST_CENTROIDS squared at most
        sizes[r["cell"]] = r["count"]
    starts = np.cumsum(sizes) - sizes
    wanted = int(np.ceil(share * total))
    sample_cells = [quantised(h, c) for h, c in zip(halves(x), books, strict=True)]
    shared = index.sparkSession.sparkContext.broadcast((books, sizes, starts, x, sample_cells))

    def make_shards():
        _, sizes, starts, _, _ = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            # A row's place in its cell is as good as random, so a cell's rows spread evenly over its shards.
            row, cell = np.asarray(batch.column("row")).astype(np.uint64), np.asarray(batch.column("cell"))
            mixed = (row * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard = (starts[cell] + (mixed % sizes[cell].astype(np.uint64)).astype(np.int64)) // shard_rows
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

        return work

    def probes(batches):
        books, sizes, starts, x, (first_of, second_of) = shared.value
        of = sizes.reshape(n_centroids, n_centroids)
        first_shard, last_shard = starts // shard_rows, (starts + np.maximum(sizes, 1) - 1) // shard_rows
        filled = sizes > 0
        for batch in batches:
            vs = matrix(batch.column("v"), np.float64)
            at, low, least, shard = [], [], [], []
            for n, (a, b) in enumerate(zip(*halves(vs), strict=True)):
                one, two = books[0] @ a, books[1] @ b
                score = lowest_visited(one, two, of, wanted) - SLACK
                visited = np.flatnonzero(((one[:, None] + two[None, :]).ravel() >= score) & filled)
                known = (x @ vs[n])[one[first_of] + two[second_of] >= score]
                enough = np.partition(known, len(known) - k - 1)[len(known) - k - 1] - SLACK if len(known) > k else -np.inf
                spans = [np.arange(first_shard[c], last_shard[c] + 1) for c in visited]
                for s in np.unique(np.concatenate(spans)) if spans else ():
                    at.append(n), low.append(score), least.append(enough), shard.append(int(s))
            if at:
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(low, pa.float64()), pa.array(least, pa.float64()), pa.array(shard, pa.int64())], names=[*batch.schema.names, "low", "least", "shard"])

    def reranked(_, left, right):
        books = shared.value[0]
        rows, asked = left.combine_chunks(), right.combine_chunks()
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), right.schema.field("vec_id").type, pa.int64(), left.schema.field("vec_id").type, pa.float64()), strict=True)})
        vs, row, cell = (matrix(rows["v"].combine_chunks(), np.float64), np.asarray(rows["row"]), np.asarray(rows["cell"]))
        qs, own, low, least = (matrix(asked["v"].combine_chunks(), np.float64), *(np.asarray(asked[c]) for c in ("row", "low", "least")))
        ties = np.asarray(pc.rank(rows["vec_id"], sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
        cells, at_cell = np.unique(cell, return_inverse=True)
        which, found, scores = [], [], []
        for begin in range(0, len(qs), BLOCK):
            q = qs[begin : begin + BLOCK]
            of = [h @ c.T for h, c in zip(halves(q), books, strict=True)]
            visited = of[0][:, cells // n_centroids] + of[1][:, cells % n_centroids] >= low[begin : begin + BLOCK, None]
            score = np.where(visited[:, at_cell], q @ vs.T, -np.inf)
            score[(own[begin : begin + BLOCK, None] == row[None, :]) | (score < least[begin : begin + BLOCK, None])] = -np.inf
            for n, line in enumerate(score):
                top = best(line, ties, k)
                which.append(np.full(len(top), begin + n)), found.append(top), scores.append(line[top])
        at, top = pa.array(np.concatenate(which)), pa.array(np.concatenate(found))
        columns = [asked["row"].take(at), asked["vec_id"].take(at), rows["row"].take(top), rows["vec_id"].take(top), pa.array(np.concatenate(scores))]
        return pa.table(columns, names=names)

    entries = map_rows(index, ["row", "vec_id", "v", "cell"], make_shards, f"row long, vec_id {kind}, v {v_kind}, cell int, shard long")
    queries = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    sent = stored(queries.mapInArrow(probes, f"row long, vec_id {kind}, v {v_kind}, low double, least double, shard long"), "multi-index-probes")
    chunks = sent.groupBy("shard").agg(F.ceil(F.count("*") / chunk_queries).cast("int").alias("chunks"))
    chunk = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    asked = sent.join(chunks, "shard").withColumn("chunk", chunk(F.col("chunks"))).drop("chunks")
    copies = entries.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    met = copies.groupBy("shard", "chunk").cogroup(asked.groupBy("shard", "chunk")).applyInArrow(reranked, f"query_row long, query_id {kind}, row long, vec_id {kind}, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
