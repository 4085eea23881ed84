"""Operator 2, quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Each learned filter looks at ``WIDTH`` bytes; windows start every
``STRIDE`` bytes and overlap, from the first byte to the last (the end is padded with byte 0), so
the whole document is covered whatever its length. Every filter keeps its largest response over all
windows (max-pooling), and the pooled responses are combined into one probability.

As a filter over one-hot bytes is a table of 256 numbers for each of its positions, a response is a
sum of ``WIDTH`` table rows: no one-hot matrix is built. A long text is worked off in spans of
``SPAN`` bytes; a span brings the bytes before and after it that its windows look at, so the windows
are those of the whole text and memory does not depend on its length.

A second bank of filters looks at chunks of ``CHUNK`` bytes, half overlapping, through copy channels:
the share of the chunk's bytes that equal the byte ``lag`` places before, for every lag up to
``LAGS``, and the largest of these shares. It sees a passage that repeats itself, whatever the words.
The channels are fixed; the filters over them are learned like those over bytes.

The network is fitted on the driver on at most ``max_rows`` labelled rows and ``max_bytes`` of text
(the ones whose id hashes lowest, so the choice does not depend on order or partitioning); scoring is
one narrow pass. All sums run in a fixed order, so a score depends on the text alone, not on the
batch that it is in.

Odd rows: a null or empty text is scored as the padding alone; equal texts get equal scores;
repeated rows give repeated results; a null id counts as not held out; labels that are null, or
whose id is null, are not learned from, of several labels of one id the largest is taken and of
several texts the least; with no label of either class the score is the share of class 1 (0.5 without
any label). Only the id and the text of a document are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import map_rows, text_or_empty

WIDTH, STRIDE, FILTERS = 8, 4, 12
CHUNK, LAGS, COPY_FILTERS = 64, 24, 4
HALF = CHUNK // 2
#: Bytes whose responses are held at once (a multiple of HALF).
SPAN = 262_144
#: 32 values that valid text has nowhere or hardly, twice: no two places within LAGS are alike.
PADDING = bytes([*range(9), *range(14, 32), 0xC0, 0xC1, 0xF5, 0xF6, 0xF7]) * 4
#: Share of rows that never take part in learning: crc32(id as text) mod HELD_OUT_MOD = 0.
HELD_OUT_MOD = 5


#: HALF bytes of context, the bytes, and in how many of them windows begin: 0 for all of the bytes, the
#: last of which windows run into padding.
Span = tuple[bytes, bytes, int]


@dataclass
class ByteConvNet:
    """tables[k, byte] are the weights of all filters at position k, copy those over the copy channels.

    bias and out have an entry for each filter of the first bank, then of the second.
    """

    tables: np.ndarray  # WIDTH x 256 x FILTERS, float32
    copy: np.ndarray  # LAGS x COPY_FILTERS: lags 2 .. LAGS, then the largest share
    bias: np.ndarray  # FILTERS + COPY_FILTERS
    out: np.ndarray  # FILTERS + COPY_FILTERS
    out_bias: float

    @staticmethod
    def laid_out(spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
        """All spans in one array, each after its context and before padding that no window crosses,
        and where each starts."""
        parts, starts, at = [], np.empty(len(spans), np.int64), 0
        for i, (context, body, _) in enumerate(spans):
            room = max(CHUNK, -(-(len(body) + HALF) // HALF) * HALF)
            starts[i] = at + HALF
            parts += [context, body, PADDING[: room - len(body)]]
            at += HALF + room
        parts.append(PADDING[:CHUNK])
        return np.frombuffer(b"".join(parts), np.uint8), starts

    @staticmethod
    def copies(data: np.ndarray) -> np.ndarray:
        """The copy channels of every chunk of the laid-out bytes, the last half chunk left out."""
        body = data[HALF:]
        same = np.empty((LAGS - 1, len(body) // HALF), np.float32)
        for row, lag in enumerate(range(2, LAGS + 1)):
            bits = np.bitwise_count((body == data[HALF - lag : len(data) - lag]).view(np.uint64)).reshape(-1, HALF // 8)
            same[row] = bits[:, 0] + bits[:, 1] + bits[:, 2] + bits[:, 3]
        shares = np.empty((same.shape[1] - 1, LAGS), np.float32)
        shares[:, :-1] = ((same[:, :-1] + same[:, 1:]) / CHUNK).T
        shares[:, -1] = shares[:, :-1].max(axis=1)
        return shares

    def pooled(self, spans: list[Span], learn: bool = False):
        """The largest response of each filter in each span: spans x filters.

        With ``learn`` also what the maxima come from: the bytes of the windows of the first bank
        (spans x FILTERS x WIDTH) and the copy channels of the second (spans x COPY_FILTERS x LAGS).
        """
        data, starts = self.laid_out(spans)
        sizes, inner = np.array([len(body) for _, body, _ in spans]), np.array([size for _, _, size in spans])
        n = (len(data) - WIDTH) // STRIDE + 1
        response = self.tables[0].take(data[: (n - 1) * STRIDE + 1 : STRIDE], axis=0)
        for k in range(1, WIDTH):
            response += self.tables[k].take(data[k : (n - 1) * STRIDE + k + 1 : STRIDE], axis=0)
        first, windows = starts // STRIDE, np.where(inner > 0, inner // STRIDE, np.maximum(1, -(-sizes // STRIDE)))
        cuts = np.stack([first, first + windows], axis=1).ravel()
        top = np.maximum.reduceat(response, cuts, axis=0)[::2]
        shares = self.copies(data)
        copied = np.zeros((len(shares), COPY_FILTERS), np.float32)
        for lag in range(LAGS):  # in a fixed order, whatever the number of chunks
            copied += shares[:, lag, None] * self.copy[lag]
        chunk, chunks = (starts - HALF) // HALF, np.where(inner > 0, inner // HALF, np.maximum(1, -(-sizes // HALF) - 1))
        cuts = np.stack([chunk, chunk + chunks], axis=1).ravel()
        best = np.concatenate([top, np.maximum.reduceat(copied, cuts, axis=0)[::2]], axis=1) + self.bias
        if not learn:
            return best
        seen, channels = np.empty((len(spans), FILTERS, WIDTH), np.uint8), np.empty((len(spans), COPY_FILTERS, LAGS), np.float32)
        for i in range(len(spans)):
            at = (first[i] + response[first[i] : first[i] + windows[i]].argmax(axis=0)) * STRIDE
            seen[i] = data[at[:, None] + np.arange(WIDTH)]
            channels[i] = shares[chunk[i] + copied[chunk[i] : chunk[i] + chunks[i]].argmax(axis=0)]
        return best, seen, channels

    @staticmethod
    def spans_of(text: bytes) -> Iterator[Span]:
        starts = range(0, max(1, len(text) - 2 * CHUNK), SPAN)
        for start in starts:
            context = text[start - HALF : start] if start else PADDING[:HALF]
            if start == starts[-1]:
                yield context, text[start:], 0
            else:
                yield context, text[start : start + SPAN + 2 * CHUNK], SPAN

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One score a text, over the windows of the whole text."""
        spans, owner, scores, held = [], [], np.full((len(texts), len(self.bias)), -np.inf, np.float32), 0

        def flush():
            np.maximum.at(scores, np.array(owner), self.pooled(spans))
            spans.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for span in self.spans_of(text):
                spans.append(span)
                owner.append(i)
                held += len(span[1])
                if held >= SPAN:
                    flush()
                    held = 0
        if spans:
            flush()
        logits = np.full(len(texts), self.out_bias, np.float64)
        for k, weight in enumerate(self.out.astype(np.float64)):
            logits += np.maximum(scores[:, k], 0) * weight
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray, *, epochs: int = 14, rate: float = 0.02, rejected_weight: float = 3.0, seed: int = 11) -> ByteConvNet:
        """Adam on the logistic loss; a pooled maximum passes its gradient to the one window it is from.

        ``rejected_weight`` counts a label 0 so many times, as good texts are the greater part.
        """
        rng = np.random.default_rng(seed)
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
        total = FILTERS + COPY_FILTERS
        net = cls(
            rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.3, (LAGS, COPY_FILTERS)).astype(np.float32),
            np.zeros(total, np.float32), rng.normal(0, 0.3, total).astype(np.float32), float(np.log(share / (1 - share))),
        )
        if len(labels) == 0 or labels.min() == labels.max():
            net.out[:] = 0
            if len(labels) == 0:
                net.out_bias = 0.0
            return net
        params = [net.tables, net.bias, net.out, net.copy, np.array([net.out_bias], np.float32)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for batch in np.array_split(order, max(1, len(order) // 32)):
                grads = [np.zeros_like(p) for p in params]
                response, seen, channels = net.pooled([(PADDING[:HALF], texts[i], 0) for i in batch], learn=True)
                hidden = np.maximum(response, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[4][0], -30, 30)))
                d = ((p - labels[batch]) * np.where(labels[batch] > 0, 1, rejected_weight) / len(batch)).astype(np.float32)
                grads[2] += d @ hidden
                grads[4][0] += d.sum()
                back = d[:, None] * params[2] * (response > 0)
                grads[1] += back.sum(axis=0)
                grads[3] += np.einsum("ncl,nc->lc", channels, back[:, FILTERS:])
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (seen[:, :, k], np.arange(FILTERS)), back[:, :FILTERS])
                step += 1
                lr = rate * (1 - epoch / epochs)
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        net.out_bias = float(params[4][0])
        return net


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text leaves remainder 0: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 2000, max_bytes: int = 24_000_000) -> ByteConvNet:
    """Fit on at most ``max_rows`` labelled, not held-out rows and ``max_bytes`` of text.

    The rows are those with the lowest hash of the id, but up to a quarter of ``max_rows`` of either
    class come first, so that a rare class is learned, too; both bounds are fixed sizes of a learning
    sample, whatever the size of the corpus. Texts are used whole: one that does not fit into what is
    left of ``max_bytes`` is passed over.
    """
    known = (
        labels.select("doc_id", F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen: dict = {}
    for some, most in ((known.where("y = 0"), max_rows // 4), (known.where("y = 1"), max_rows // 4), (known, max_rows)):
        for row in some.orderBy(*order).limit(most).collect():
            if len(chosen) < max_rows:
                chosen[row.doc_id] = row.y
    if not chosen:
        return ByteConvNet.fit([], np.zeros(0))
    sample = docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", text_or_empty().alias("text"))
    kept = sample.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(*order)  # max_rows at most
    texts, marks, total = [], [], 0
    for row in kept.toLocalIterator():
        text = row["text"].encode()
        if total + len(text) <= max_bytes:
            total += len(text)
            texts.append(text)
            marks.append(chosen[row["doc_id"]])
    return ByteConvNet.fit(texts, np.array(marks, np.float64))


def score_quality(docs: DataFrame, net: ByteConvNet, *, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id alone by default), score and predicted of each row, from its whole text."""
    keep = keep or ["doc_id"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = net.probabilities([t.encode() for t in batch.column(len(keep)).to_pylist()])
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, "score"])

        return work

    frame = docs.select(*keep, text_or_empty().alias("__text"))
    scored = map_rows(frame, [*keep, "__text"], make, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
