"""Operator 1, token counts: linear longest-match over a vocabulary trie.

Greedy word-piece segmentation takes, from left to right, the longest vocabulary entry that starts
where the last one ended. The automaton walks every byte once. A trie node at which no edge fits
follows its failure link: the node reached after the pieces that are by then certain have been
popped. How many those are is fixed when the automaton is built, so the walk adds numbers and never
builds a piece.

Results for odd rows: a null or empty text has 0 tokens and 0 words; repeated rows give repeated
results; other columns of the input are not touched and cannot clash, as only ``doc_id`` and the
text are read. A word that the vocabulary cannot spell counts as one unknown piece, as in word-piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import map_rows, text_or_empty
from cairn.llm.segments import Bounded, SegmentTable, keyed, segment_text


class LongestMatch:
    """Counts greedy longest-match pieces of one word.

    ``first``: pieces that may open a word; ``rest``: pieces that may follow (the same ones if None).
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes] | None = None):
        self.edges: list[dict[int, int]] = [{}]
        self._final: list[bool] = [False]
        for word in first:
            self._insert(0, word)
        if rest is None:
            self.resume = 0
        else:
            self.resume = self._node()
            for word in rest:
                self._insert(self.resume, word)
        self._link()

    def _node(self) -> int:
        self.edges.append({})
        self._final.append(False)
        return len(self.edges) - 1

    def _insert(self, root: int, word: bytes) -> None:
        if not word:
            return
        at = root
        for byte in word:
            nxt = self.edges[at].get(byte)
            if nxt is None:
                nxt = self._node()
                self.edges[at][byte] = nxt
            at = nxt
        self._final[at] = True

    def _link(self) -> None:
        """Breadth first: a node's link depends on shallower nodes only.

        ``fail[v]`` is -1 where nothing can follow; ``popped[v]`` counts the pieces that are settled
        on the way over that link.
        """
        edges, final, resume = self.edges, self._final, self.resume
        fail, popped = [-1] * len(edges), [0] * len(edges)
        level = [0] if resume == 0 else [0, resume]
        while level:
            below = []
            for parent in level:
                for byte, node in edges[parent].items():
                    below.append(node)
                    if final[node]:
                        fail[node], popped[node] = resume, 1
                        continue
                    at, count = fail[parent], popped[parent]
                    while at >= 0 and byte not in edges[at]:
                        count += popped[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], popped[node] = edges[at][byte], count
            level = below
        self.fail, self.popped = fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 if it cannot be spelt; 0 for an empty one."""
        edges, fail, popped, resume = self.edges, self.fail, self.popped, self.resume
        at = total = 0
        for byte in word:
            while (nxt := edges[at].get(byte)) is None:
                if fail[at] < 0:
                    return 1
                total += popped[at]
                at = fail[at]
            at = nxt
        while at not in (0, resume):
            if fail[at] < 0:
                return 1
            total += popped[at]
            at = fail[at]
        return total


@lru_cache(maxsize=2)
def _counter(vocabulary: str, pattern: str) -> SegmentTable:
    """One per Python worker: it outlives a task."""
    import regex

    with open(vocabulary, "rb") as lines:
        automaton = LongestMatch(base64.b64decode(line.split()[0]) for line in lines if line.strip())
    words, pieces = regex.compile(pattern).findall, Bounded()

    def compute(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers a key: pieces and words."""
        out = []
        for key in keys.to_pylist():
            found = words(segment_text(key))
            total = 0
            for word in found:
                n = pieces.get(word)
                if n is None:
                    n = automaton.count(word.encode())
                    pieces.keep(word, n)
                total += n
            out += [total, len(found)]
        return np.array(out, np.int64), np.full(len(keys), 2, np.int64)

    return SegmentTable(compute, np.dtype(np.int64))


def token_counts(
    docs: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_bytes, n_words (pre-tokens), n_tokens (greedy longest-match pieces) of each row.

    ``vocabulary`` is a rank file with one base-64 piece a line; ``pattern`` cuts texts into words.
    One narrow pass, no shuffle; the whole text of every row counts.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def make():
        table = _counter(vocabulary, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            keys, at, ends = keyed(texts)
            pool, begins, _ = table.runs(keys)
            found = np.stack([pool[begins], pool[begins + 1]], axis=1)
            upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(found[at], axis=0)])
            sums = upto[ends[1:]] - upto[ends[:-1]]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(sums[:, 1]), pa.array(sums[:, 0])], names=[id_col, "n_bytes", "n_words", "n_tokens"]
            )

        return work

    frame = docs.select(id_col, text_or_empty(text_col).alias("text"))
    return map_rows(frame, [id_col, "text"], make, schema)
