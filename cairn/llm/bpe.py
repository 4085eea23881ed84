"""Operator 6, byte-level BPE by monoid tree reduction; decoding concatenates up the tree.

A pre-token is encoded by halves: either half is encoded on its own, and the two results are joined.
Joining re-encodes a window around the seam, one token of either side at first, and grows it until
the tokens outside provably stay: a sequence of tokens is the encoding of its bytes exactly when each
two neighbours are the encoding of theirs. Inside the halves and inside the window that holds, as
they are encodings; so only the two pairs at the window's ends are looked at.

Joining is associative, so any split gives the same ids. Short spans (``LEAF`` bytes) are merged
directly, by rank, leftmost first. Distinct segments of a text are encoded once for each worker
(see ``segments``), and only there is the tree built.

Odd rows: a null or empty text has no ids, and digests of no bytes; repeated rows give repeated
results; strings of special tokens are plain text. Only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import map_rows, text_or_empty
from cairn.llm.segments import Bounded, SegmentTable, segment_text

LEAF = 4
#: Ids that are decoded at once at the leaves of the decoding tree.
DECODED = 256
#: Spans up to this length are remembered: leaves and windows of different words are often alike.
SHORT, SHORT_KEPT = 14, 250_000
_NONE = 1 << 40


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self._bytes = [ranks[bytes([b])] for b in range(256)]
        #: Two ids side by side, as one number, to the id that they merge into.
        self._merge = {
            (ranks[a] << 20) + ranks[b]: rank
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if (a := piece[:i]) in ranks and (b := piece[i:]) in ranks
        }
        self._stable: dict[int, bool] = {}
        self._short: dict[bytes, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> TreeBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """Merge by lowest rank, leftmost first, until no two neighbours form a piece.

        The list is shared between calls; it is never changed.
        """
        known = self._short.get(data)
        if known is not None:
            return known
        ids = self._merged(data)
        if len(data) <= SHORT:
            if len(self._short) >= SHORT_KEPT:
                self._short.clear()
            self._short[data] = ids
        return ids

    def _merged(self, data: bytes) -> list[int]:
        if len(data) > 64:
            return self._merged_by_heap(data)
        merge, table = self._merge, self._bytes
        ids = [table[b] for b in data]
        ranks = [merge.get((a << 20) + b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            ids[at] = best
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merge.get((best << 20) + ids[at + 1], _NONE)
            if at:
                ranks[at - 1] = merge.get((ids[at - 1] << 20) + best, _NONE)
        return ids

    def _merged_by_heap(self, data: bytes) -> list[int]:
        """The same for long spans: neighbours in a heap, parts as a linked list over start places."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        pair = (left << 20) + right
        known = self._stable.get(pair)
        if known is None:
            if len(self._stable) > 400_000:
                self._stable.clear()
            # Straight from the merges: the pieces of a pair are rarely seen again.
            known = self._stable[pair] = self._merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left or right
        # The seam may hold as it is: then nothing is re-encoded.
        if self.stable(left[-1], right[0]):
            return left + right
        i, j, pieces = 1, 1, self.pieces
        while True:
            if i == j == 1:
                window = self.merged(pieces[left[-1]] + pieces[right[0]])
            else:
                window = self.merged(b"".join([pieces[t] for t in left[-i:]] + [pieces[t] for t in right[:j]]))
            left_holds = i >= len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j >= len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = min(len(left), i if left_holds else 2 * i), min(len(right), j if right_holds else 2 * j)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        middle = len(data) // 2
        return self.join(self._tree(data[:middle]), self._tree(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: halves are decoded and concatenated, leaves at once."""
        if len(ids) > DECODED:
            middle = len(ids) // 2
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def worker_bpe(ranks_path: str, pattern: str) -> tuple[TreeBpe, SegmentTable]:
    """One per Python worker: it outlives a task."""
    import regex

    bpe = TreeBpe.from_file(ranks_path)
    words, known = regex.compile(pattern).findall, Bounded()

    def compute(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs, sizes = array("I"), []
        for key in keys.to_pylist():
            before = len(runs)
            for word in words(segment_text(key)):
                found = known.get(word)
                if found is None:
                    found = bpe.encode(word.encode())
                    known.keep(word, found)
                runs.extend(found)
            sizes.append(len(runs) - before)
        return np.array(runs, "<u4"), np.array(sizes, np.int64)

    return bpe, SegmentTable(compute, np.dtype("<u4"))


def encode_texts(table: SegmentTable, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    ids, at = table.gathered(texts)
    packed, places = memoryview(ids.tobytes()), (at * 4).tolist()
    return [bytes(packed[a:b]) for a, b in zip(places, places[1:], strict=False)]


def bpe_round_trip(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves with ``with_ids``."""
    import public_tokenizers

    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))

    def make():
        bpe, table = worker_bpe(ranks, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = encode_texts(table, batch.column(1).to_pylist())
            lists = [np.frombuffer(p, "<u4").tolist() for p in packed]
            columns = [
                batch.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in lists], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int64()))] if with_ids else []), names=schema.names)

        return work

    return map_rows(docs.select(id_col, text_or_empty(text_col).alias("__text")), [id_col, "__text"], make, schema)
