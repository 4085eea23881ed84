"""Ids of whole texts from the tokenizers library, each distinct segment encoded once a worker.

New segments of an Arrow batch are encoded together, as one text: every part brings its own lone
space or line feed, no pre-token crosses it, and the ids that open with one mark where parts begin. Where
those marks do not fit the parts, and for parts with other white space inside, each is encoded alone.
A part of Latin letters alone is one pre-token, so such parts are handed to the library's model as
pre-tokens; it need not look for them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.llm.segments import WHITE, SegmentTable, segment_text

#: Nothing, a head, a mark, or white space after the first character.
_ALONE = rf"(?s)^$|^[ \x01]|^.+{WHITE}"
#: Letters of every version of Unicode: a segment of these is one pre-token with the space before it.
_LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: Segments that are encoded as one text.
_TOGETHER = 20_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SegmentEncoder:
    """``encode(texts)`` gives the ids of all texts as numbers of type ``dtype``, and their bounds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = Tokenizer(self._tokenizer.model)
        letters = _byte_letters()
        self._letters = letters | {10: "\n" + letters[32]}  # line feeds part the words here, and each gets its space
        self._tokenizer.encode_special_tokens = True  # strings of special tokens are plain text
        vocabulary = self._tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 65_536 else "<u4")
        self._opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for piece, number in vocabulary.items():
            self._opens[number] = piece.startswith(("Ġ", "Ċ"))  # space and line feed in the byte-level alphabet
        self._table = SegmentTable(self._runs, self.dtype)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words of letters, each after a space."""
        mapped = ("\n" + "\n".join(words)).encode().decode("latin-1").translate(self._letters).split("\n")[1:]
        return self._parted(self._model.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, len(words))

    def _together(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all parts, size of each), or None if their opening ids do not tell the parts apart."""
        return self._parted(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, n)

    def _parted(self, found: list[int], n: int) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(found, self.dtype)
        cuts = np.flatnonzero(self._opens[ids])
        if len(cuts) != n or (n and cuts[0]):
            return None
        return ids, np.diff(np.append(cuts, len(ids)))

    def _alone(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast([segment_text(k) for k in keys], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.dtype), np.array([len(ids) for ids in found], np.int64)

    def _runs(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        fits = lambda pattern: pc.match_substring_regex(keys, pattern).to_numpy(zero_copy_only=False)
        alone, letters, line = fits(_ALONE), fits(_LETTERS), fits("^\n")
        runs, sizes, order = [], [], []
        for kind, group in enumerate((~alone & ~letters & ~line, line & ~alone, alone, letters & ~alone)):
            at = np.flatnonzero(group)
            for a in range(0, len(at), _TOGETHER):
                some = at[a : a + _TOGETHER]
                own = keys.take(pa.array(some)).to_pylist()
                found = None if kind == 2 else self._words(own) if kind == 3 else self._together("".join(own) if kind else " " + " ".join(own), len(own))
                found = found or self._alone(own)
                runs.append(found[0])
                sizes.append(found[1])
                order.append(some)
        if not order:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        pool, size = np.concatenate(runs), np.concatenate(sizes)
        begin, back = np.cumsum(size) - size, np.argsort(np.concatenate(order))
        size, begin = size[back], begin[back]
        upto = np.cumsum(size) - size
        return pool[np.repeat(begin - upto, size) + np.arange(len(pool))], size

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids begin and end): the ids of text i are ``ids[at[i]:at[i + 1]]``.

        With ``end_id``, each text's ids end with it.
        """
        ids, at = self._table.gathered(texts)
        if end_id is None:
            return ids, at
        ended = np.full(len(ids) + len(texts), end_id, self.dtype)
        ended[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(at))] = ids
        return ended, at + np.arange(len(at))


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> SegmentEncoder:
    """One per Python worker: it outlives a task."""
    return SegmentEncoder(path)
