"""Splitting texts where no pre-token can cross, and remembering what each segment turns into.

The byte-level pre-token pattern (``public_tokenizers.PATTERN``) never lets a match run over a
space that stands alone between two non-white characters: white-space runs are matched apart from
everything else, and a single space can only open the match of what follows it. So

    text  =  head + " " + part + " " + part ...       (cut at such spaces)

and the ids of the text are the ids of ``head`` followed by those of every ``" " + part``. The same
holds before a line feed that stands alone, and between a letter or digit and a mark: matches of
letters, of digits and of other characters end where the kind of character changes, and where two
kinds share a match (a contraction), the mark comes first.

Words repeat, so a batch is cut and its distinct segments are numbered in Arrow, each is worked out
once, and results are gathered by number in numpy.

A segment is whatever stands between cuts, so it may be a whole text (of a script without spaces,
say). Only keys up to ``LONGEST`` bytes are remembered, and at most ``KEPT`` of them, so what a worker
remembers is bounded, whatever the texts.
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: All that Python or a tokenizer's pattern takes for white space.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts that are cut at lone spaces only, for white space at either end or side by side, or not at all, for the character
#: that keys of marks begin with.
_OTHER = rf"{WHITE}{WHITE}|^{WHITE}|{WHITE}$|\x01"
#: A letter (of those that every version of Unicode has as such) or digit, then an ASCII mark that opens no contraction.
_MARKED = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-\x60{-~])"

#: Keys that are remembered; when there are more, the half that was used most stays.
KEPT = 500_000
#: Longest key that is remembered, in bytes.
LONGEST = 64
#: Segments whose values are gathered at a time.
_BLOCK = 250_000


def segment_text(key: str) -> str:
    """The text of a key: the head's has a space in front, a segment's after a space none, one of
    a mark the character 1, and a line feed stays."""
    return key[1:] if key[:1] in (" ", "\x01") else key if key[:1] == "\n" else " " + key


def keyed(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct keys, number of each segment's key, where each text's segments begin and end).

    ``segment_text`` of a text's keys, joined, is the text.
    """
    whole = pa.array(texts, pa.large_string())
    other = pc.match_substring_regex(whole, _OTHER).to_numpy(zero_copy_only=False)
    slow, plain = np.flatnonzero(other), np.flatnonzero(~other)
    cut = pc.replace_substring_regex(whole.take(pa.array(plain)) if len(slow) else whole, _MARKED, "\\1 \x01\\2")
    cut = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
    if len(slow):
        cut = pa.concat_arrays([cut, pa.array([[t] if "\x01" in (t := texts[i]) else _LONE_SPACE.split(t) for i in slow.tolist()], cut.type)])
    parts, ends = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    coded = parts.dictionary_encode()
    at = np.array(coded.indices, np.int64)
    heads = pc.binary_join_element_wise(pa.scalar("", parts.type), parts.take(pa.array(ends[:-1])), pa.scalar(" ", parts.type)).dictionary_encode()
    at[ends[:-1]] = len(coded.dictionary) + np.array(heads.indices, np.int64)
    used = np.zeros(len(coded.dictionary) + len(heads.dictionary), bool)  # a head's own form may have no other use
    used[at] = True
    keys = pa.concat_arrays([coded.dictionary, heads.dictionary]).filter(pa.array(used))
    at = (np.cumsum(used) - 1)[at]
    if len(slow):  # back to the order of the texts
        order = np.argsort(np.concatenate([plain, slow]), kind="stable")
        sizes = np.diff(ends)[order]
        moved = np.repeat(ends[:-1][order], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = at[moved + np.arange(len(at)) - np.repeat(ends[:-1], sizes)]
    return keys, at, ends


class Bounded(dict):
    """A dictionary of short keys that is emptied when what it holds is above a number of bytes."""

    def __init__(self, most: int = 32 * 1024 * 1024):
        self._most, self._held = most, 0

    def keep(self, key, value) -> None:
        if len(key) > LONGEST:
            return
        if self._held > self._most:
            self.clear()
            self._held = 0
        self._held += sys.getsizeof(key) + sys.getsizeof(value) + 104
        self[key] = value


class SegmentTable:
    """What keys turn into: a run of numbers each, held as one array of all runs.

    ``compute(keys)`` gives (the runs of an array of keys one after the other, the size of each).
    """

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype: np.dtype, kept: int = KEPT):
        # What is held here has no cycles, so the collector may look seldom.
        gc.set_threshold(200_000, 50, 100)
        self._compute, self._kept = compute, kept
        self._keys = pa.array([], pa.large_string())
        self._pool, self._sizes, self._begins = np.empty(0, dtype), np.empty(0, np.int64), np.empty(0, np.int64)
        self._used = np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self._keys)

    def runs(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin of each key's run in it, its size); the keys are distinct."""
        where = pc.index_in(keys, value_set=self._keys)
        missing = where.is_null().to_numpy(zero_copy_only=False)
        where = where.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self._used[where[~missing]] += 1
        if not missing.any():
            return self._pool, self._begins[where], self._sizes[where]
        new = keys.filter(pa.array(missing))
        runs, sizes = self._compute(new)
        begins = np.cumsum(sizes) - sizes + len(self._pool)
        pool = np.concatenate([self._pool, runs])
        all_begins, all_sizes = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        all_begins[missing], all_sizes[missing] = begins, sizes
        all_begins[~missing], all_sizes[~missing] = self._begins[where[~missing]], self._sizes[where[~missing]]
        short = pc.less_equal(pc.binary_length(new), LONGEST).to_numpy(zero_copy_only=False)
        self._keep(new, runs, sizes, short)
        return pool, all_begins, all_sizes

    def _keep(self, new: pa.Array, runs: np.ndarray, sizes: np.ndarray, short: np.ndarray) -> None:
        self._keys = pa.concat_arrays([self._keys, new.filter(pa.array(short))])
        self._pool = np.concatenate([self._pool, runs[np.repeat(short, sizes)]])
        self._sizes = np.concatenate([self._sizes, sizes[short]])
        self._used = np.concatenate([self._used, np.ones(int(short.sum()), np.int64)])
        if len(self._keys) > self._kept:
            stays = np.sort(np.argsort(-self._used, kind="stable")[: self._kept // 2])
            mask = np.zeros(len(self._keys), bool)
            mask[stays] = True
            self._pool = self._pool[np.repeat(mask, self._sizes)]
            self._keys, self._sizes, self._used = self._keys.filter(pa.array(mask)), self._sizes[mask], self._used[mask] // 2
        self._begins = np.cumsum(self._sizes) - self._sizes

    def gathered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all texts' segments one after the other, and the place where each text begins
        (and the last one ends)."""
        keys, at, ends = keyed(texts)
        pool, begins, sizes = self.runs(keys)
        upto = np.concatenate([[0], np.cumsum(sizes[at])])
        out = np.empty(int(upto[-1]), pool.dtype)
        for a in range(0, len(at), _BLOCK):
            some = at[a : a + _BLOCK]
            first, last = int(upto[a]), int(upto[a + len(some)])
            shift = np.repeat(begins[some] - upto[a : a + len(some)], sizes[some])
            out[first:last] = pool[shift + np.arange(first, last)]
        return out, upto[ends]
