"""Distances that Spark has no function for, over whole batches of pairs at a time."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _characters(words: list[str], width: int, fill: int) -> np.ndarray:
    """Code points of every word, one row each, filled up to ``width`` columns."""
    out = np.full((len(words), width), fill, np.int64)
    for i, word in enumerate(words):
        out[i, : len(word)] = np.frombuffer(word.encode("utf-32-le"), "<u4")
    return out


def osa_many(left: list[str], right: list[str]) -> np.ndarray:
    """Edits between the strings of each pair, a swap of neighbours being one; no part is edited twice.

    One table for all pairs: cell (i, j) is an array over the pairs, and each pair's answer is read at
    its own lengths.
    """
    n, m = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    rows, columns = int(n.max(initial=0)), int(m.max(initial=0))
    a, b = _characters(left, rows, -1), _characters(right, columns, -2)
    table = np.zeros((rows + 1, columns + 1, len(left)), np.int64)
    table[:, 0], table[0, :] = np.arange(rows + 1)[:, None], np.arange(columns + 1)[:, None]
    for i in range(1, rows + 1):
        for j in range(1, columns + 1):
            cell = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + (a[:, i - 1] != b[:, j - 1]))
            if i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                cell = np.where(swapped, np.minimum(cell, table[i - 2, j - 2] + 1), cell)
            table[i, j] = cell
    return table[n, m, np.arange(len(left))]


def osa(left: str, right: str) -> int:
    return int(osa_many([left], [right])[0])


#: Columns of the letters of a word: a letter's first, second and further copies, letters folded to 32 kinds.
_KINDS, _COPIES = 32, 3
#: Characters of the longest words whose distances fit a machine word.
_WORD_BITS = 64
#: Pairs whose edits are counted at a time.
_AT_ONCE = 1 << 18


def _letters(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Copies of every letter of each word. The product of two rows is no less than the letters that the words share:
    where letters fall together, the product of their numbers is no less than what they share."""
    out = np.zeros((len(codes), _COPIES * _KINDS), np.float32)
    rows = np.arange(len(codes))
    for at in range(codes.shape[1]):
        before = ((codes[:, :at] == codes[:, at : at + 1]) & (at < sizes)[:, None]).sum(axis=1)
        np.add.at(out, (rows, np.minimum(before, _COPIES - 1) * _KINDS + codes[:, at] % _KINDS), at < sizes)
    return out


def _edits(masks: np.ndarray, left: np.ndarray, sizes: np.ndarray, texts: np.ndarray, lengths: np.ndarray, swaps: bool) -> np.ndarray:
    """Edits of pairs by Hyyro's bit vectors: a column of the table is two machine words. ``masks``: where each left word has each
    letter; ``left``: its row there; ``sizes``: its length; ``texts``: letters of the right words by number, ``lengths`` theirs."""
    one, full = np.uint64(1), np.uint64(2**64 - 1)
    up, down, last = np.full(len(left), full), np.zeros(len(left), np.uint64), one << (sizes - 1).astype(np.uint64)
    diagonal, earlier, out = np.zeros(len(left), np.uint64), np.zeros(len(left), np.uint64), sizes.astype(np.int64)
    for at in range(int(lengths.max(initial=0))):
        same = masks[left, texts[:, at]]
        swapped = ((~diagonal & same) << one) & earlier if swaps else None
        diagonal = (((same & up) + up) ^ up) | same | down
        if swaps:
            diagonal |= swapped
        rises, falls = down | ~(diagonal | up), diagonal & up
        live = at < lengths
        out += (((rises & last) != 0).astype(np.int64) - ((falls & last) != 0)) * live
        rises, falls = (rises << one) | one, falls << one
        up, down, earlier = falls | ~(diagonal | rises), rises & diagonal, same
    return out


def near_pairs(left: list[str], right: list[str], most: np.ndarray, swaps: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left number, right number, edits) of all pairs within a left word's ``most`` edits, by optimal string alignment or,
    without ``swaps``, Levenshtein distance. Right words are of one length.

    Words within k edits share all but k letters of the longer one, counted with their copies: one product of matrices
    says how many pairs can share. Of those that can, the edits are counted.
    """
    n, m = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    a, b = _characters(left, int(n.max(initial=0)), 0), _characters(right, int(m.max(initial=0)), 0)
    least = (np.maximum(n, m.max(initial=0)) - most).astype(np.float32)
    i, j = np.nonzero(_letters(a, n) @ _letters(b, m).T >= least[:, None])
    known, b = np.unique(b, return_inverse=True)
    b = b.reshape(len(right), -1)
    masks = np.zeros((len(left), len(known)), np.uint64)
    for at in range(min(a.shape[1], _WORD_BITS)):
        place = np.minimum(np.searchsorted(known, a[:, at]), len(known) - 1)
        has = (known[place] == a[:, at]) & (at < n)
        masks[np.flatnonzero(has), place[has]] |= np.uint64(1 << at)
    edits = np.zeros(len(i), np.int64)
    for at in range(0, len(i), _AT_ONCE):
        own, other = i[at : at + _AT_ONCE], j[at : at + _AT_ONCE]
        edits[at : at + _AT_ONCE] = _edits(masks, own, n[own], b[other], m[other], swaps)
    for k in np.flatnonzero(n[i] > _WORD_BITS):  # words longer than a machine word, one by one
        edits[k] = osa(left[i[k]], right[j[k]]) if swaps else levenshtein(left[i[k]], right[j[k]])
    close = edits <= most[i]
    return i[close], j[close], edits[close]


def levenshtein(left: str, right: str) -> int:
    row = np.arange(len(right) + 1)
    b = np.array([ord(c) for c in right])
    for i, c in enumerate(left, 1):
        cell = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != ord(c)))])
        row = np.minimum.accumulate(cell - np.arange(len(cell))) + np.arange(len(cell))
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(osa_many(left.fillna("").tolist(), right.fillna("").tolist()), dtype="int32")


#: How alike names must be to be offered for one another (difflib's ratio).
ALIKE = 0.55
#: Letters, rare ones first; only the order's being fixed matters to what is found, rareness saves pairs.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


@F.pandas_udf(T.DoubleType())
def alike(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib's ratio of each pair."""
    matcher, out = difflib.SequenceMatcher(), []
    for a, b in zip(left, right, strict=True):
        if matcher.b != b:
            matcher.set_seq2(b)
        matcher.set_seq1(a)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def with_characters(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the characters of a text as an array, each with the number of its copies before it, in one fixed
    order, later copies and rare letters first. What two texts share of these is what they share as multisets."""
    rows = rows.withColumn(out, F.array_sort(F.filter(F.split(column, ""), lambda c: c != "")))
    rows = rows.withColumn(out, F.transform(out, lambda c, i: F.struct((F.array_position(out, c) - 1 - i).alias("copies"), F.instr(F.lit(RARE_FIRST), c).alias("rank"), c.alias("c"))))
    return rows.withColumn(out, F.transform(F.array_sort(out), lambda x: F.concat_ws(" ", x["copies"].cast("string"), x["c"])))
