"""Word shingles and minhash signatures of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: A-Z to a-z; every other byte stays.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = 0xFFFFFFFFFFFFFFFF
_WORDS_KEPT = 300_000
#: Longest word, in bytes, whose hash is remembered: memory is bounded by that and the number above.
_LONGEST = 64
#: A bitmap has 8 to 16 bits for each shingle, in these bounds: a larger set fills its bitmap more.
LEAST_BITS, MOST_BITS = 64, 2**17


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES = _odd(5, SHINGLE_WORDS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word to 64-bit hash; forgotten when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _LONGEST:
            if len(self) > _WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text.

    Words are runs of anything but ASCII white space, A-Z lowered. With fewer words, but at least
    one, the whole sequence is the one shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(hashes) < SHINGLE_WORDS:
        # The number of words takes part, so a short sequence differs from any full shingle.
        total = np.array([len(hashes)], np.uint64)
        for k in range(len(hashes)):
            total = mixed(total ^ hashes[k : k + 1] * _PLACES[k : k + 1])
        return total
    n = len(hashes) - SHINGLE_WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        total += mixed(hashes[k : k + n] * _PLACES[k] + np.uint64(k))
    out = mixed(total)
    out.sort()
    if n > 1:
        out = out[np.concatenate([[True], out[1:] != out[:-1]])]
    return out


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each value that the low bits of the shingles take; a power of two of bits."""
    size = min(max(1 << (8 * len(shingles) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Bitmaps:
    """Upper bounds of intersections from bitmaps. ``sizes``: the sizes of the whole sets.

    Every bit that one bitmap has and the other lacks is at least one shingle that the other set
    lacks, so no bound is below the true intersection. A longer bitmap is folded to the shorter's
    length, for which that holds as well.
    """

    def __init__(self, bitmaps: list[bytes], sizes: np.ndarray):
        self.sizes, self.words = sizes, np.array([len(b) // 8 for b in bitmaps], np.int64)
        self.row = np.zeros(len(bitmaps), np.int64)
        self._folded: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for words in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == words)
            self.row[at] = np.arange(len(at))
            bits = np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64).reshape(len(at), words)
            self._folded[words, words] = bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def _fold(self, words: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps of ``words`` words folded to ``to``, and how many bits each then has."""
        if (words, to) not in self._folded:
            bits = self._fold(words, 2 * to)[0]
            bits = bits[:, :to] | bits[:, to:]
            self._folded[words, to] = bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return self._folded[words, to]

    def most_common(self, x: int, to: np.ndarray) -> np.ndarray:
        """For each of ``to``, what its set and that of ``x`` can have in common at most."""
        out = np.zeros(len(to), np.int64)
        for words in np.unique(self.words[to]).tolist():
            at = np.flatnonzero(self.words[to] == words)
            short = min(words, int(self.words[x]))
            mine, count = self._fold(int(self.words[x]), short)
            bits, counts = self._fold(words, short)
            rows, own = self.row[to[at]], self.row[x]
            both = np.bitwise_count(bits[rows] & mine[own]).sum(axis=1, dtype=np.int64)
            out[at] = np.minimum(self.sizes[x] - (count[own] - both), self.sizes[to[at]] - (counts[rows] - both))
        return out


class TensoredMinHash:
    """Two collections of ``tables`` half keys, each made of ``width`` minhashes.

    A full table key joins one half key of either collection, so ``tables ** 2`` keys of
    ``2 * width`` minhashes come from only ``2 * tables * width`` of them.
    """

    def __init__(self, tables: int, width: int, seed: int = 9):
        self.tables, self.width = tables, width
        self.factors = _odd(seed, 2 * tables * width)[:, None]
        self.salts = mixed(np.arange(2 * tables, dtype=np.uint64) + np.uint64(seed))

    def halves(self, shingles: np.ndarray, block: int = 8192) -> tuple[np.ndarray, bytes]:
        """The half keys of both collections, as signed 64-bit numbers, of which equal ones agree in
        place too; and the lowest byte of every minhash, spread well, to estimate likeness from."""
        least = np.full(len(self.factors), _MASK, np.uint64)
        for start in range(0, len(shingles), block):
            np.minimum(least, (shingles[None, start : start + block] * self.factors).min(axis=1), out=least)
        keys = self.salts.copy()
        for column in least.reshape(-1, self.width).T:
            keys = mixed(keys ^ column)
        return keys.view(np.int64), mixed(least).astype(np.uint8).tobytes()
