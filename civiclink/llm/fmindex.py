"""A word-level FM-index of one text shard: suffix array, wavelet matrix, sampled suffix positions.

The shard is a sequence of word numbers; 0 stands behind every document piece, so no phrase can
run over an end. Searching and locating handle all phrases of a call together, in arrays.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16
ONE = np.uint64(1)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. Sorts by the first few symbols at once, then by
    twice as many in each round, always only what is still tied."""
    n = len(seq)
    width = max(1, int(seq.max(initial=0) + 1).bit_length())
    step = max(1, 62 // width)
    padded = np.concatenate([seq.astype(np.int64) + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = (key << width) | padded[i : i + n]
    order = np.argsort(key)
    slots = np.arange(n)
    key = key[order]
    rank = np.full(n + 1, -1, np.int64)
    while len(slots):
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        group = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank[order[slots]] = group
        tied = ~(first & np.append(first[1:], True))
        slots, group = slots[tied], group[tied]
        here = order[slots]
        key = group * (n + 1) + rank[np.minimum(here + step, n)] + 1
        again = np.argsort(key)
        order[slots] = here[again]
        key = key[again]
        step *= 2
    return order


class Index:
    """rows: bit rows of the wavelet matrix, highest bit first; counts: how often each symbol occurs;
    marks: which rows of the suffix array are sampled; samples: their positions."""

    def __init__(self, length: int, rows: list[bytes] | bytes, counts: np.ndarray, marks: bytes, samples: np.ndarray):
        self.n = length
        self.levels = max(1, int(len(counts) - 1).bit_length())
        words = _words_of(length)
        self.words = np.frombuffer(rows if isinstance(rows, bytes) else b"".join(rows), np.uint64).reshape(self.levels, words)
        self.ones = _running(self.words)
        self.zeros = length - self.ones[:, -1]
        self.marks = np.frombuffer(marks, np.uint64)
        self.marked = _running(self.marks[None, :])[0]
        self.samples = samples
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    @staticmethod
    def build(seq: np.ndarray, symbols: int, starts: np.ndarray) -> dict[str, bytes]:
        """Parts of an index of `seq`. A document start and every SAMPLE-th word after it are sampled,
        so a walk back to a sample never crosses a document end."""
        n, levels = len(seq), max(1, int(symbols - 1).bit_length())
        order = suffix_array(seq)
        current = seq[order - 1].astype(np.uint32)
        rows = []
        for level in range(levels - 1, -1, -1):
            bit = ((current >> np.uint32(level)) & np.uint32(1)).astype(bool)
            rows.append(_packed(bit))
            current = np.concatenate([current[~bit], current[bit]])
        owner = np.repeat(starts, np.diff(np.append(starts, n)))
        sampled = ((np.arange(n) - owner) % SAMPLE == 0)[order]
        return {
            "rows": b"".join(rows),
            "counts": np.bincount(seq, minlength=symbols).astype(np.int32).tobytes(),
            "marks": _packed(sampled),
            "samples": order[sampled].astype(np.int32).tobytes(),
        }

    def _rank(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before row i, and the bit in row i."""
        word = self.words[level, i >> 6]
        shift = (i & 63).astype(np.uint64)
        return self.ones[level, i >> 6] + np.bitwise_count(word & ((ONE << shift) - ONE)), (word >> shift) & ONE

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones, _ = self._rank(level, i)
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [low, high) of each phrase; phrases are right-aligned rows of symbols >= 1."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        known, base = np.unique(phrases), None
        base = self.before[np.minimum(known, len(self.before) - 1)] - self._follow(known, np.zeros(len(known), np.int64))
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -back]
            shift = base[np.searchsorted(known, symbol)]
            low[live] = self._follow(symbol, low[live]) + shift
            high[live] = self._follow(symbol, high[live]) + shift
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row of the suffix array."""
        found, left = np.full(len(row), -1, np.int64), np.arange(len(row))
        row, walked = row.copy(), 0
        while len(left):
            shift = (row & 63).astype(np.uint64)
            word = self.marks[row >> 6]
            hit = ((word >> shift) & ONE).astype(bool)
            at = self.marked[row >> 6] + np.bitwise_count(word & ((ONE << shift) - ONE))
            found[left[hit]] = self.samples[at[hit]] + walked
            row, left = row[~hit], left[~hit]
            symbol, i = np.zeros(len(row), np.int64), row
            for level in range(self.levels):
                ones, bit = self._rank(level, i)
                symbol = (symbol << 1) | bit.astype(np.int64)
                i = np.where(bit.astype(bool), self.zeros[level] + ones, i - ones)
            row = self.before[symbol] + i - self._follow(symbol, np.zeros(len(row), np.int64))
            walked += 1
        return found


def _words_of(n: int) -> int:
    return (n >> 6) + 1


def _packed(bits: np.ndarray) -> bytes:
    octets = np.packbits(bits, bitorder="little").tobytes()
    return octets.ljust(8 * _words_of(len(bits)), b"\0")


def _running(words: np.ndarray) -> np.ndarray:
    sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
    return np.concatenate([np.zeros((len(words), 1), np.int64), sums], axis=1)
