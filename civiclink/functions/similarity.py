"""Name similarity on a 0-100 scale.

Spark has no weighted ratio, so the score runs as a small Arrow helper inside tasks. The
edit distance is Spark's own `levenshtein`. Definitions follow the public documentation of
the fuzzy-ratio family: indel ratio, sorted-token ratio, token-set ratio and partial ratio.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed weights of the combined score.
TOKEN_WEIGHT = 0.95
PARTIAL_WEIGHT, FAR_PARTIAL_WEIGHT = 0.9, 0.6
PARTIAL_FROM, FAR_FROM = 1.5, 8.0
# Scores closer than this count as equal.
NOISE = 1e-8


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one big integer as the row of the table."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _from_distance(distance: int, total: int) -> float:
    return 100.0 - 100.0 * distance / total if total else 100.0


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return (1.0 - (total - 2 * lcs_length(a, b)) / total) * 100.0 if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any stretch of the longer one up to its length."""
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


def _best_window(short: str, long: str) -> float:
    n = len(short)
    if not n:
        return 0.0 if long else 100.0
    best = 0.0
    for end in range(1, len(long) + n):
        best = max(best, ratio(short, long[max(0, end - n):end]))
        if best == 100.0:
            break
    return best


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    ta, tb = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(part)) for part in (ta & tb, ta - tb, tb - ta))


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_ratio(a: str, b: str) -> float:
    """Larger of the sorted-token ratio and the token-set ratio."""
    shared, only_a, only_b = _token_sets(a, b)
    if shared and not (only_a and only_b):
        return 100.0
    gap = 1 if shared else 0
    side_a, side_b = len(shared) + gap + len(only_a), len(shared) + gap + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * lcs_length(only_a, only_b)
    scores = [ratio(_sorted_tokens(a), _sorted_tokens(b)), _from_distance(distance, side_a + side_b)]
    if shared:
        scores += [
            _from_distance(gap + len(only_a), len(shared) + side_a),
            _from_distance(gap + len(only_b), len(shared) + side_b),
        ]
    return max(scores)


def partial_token_ratio(a: str, b: str) -> float:
    shared, only_a, only_b = _token_sets(a, b)
    if shared:
        return 100.0
    return max(partial_ratio(_sorted_tokens(a), _sorted_tokens(b)), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """Combined score: plain and token ratios for similar lengths, partial ones otherwise."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if spread < PARTIAL_FROM:
        return max(plain, TOKEN_WEIGHT * token_ratio(a, b))
    weight = PARTIAL_WEIGHT if spread <= FAR_FROM else FAR_PARTIAL_WEIGHT
    return max(plain, weight * partial_ratio(a, b), TOKEN_WEIGHT * weight * partial_token_ratio(a, b))


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)])


class NameBlock:
    """Distinct names of one block, ready to give the best matches of many queries.

    A common-letter count bounds every score from above. Names are scored from the highest
    bound down and scoring stops once no bound can reach the k-th best, so the result is
    exact although most names are never scored in full.
    """

    def __init__(self, names: list[str]):
        self.names = names
        self.lengths = np.array([len(n) for n in names], dtype=np.int64)
        letters = sorted(set("".join(names)))
        self.slot = {ch: i for i, ch in enumerate(letters)}
        self.counts = np.zeros((len(names), len(letters)), dtype=np.int32)
        self.by_token: dict[str, list[int]] = {}
        for row, name in enumerate(names):
            for ch, n in Counter(name).items():
                self.counts[row, self.slot[ch]] = n
            for token in set(name.split()):
                self.by_token.setdefault(token, []).append(row)
        self.repeats = np.array([_repeats(n) for n in names], dtype=bool)

    def bounds(self, query: str) -> np.ndarray:
        if not query:
            return np.zeros(len(self.names))
        wanted = np.zeros(len(self.slot), dtype=np.int32)
        for ch, n in Counter(query).items():
            if ch in self.slot:
                wanted[self.slot[ch]] = n
        common = np.minimum(self.counts, wanted).sum(axis=1)
        short = np.minimum(self.lengths, len(query))
        spread = np.maximum(self.lengths, len(query)) / np.maximum(short, 1)
        top = 200.0 * common / (self.lengths + len(query))
        part = PARTIAL_WEIGHT * 200.0 * common / np.maximum(short + common, 1)
        top = np.where(spread < PARTIAL_FROM, top, np.maximum(top, part))
        sharing = sorted({r for t in set(query.split()) for r in self.by_token.get(t, ())})
        top[sharing] = np.maximum(top[sharing], 100.0 * TOKEN_WEIGHT)
        top[self.repeats] = 100.0
        return np.full(len(top), 100.0) if _repeats(query) else top + 1e-9

    def best(self, query: str, weight: Iterable[int], k: int) -> list[tuple[float, int]]:
        """(score, row) of the names that fill k places when name i takes weight[i] places.

        Names tied with the last place are kept too, so the caller can break ties by position.
        """
        weight = list(weight)
        bounds = self.bounds(query)
        scored: list[tuple[float, int]] = []
        floor = -1.0
        for row in np.argsort(-bounds, kind="stable"):
            if bounds[row] < floor - NOISE:
                break
            score = weighted_ratio(query, self.names[row])
            if score < floor - NOISE:
                continue
            scored.append((score, int(row)))
            scored.sort(reverse=True)
            places = 0
            for value, taken in scored:
                places += weight[taken]
                if places >= k:
                    floor = value
                    break
        return [pair for pair in scored if pair[0] >= floor - NOISE]


def _repeats(text: str) -> bool:
    tokens = text.split()
    return len(tokens) != len(set(tokens))
