"""String similarities that Spark lacks, as Arrow UDFs over distinct pairs of strings.

All are 0 to 1. ratio is 2 * LCS / (lengths); two empty strings have ratio 1, token-set ratio 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of the first string."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of the shared words and either side's own, against each other; 1 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and not (left and right):
        return 1.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    options = [ratio(first, second)]
    if both:
        options += [ratio(both, first), ratio(both, second)]
    return max(options)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one, cut windows at both ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    n, best = len(short), 0.0
    for at in range(1 - n, len(long)):
        window = long[max(0, at) : at + n]
        if 2 * min(len(window), n) / (len(window) + n) > best:
            best = max(best, ratio(short, window))
            if best == 1.0:
                break
    return best


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    other = [ch for ch, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, other)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + scale * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _udf(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in memo:
                memo[pair] = round(f(*pair), 6)
            out.append(memo[pair])
        return pd.Series(out, dtype="float64")

    return run


ratio_udf, token_sort_udf, token_set_udf, partial_udf, jaro_winkler_udf = map(
    _udf, (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler)
)
