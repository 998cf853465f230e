"""String similarities: built-in where Spark has them, else Arrow functions over bit-parallel rows.

The scale of the ratios is 0 to 100. Two empty texts are alike (100) for ``ratio`` and ``token_sort_ratio``; the
partial and set ratios of an empty text are 0. NULL gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Longest common subsequence, the rows of the table kept as bits of one integer."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    rows = full = (1 << len(a)) - 1
    for ch in b:
        hit = rows & masks.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


def _starts(a: str, b: str) -> list[int]:
    """Longest common subsequence of ``a`` with the first 1, 2, ... letters of ``b``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    rows = full = (1 << len(a)) - 1
    out = []
    for ch in b:
        hit = rows & masks.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
        out.append(len(a) - rows.bit_count())
    return out


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one of that length, or cut off at an end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    m, n = len(short), len(long)
    # One pass gives all stretches cut off at an end.
    starts, ends = _starts(short, long), _starts(short[::-1], long[::-1])
    runs = [starts, ends] if n > m else [starts, ends, _starts(long, short), _starts(long[::-1], short[::-1])]
    best = max(200.0 * c / (m + k) for run in runs for k, c in enumerate(run[:m], 1))
    i, most = 1, 200.0 * starts[-1] / (2 * m)
    while i < n - m and best < most:
        c = _common(short, long[i : i + m])
        best = max(best, 200.0 * c / (2 * m))
        # From one stretch to the next the common part grows by one at most.
        i += max(1, int(best * m / 100 + 1e-9) + 1 - c)
    return best


def token_sort_ratio_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio_of(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words followed by either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio_of(with_left, with_right)
    return max(best, ratio_of(both, with_left), ratio_of(both, with_right)) if both else best


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity raised by a common beginning of up to 4 letters, 0 to 1; two empty texts are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (b[j] for j in range(len(b)) if taken[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(DoubleType())
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return over


ratio, partial_ratio = _pairwise(ratio_of), _pairwise(partial_ratio_of)
token_sort_ratio, token_set_ratio = _pairwise(token_sort_ratio_of), _pairwise(token_set_ratio_of)
jaro_winkler = _pairwise(jaro_winkler_of)
levenshtein = F.levenshtein


def word_overlap(a: Column, b: Column) -> dict[str, Column]:
    """``cont_a, cont_b, jac``: shared different words over those of a, of b, of both."""
    x, y = F.split(a, " "), F.split(b, " ")
    both = F.size(F.array_intersect(x, y)).cast("double")
    return {"cont_a": both / F.size(F.array_distinct(x)), "cont_b": both / F.size(F.array_distinct(y)), "jac": both / F.size(F.array_union(x, y))}
