"""Pairwise alignment by dynamic programming, one pair a row, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points for equal and for different letters, and for a gap of one column.
MATCH, MISMATCH, GAP = 2, -1, -2


def align(a: str, b: str, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[str, str, int]:
    """Both texts with gaps put in, and the score: the best over all alignments from end to end.

    A row of the table is one vector operation: running along it costs `gap` a column, so the best of all ways
    from the left is a running maximum. On ties letters are put together first, then b gets the gap. Of the rows
    one in each step is kept, about the root of a's length; the way back works out the rows between them again.
    """
    x, y = np.array([ord(c) for c in a], np.int64), np.array([ord(c) for c in b], np.int64)
    slope, step = np.arange(len(y) + 1) * gap, max(1, math.isqrt(len(x)))

    def after(row: np.ndarray, i: int) -> np.ndarray:
        best = row + gap
        best[1:] = np.maximum(best[1:], row[:-1] + np.where(y == x[i - 1], match, mismatch))
        return np.maximum.accumulate(best - slope) + slope

    kept, row = [slope], slope
    for i in range(1, len(x) + 1):
        row = after(row, i)
        if i % step == 0:
            kept.append(row)
    between: dict[int, np.ndarray] = {}

    def table(i: int) -> np.ndarray:
        if i % step == 0:
            return kept[i // step]
        if i not in between:
            between.clear()
            start = i // step * step
            between[start] = kept[i // step]
            for k in range(start + 1, i + 1):
                between[k] = after(between[k - 1], k)
        return between[i]

    score, i, j, left, right = int(row[-1]), len(x), len(y), [], []
    while i or j:
        here, above = table(i), table(i - 1) if i else None
        if i and j and here[j] == above[j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i]), right.append(b[j])
        elif i and here[j] == above[j] + gap:
            i -= 1
            left.append(a[i]), right.append("-")
        else:
            j -= 1
            left.append("-"), right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right)), score


def _each_once(pairs: list[tuple[str, str]], **points) -> list[tuple[str, str, int]]:
    """Alignments of all pairs of a batch; equal pairs are aligned once."""
    found = {pair: align(*pair, **points) for pair in set(pairs)}
    return [found[pair] for pair in pairs]


def aligned(a: Column, b: Column, **points) -> Column:
    """struct<a, b, score> of each pair; null counts as empty. Memory is b's length times twice the root of a's, time the product of both lengths."""

    @F.pandas_udf("struct<a: string, b: string, score: long>")
    def pairs(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_each_once(list(zip(left, right)), **points), columns=["a", "b", "score"])

    return pairs(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
