"""String similarities of pairs of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

PREFIX, SCALE, BOOST_OVER = 4, 0.1, 0.7
LONG, STEP = 64, 32


def _codes(names: list[str], width: int) -> np.ndarray:
    """names x width code points, 0 behind the end."""
    return np.array(names, f"<U{width}").view(np.uint32).reshape(len(names), width)


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of each pair, for all pairs of the lists at once.

    Characters match within half the longer length less one, each once and
    from the left; half of the matches out of order are transpositions. The
    common prefix of up to four characters lifts a Jaro similarity over 0.7.
    Two empty names are alike.
    """
    n = len(a)
    order = [i for i in range(n) if max(len(a[i]), len(b[i])) > LONG]
    if order and n > STEP:  # a few very long names must not widen the rest
        short = sorted(set(range(n)) - set(order))
        out = np.empty(n)
        for own in [short, *(order[k : k + STEP] for k in range(0, len(order), STEP))]:
            if own:
                out[own] = jaro_winkler([a[i] for i in own], [b[i] for i in own])
        return out
    la, lb = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    wa, wb = int(la.max(initial=0)), int(lb.max(initial=0))
    x, y = _codes(a, max(wa, 1)), _codes(b, max(wb, 1))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    hit_a, hit_b = np.zeros(x.shape[::-1], bool), np.zeros(y.shape[::-1], bool)
    furthest = int(reach.max(initial=0))
    # a character's column stands together in memory
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for i in range(wa):
        free = i < la
        for j in range(max(0, i - furthest), min(wb, i + furthest + 1)):
            ok = free & (xs[i] == ys[j]) & (abs(i - j) <= reach) & (j < lb) & ~hit_b[j]
            if ok.any():
                hit_a[i] |= ok
                hit_b[j] |= ok
                free &= ~ok
    hit_a, hit_b = hit_a.T, hit_b.T
    matches = hit_a.sum(1)
    in_a = np.take_along_axis(x, np.argsort(~hit_a, axis=1, kind="stable"), 1)
    in_b = np.take_along_axis(y, np.argsort(~hit_b, axis=1, kind="stable"), 1)
    width = min(in_a.shape[1], in_b.shape[1])
    valid = np.arange(width) < matches[:, None]
    swaps = ((in_a[:, :width] != in_b[:, :width]) & valid).sum(1) // 2
    m = np.maximum(matches, 1)
    jaro = np.where(matches > 0, (matches / np.maximum(la, 1) + matches / np.maximum(lb, 1) + (matches - swaps) / m) / 3, ((la == 0) & (lb == 0)).astype(float))
    same = np.ones(n, bool)
    prefix = np.zeros(n, int)
    for i in range(min(PREFIX, wa, wb)):
        same &= (i < la) & (i < lb) & (x[:, i] == y[:, i])
        prefix += same
    return np.where(jaro > BOOST_OVER, jaro + prefix * SCALE * (1 - jaro), jaro)


@pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler(a.fillna("").tolist(), b.fillna("").tolist()))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; 1 for two empty names."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)
