"""Profiles over many window lengths, and the longest length that still repeats."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import NoSolutionPossible, check_fraction
from seriesloom.operators import nearest


def breadth_first(n: int) -> list[int]:
    """0 .. n - 1 in the order that halves intervals: 0, then the middle of 1 .. n - 1, then the middles of what is left, level by level.

    Sorted by (level, position), where a place's level is how often its interval is halved until it is the middle.
    """
    place = np.arange(1, n)
    low, high, level = np.ones_like(place), np.full_like(place, n - 1), np.full_like(place, -1)
    for depth in range(n.bit_length() + 1):
        mid = (low + high) // 2
        level[(level < 0) & (place == mid)] = depth
        low, high = np.where(place > mid, mid + 1, low), np.where(place < mid, mid - 1, high)
    return [0, *(int(p) for p in place[np.lexsort((place, level))])]


def chosen(windows: list[int], sample_pct: float) -> list[int]:
    """The share of window lengths that is computed, in breadth-first order of their position."""
    take = max(1, math.floor(len(windows) * sample_pct)) if windows else 0
    return [windows[i] for i in breadth_first(len(windows))[:take]]


def pan_profile(series: DataFrame, windows: list[int], sample_pct: float = 1.0, correlation: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(series_id, w, idx, mp, pi) for the chosen lengths, in one job; lengths already in ``known`` are not computed again."""
    if isinstance(sample_pct, bool) or not isinstance(sample_pct, (int, float)) or not 0 <= sample_pct <= 1:
        raise ValueError("sample_pct must lie between 0 and 1")
    if not isinstance(correlation, bool):
        raise ValueError("correlation must be true or false")
    want = sorted(set(chosen(sorted(windows), float(sample_pct))))
    if known is None:
        return nearest.self_join(series, want, correlation=correlation)
    have = {r.w for r in known.select("w").distinct().collect()}
    left = [w for w in want if w not in have]
    old = known.filter(F.col("w").isin(want)).select("series_id", "w", "idx", "mp", "pi")
    return old if not left else old.unionByName(nearest.self_join(series, left, correlation=correlation))


def pick(pan: DataFrame, w: int) -> DataFrame:
    """The profile of one length; an error if the pan profile does not have it."""
    out = pan.filter(F.col("w") == w)
    if not out.limit(1).count():
        raise ValueError(f"the profile has no windows of length {w}")
    return out


def maximum_subsequence(series: DataFrame, threshold: float = 0.95, refine_stepsize: float = 0.05, lower_window: int = 8, include: bool = False):
    """The first length at which no two windows correlate by ``threshold``, found by doubling and then in steps.

    One series.  All doublings up to half the series are one job, and all
    refinements another.  With ``include`` also the correlations per length.
    """
    check_fraction(threshold, "threshold")
    n = series.count()
    doubling = [lower_window * 2**k for k in range(64) if lower_window * 2**k <= n // 2]
    table = _best(series, doubling)
    coarse = _until(doubling, table, threshold)
    repeated = [w for w in coarse if table[w] > threshold]
    if not repeated:
        raise NoSolutionPossible(f"no window repeats with a correlation above {threshold:.2f}")
    grown = np.floor(np.append(1 + np.arange(refine_stepsize, 1, refine_stepsize), 2) * repeated[-1]).astype(int)
    even = (grown + grown % 2).tolist()
    table |= _best(series, sorted(set(even) - set(table)))
    fine = _until(even, table, threshold)
    return (fine[-1], {w: table[w] for w in [*repeated, *fine]}) if include else fine[-1]


def _until(windows: list[int], table: dict[int, float], threshold: float) -> list[int]:
    """The lengths up to and with the first that correlates less than ``threshold``."""
    below = [k for k, w in enumerate(windows) if table[w] < threshold]
    return windows[: below[0] + 1] if below else windows


def _best(series: DataFrame, windows: list[int]) -> dict[int, float]:
    """Largest correlation of any two windows, per length."""
    if not windows:
        return {}
    rows = nearest.self_join(series, windows, correlation=True).groupBy("w").agg(F.max("mp").alias("r")).collect()
    return {w: -1.0 for w in windows} | {r.w: r.r for r in rows if r.r is not None}
