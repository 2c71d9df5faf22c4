"""Nearest-neighbour joins of z-normalised windows.

Every window of one series meets every window of itself (beyond an exclusion
zone) or of another series, and keeps its nearest.  The pairs of windows form a
square that is cut into tiles: a series becomes blocks of window starts (with the
w - 1 points that the last windows need), every pair of blocks is one group, and
a group computes its correlations as products of normalised window matrices.  Windows longer than ``LONG`` are
not laid out as matrices: their correlations come from running sums along diagonals, at a cost and with memory that do not
depend on the window.  A
group sends back one row per window and side, and Spark's aggregation keeps the best.
Neither a task nor a row ever holds a whole series, and a long series is many groups.

Correlations are rounded to 10 decimals before they are compared, and ties have a
fixed order, so results do not depend on tiles, partitions or threads:

* ``nearest``: the neighbour at the least distance |i - j|, then the left one
  (for joins of two series: the largest j <= i, then the smallest j > i);
* ``first``: the smallest j.

A constant window correlates 0 with everything.  A window with a missing value
has no neighbour and is nobody's (mp null, pi -1).  A window that has no
neighbour otherwise has correlation -1 in a self-join, and infinite distance in
a join of two series.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import check_choice, check_fraction, check_window
from seriesloom.session import ship

BLOCK = 4096
LEAST_BLOCK = 256
TILE = 512
LONG = 512
_RESULT = "series_id string, part int, w int, idx bigint, side int, r double, j bigint"


def normalise(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of x scaled to mean 0 and norm 1 (constant ones to 0), and which are whole."""
    view = np.lib.stride_tricks.sliding_window_view(x, w)
    whole = np.isfinite(view).all(axis=1)
    safe = np.where(np.isfinite(x), x, 0.0)
    view = np.lib.stride_tricks.sliding_window_view(safe, w)
    z = view - view.mean(axis=1, keepdims=True)
    norm = np.sqrt(np.einsum("ij,ij->i", z, z))
    flat = view.max(axis=1) == view.min(axis=1)
    z *= np.where(flat | (norm == 0), 0.0, 1.0 / np.where(norm == 0, 1.0, norm))[:, None]
    return z, whole


def _best(r: np.ndarray, i: np.ndarray, j: np.ndarray, first: bool):
    """For each row the largest r and its j; ties by distance from i or by j."""
    top = r.max(axis=1)
    order = np.broadcast_to(j[None, :], r.shape) if first else np.abs(i[:, None] - j[None, :])
    at = np.where(r == top[:, None], order, np.iinfo(np.int64).max).argmin(axis=1)
    return top, j[at]


class Best:
    """Best so far of the windows lo .. lo + n on either side of themselves."""

    def __init__(self, lo: int, n: int, first: bool):
        self.lo, self.first = lo, first
        self.r = np.full((2, n), -np.inf)
        self.j = np.full((2, n), -1, np.int64)

    def add(self, side: int, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        if not r.size:
            return
        top, at = _best(r, i, j, self.first)
        rows = i - self.lo
        old, old_j = self.r[side, rows], self.j[side, rows]
        order = (at < old_j) if self.first else (np.abs(at - i) < np.abs(old_j - i))
        better = (top > old) | ((top == old) & np.isfinite(top) & order)
        self.r[side, rows[better]], self.j[side, rows[better]] = top[better], at[better]

    def line(self, side: int, at: slice, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """One neighbour j for each of the windows i, which are the rows ``at``."""
        old, old_j = self.r[side, at], self.j[side, at]
        order = (j < old_j) if self.first else (np.abs(j - i) < np.abs(old_j - i))
        better = (r > old) | ((r == old) & np.isfinite(r) & order)
        old[better], old_j[better] = r[better], j[better]

    def rows(self, part: int, w: int):
        for side in (0, 1):
            got = np.flatnonzero(np.isfinite(self.r[side]))
            yield part, w, got + self.lo, side, self.r[side, got], self.j[side, got]


def sweep(a, a0: int, b, b0: int, w: int, zone: int, first: bool, same: bool, starts: int, keep_diagonal=None, rows_of=None):
    """All pairs of window starts a0.. of a and b0.. of b, ``starts`` at most of each.

    ``same`` means one series: pairs within ``zone`` are left out and every pair
    counts for both windows.  ``keep_diagonal`` (of j - i) and ``rows_of`` (of i)
    restrict the pairs.
    """
    za, ok_a = normalise(a, w)
    zb, ok_b = (za, ok_a) if b is a else normalise(b, w)
    za, ok_a, zb, ok_b = za[:starts], ok_a[:starts], zb[:starts], ok_b[:starts]
    best_a = Best(a0, len(za), first)
    best_b = best_a if b is a else Best(b0, len(zb), first)
    def products(x, ok_x, i, y, ok_y, j):
        """Correlations of windows i with windows j, -inf for pairs that do not count; and j - i."""
        gap = j[None, :] - i[:, None]
        out = ~ok_x[:, None] | ~ok_y[None, :]
        if same:
            out = out | (np.abs(gap) <= zone)
        if keep_diagonal is not None:
            out = out | ~keep_diagonal(np.abs(gap) if same else gap)
        return np.where(out, -np.inf, np.minimum(np.round(x @ y.T, 10), 1.0)), gap

    for p in range(0, len(za), TILE):
        rows = (za[p : p + TILE], ok_a[p : p + TILE], np.arange(a0 + p, a0 + p + len(za[p : p + TILE])))
        for q in range(0, len(zb), TILE):
            cols = (zb[q : q + TILE], ok_b[q : q + TILE], np.arange(b0 + q, b0 + q + len(zb[q : q + TILE])))
            if b is a and cols[2][-1] < rows[2][0]:
                continue
            some = rows if rows_of is None else tuple(v[rows_of(rows[2])] for v in rows)
            i, j = some[2], cols[2]
            if not same:
                if len(i):
                    r, gap = products(*some, *cols)
                    # side 0 is a neighbour that starts no later than the window itself
                    best_a.add(0, np.where(gap <= 0, r, -np.inf), i, j)
                    best_a.add(1, np.where(gap > 0, r, -np.inf), i, j)
                    best_b.add(0, np.where(gap >= 0, r, -np.inf).T, j, i)
                    best_b.add(1, np.where(gap < 0, r, -np.inf).T, j, i)
                continue
            right = None
            if len(i):
                r, gap = products(*some, *cols)
                right = np.where(gap > 0, r, -np.inf)
                best_a.add(1, right, i, j)
            if rows_of is None:
                best_b.add(0, right.T, j, i)
                continue
            # only the sampled windows on this side too
            some = tuple(v[rows_of(cols[2])] for v in cols)
            if len(some[2]):
                r, gap = products(*some, *rows)
                best_b.add(0, np.where(gap < 0, r, -np.inf), some[2], rows[2])
    return best_a, best_b


def moments(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x without its mean and without missing values; and of its windows the mean, one over the norm (0 if constant), and which are whole."""
    known = np.isfinite(x)
    x = np.where(known, x, x[known].mean() if known.any() else 0.0)
    turns = np.concatenate([[0], np.cumsum(np.concatenate([[False], x[1:] != x[:-1]]))])
    x = x - x.mean()
    sums = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    s, q, gone = sums(x), sums(x * x), np.concatenate([[0], np.cumsum(~known)])
    mean = (s[w:] - s[:-w]) / w
    norm = np.sqrt(np.maximum(0.0, q[w:] - q[:-w] - w * mean * mean))
    flat = (turns[w:] - turns[1 : len(turns) - w + 1]) == 0
    return x, mean, np.where(flat | (norm == 0), 0.0, 1.0 / np.where(norm == 0, 1.0, norm)), gone[w:] == gone[:-w]


def sweep_long(a, a0: int, b, b0: int, w: int, zone: int, first: bool, same: bool, starts: int, keep_diagonal=None, rows_of=None):
    """As ``sweep``, diagonal by diagonal: dot products are differences of running sums of products."""
    xa, mean_a, inv_a, ok_a = (v[:starts] if k else v for k, v in enumerate(moments(a, w)))
    xb, mean_b, inv_b, ok_b = (xa, mean_a, inv_a, ok_a) if b is a else (v[:starts] if k else v for k, v in enumerate(moments(b, w)))
    na, nb = len(mean_a), len(mean_b)
    best_a = Best(a0, na, first)
    best_b = best_a if b is a else Best(b0, nb, first)
    for d in range(1 if b is a else 1 - na, nb):
        gap = b0 + d - a0
        if same and abs(gap) <= zone or keep_diagonal is not None and not keep_diagonal(np.array([abs(gap) if same else gap]))[0]:
            continue
        i0, j0 = max(0, -d), max(0, d)
        n = min(na - i0, nb - j0)
        i, j = slice(i0, i0 + n), slice(j0, j0 + n)
        s = np.concatenate([[0.0], np.cumsum(xa[i0 : i0 + n + w - 1] * xb[j0 : j0 + n + w - 1])])
        r = (s[w:] - s[:-w] - w * mean_a[i] * mean_b[j]) * inv_a[i] * inv_b[j]
        r = np.where(ok_a[i] & ok_b[j], np.minimum(np.round(r, 10), 1.0), -np.inf)
        rows, cols = np.arange(a0 + i0, a0 + i0 + n), np.arange(b0 + j0, b0 + j0 + n)
        if same:
            at, of = (r, r) if rows_of is None else (np.where(rows_of(rows), r, -np.inf), np.where(rows_of(cols), r, -np.inf))
            best_a.line(1, i, at, rows, cols)
            best_b.line(0, j, of, cols, rows)
        else:
            if rows_of is not None:
                r = np.where(rows_of(rows), r, -np.inf)
            best_a.line(0 if gap <= 0 else 1, i, r, rows, cols)
            best_b.line(0 if gap >= 0 else 1, j, r, cols, rows)
    return best_a, best_b


def blocks(series: DataFrame, span: int, size: int) -> DataFrame:
    """(series_id, block, values): windows starting at block * size .., with the points they need."""
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - (span - 1)) / size)).cast("bigint")
    last = F.floor(F.col("idx") / size).cast("bigint")
    value = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs(F.col("value")) == float("inf")), float("nan")).otherwise(F.col("value"))
    points = series.select("series_id", "idx", value.alias("value"), F.explode(F.sequence(first, last)).alias("block"))
    got = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return points.groupBy("series_id", "block").agg(F.transform(got, lambda x: x["value"]).alias("values"))


def _table(found) -> pa.Table:
    cols = [[], [], [], [], [], [], []]
    for sid, part, w, idx, side, r, j in found:
        n = len(idx)
        for col, x in zip(cols, (np.full(n, sid, object), np.full(n, part, np.int32), np.full(n, w, np.int32), idx, np.full(n, side, np.int32), r, j)):
            col.append(x)
    names = ["series_id", "part", "w", "idx", "side", "r", "j"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
    return pa.table([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, kinds)], names=names)


def _diagonals(pct: float, seed: int):
    """Which diagonals a sample holds: those whose hash is below the share; all of them at 1."""
    if pct >= 1:
        return None
    limit = np.uint64(min(int(pct * 2.0**64), (1 << 64) - 1))

    def chosen(gap):
        x = gap.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) < limit

    return chosen


def pairs(series: DataFrame, query: DataFrame | None, windows: list[int], zone, tie: str = "nearest", block: int | None = None, sample: float = 1.0, seed: int = 0, every: int = 1) -> DataFrame:
    """Best neighbour of every window per tile: ``_RESULT`` rows; part 0 is series, part 1 query."""
    check_choice(tie, ("nearest", "first"), "tie")
    ship(series.sparkSession)
    first, longest = tie == "first", max(windows)
    same = query is None
    size = block or _size(series if same else series.unionByName(query.select(series.columns)), longest)
    keep_diagonal = _diagonals(sample, seed)
    rows_of = None if every <= 1 else (lambda i: i % every == 0)
    left = blocks(series, longest, size)
    right = left if same else blocks(query, longest, size)
    last_left = left.groupBy("series_id").agg(F.max("block").alias("last"))
    if same:
        # each block goes to its pair with every block of its series
        dealt = left.join(last_left, "series_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
        dealt = dealt.select("series_id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("part"), "values")
    else:
        last_right = right.groupBy("series_id").agg(F.max("block").alias("last"))
        a = left.join(last_right, "series_id").withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
        b = right.join(last_left, "series_id").withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
        dealt = a.select("series_id", F.col("block").alias("p"), "q", F.lit(0).alias("part"), "values").unionByName(b.select("series_id", "p", F.col("block").alias("q"), F.lit(1).alias("part"), "values"))

    def compare(key, table):
        sid, p, q = (k.as_py() for k in key)
        parts = dict(zip(table.column("part").to_pylist(), table.column("values").to_pylist()))
        x = np.array(parts[0], float)
        y = x if same and p == q else np.array(parts[1], float)
        found = []
        for w in windows:
            if len(x) < w or len(y) < w:
                continue
            # the blocks hold enough for the longest window; a shorter one has the same starts
            a, b = (sweep if w <= LONG else sweep_long)(x, p * size, y, q * size, w, zone(w), first, same, size, keep_diagonal, rows_of)
            found += [(sid, *row) for row in a.rows(0, w)]
            if b is not a:
                found += [(sid, *row) for row in b.rows(0 if same else 1, w)]
        return _table(found)

    return dealt.groupBy("series_id", "p", "q").applyInArrow(compare, _RESULT)


def _size(series: DataFrame, w: int) -> int:
    """Window starts in a block: enough groups for the cluster from small inputs, at most ``BLOCK``.

    Only the longest series' length is asked for.
    """
    n = series.groupBy("series_id").agg(F.max("idx").alias("n")).agg(F.max("n")).first()[0] or 0
    cores = series.sparkSession.sparkContext.defaultParallelism
    return int(max(LEAST_BLOCK, min(BLOCK, math.ceil((n + 1) / max(1, math.ceil(math.sqrt(2 * cores)))))))


def choose(found: DataFrame, tie: str, same: bool) -> DataFrame:
    """(series_id, part, w, idx, r, j, left r, left j, right r, right j) from tile rows."""
    gap = F.abs(F.col("idx") - F.col("j"))
    if tie == "first":
        order = [-F.col("j")]
    elif same:
        order = [-gap, -F.col("side")]
    else:
        order = [-F.col("side"), -gap]
    best = lambda cond: F.max(F.when(cond, F.struct("r", *[o.alias(f"o{k}") for k, o in enumerate(order)], "j")))
    out = found.groupBy("series_id", "part", "w", "idx").agg(best(F.lit(True)).alias("all"), best(F.col("side") == 0).alias("l"), best(F.col("side") == 1).alias("rt"))
    return out.select("series_id", "part", "w", "idx", *[F.col(f"{s}.{c}").alias(f"{n}{c}") for s, n in (("all", ""), ("l", "l"), ("rt", "r")) for c in ("r", "j")])


def distance(r: Column, w: Column | int) -> Column:
    """z-normalised Euclidean distance of a correlation; null for null."""
    return F.sqrt(2.0 * (F.lit(w) if isinstance(w, int) else w) * F.when(r > 1, 0.0).otherwise(1 - r))


def starts(series: DataFrame, windows: list[int]) -> DataFrame:
    """(series_id, w, idx, whole): every window, and whether it has no missing value."""
    from seriesloom.functions.sliding import skip_locations

    out = None
    for w in windows:
        part = skip_locations(series, w).select("series_id", F.lit(w).alias("w"), "idx", (~F.col("skip")).alias("whole"))
        out = part if out is None else out.unionByName(part)
    return out


def profile(series: DataFrame, found: DataFrame, windows: list[int], same: bool, correlation: bool = False, sides: bool = False) -> DataFrame:
    """The profile over every window of ``series`` from chosen neighbours."""
    every = starts(series, windows)
    got = every.join(found.drop("part"), ["series_id", "w", "idx"], "left")
    none = F.lit(-1.0) if same else F.lit(float("-inf"))

    def measured(c):
        r = F.when(F.col("whole"), F.coalesce(F.col(c), none))
        return r if correlation else F.when(r == float("-inf"), float("inf")).otherwise(distance(r, F.col("w")))

    cols = [measured("r").alias("mp"), F.coalesce("j", F.lit(-1).cast("bigint")).alias("pi")]
    if sides:
        cols += [measured("lr").alias("lmp"), F.coalesce("lj", F.lit(-1).cast("bigint")).alias("lpi"), measured("rr").alias("rmp"), F.coalesce("rj", F.lit(-1).cast("bigint")).alias("rpi")]
    return got.select("series_id", "w", "idx", *cols)


def is_correlation(profile: DataFrame, column: str = "mp") -> bool:
    """Whether a profile holds correlations: all known values lie between -1 and 1."""
    out = profile.filter(F.col(column).isNotNull() & ~F.isnan(column)).agg(F.min(column), F.max(column)).first()
    return out[0] is not None and -1 - 1e-10 <= out[0] and out[1] <= 1 + 1e-10


def empty(series: DataFrame, w: int) -> DataFrame:
    """The profile of a series before anything is known: infinite distances, no neighbours."""
    none = F.lit(-1).cast("bigint")
    return starts(series, [w]).select("series_id", "w", "idx", F.lit(float("inf")).alias("mp"), none.alias("pi"))


def check_series(series: DataFrame, name: str = "series") -> DataFrame:
    """A table that has the columns of a series, of the right kinds."""
    kinds = dict(series.dtypes)
    wrong = [c for c, ok in (("series_id", ("string",)), ("idx", ("bigint", "int")), ("value", ("double", "float"))) if kinds.get(c) not in ok]
    if wrong:
        raise ValueError(f"{name} lacks {', '.join(wrong)}, or they are of another type: {kinds}")
    return series


def zone_quarter(w: int) -> int:
    return math.ceil(w / 4)


def zone_half(w: int) -> int:
    return math.ceil(w / 2)


def self_join(series: DataFrame, w: int | list[int], zone=zone_quarter, tie: str = "nearest", correlation: bool = False, sides: bool = False, block: int | None = None) -> DataFrame:
    """Profile of each series with itself: (series_id, w, idx, mp, pi) and, with ``sides``, left and right profiles."""
    windows = list(w) if isinstance(w, (list, tuple)) else [w]
    check_series(series)
    for x in windows:
        check_window(x)
    fixed = zone if callable(zone) else (lambda _w, z=zone: z)
    found = choose(pairs(series, None, windows, fixed, tie, block), tie, True)
    return profile(series, found, windows, True, correlation, sides)


def ab_join(series: DataFrame, query: DataFrame, w: int, tie: str = "nearest", correlation: bool = False, reverse: bool = False, block: int | None = None) -> DataFrame:
    """Profile of every window of ``series`` among the windows of ``query`` with the same series_id (``reverse``: the other way)."""
    check_window(w)
    check_series(series)
    check_series(query, "query")
    found = choose(pairs(series, query, [w], lambda _: 0, tie, block), tie, False).filter(F.col("part") == (1 if reverse else 0))
    return profile(query if reverse else series, found, [w], False, correlation)


def exact_rows(series: DataFrame, w: int, query: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Row-wise variant: exclusion of half a window, smallest index on ties, left and right profiles (self-join)."""
    check_window(w)
    if query is not None:
        return ab_join(series, query, w, tie="first", block=block)
    return self_join(series, w, zone=zone_half, tie="first", sides=True, block=block)


def sampled(series: DataFrame, w: int, sample_pct: float = 0.1, seed: int = 0, query: DataFrame | None = None, block: int | None = None, step_size: float | None = 0.25) -> DataFrame:
    """Approximate profile: what ``stepped`` finds, then a seeded sample of all diagonals; exact at 1.0.  Without ``step_size`` the sample alone."""
    check_window(w)
    check_fraction(sample_pct, "sample_pct")
    same = query is None
    found = pairs(series, query, [w], zone_quarter, "nearest", block, sample_pct, seed)
    if step_size is not None and sample_pct < 1:
        found = found.unionByName(_followed(series, query, w, step_size, block))
    return profile(series, choose(found, "nearest", same).filter("part = 0"), [w], same)


def stepped(series: DataFrame, w: int, step_size: float = 0.25, block: int | None = None, query: DataFrame | None = None) -> DataFrame:
    """Approximate profile from every ``floor(w * step_size)``-th window, whose matches are followed along their diagonals.

    A sampled window finds its exact neighbour j (in ``query``, if given); then the windows up to a step
    beside it are compared with those beside j, for both ends.
    """
    check_window(w)
    check_fraction(step_size, "step_size")
    return profile(series, choose(_followed(series, query, w, step_size, block), "nearest", query is None), [w], query is None)


def _followed(series: DataFrame, query: DataFrame | None, w: int, step_size: float, block: int | None) -> DataFrame:
    """``_RESULT`` rows of the windows beside sampled ones and their neighbours.

    A sampled window and its neighbour are one stretch of a diagonal; stretches are dealt to the pair of blocks
    that they begin in and computed there with running sums.
    """
    step, same = max(1, math.floor(w * step_size)), query is None
    other = series if same else query
    seeds = choose(pairs(series, query, [w], zone_quarter, "nearest", block, every=step), "nearest", same).filter("part = 0").select("series_id", "idx", "j")
    back = F.least(F.col("idx"), F.col("j"), F.lit(step).cast("bigint"))
    size = block or BLOCK
    seeds = seeds.select("series_id", (F.col("idx") - back).alias("i"), (F.col("j") - back).alias("j"), (back + step + 1).alias("n"))
    seeds = seeds.withColumn("p", F.floor(F.col("i") / size)).withColumn("q", F.floor(F.col("j") / size))
    tiles = seeds.select("series_id", "p", "q").distinct()
    span = w + 2 * step
    none = F.lit(None).cast("bigint")
    dealt = seeds.select("series_id", "p", "q", F.lit(2).alias("part"), F.lit(None).cast("array<double>").alias("values"), "i", "j", "n")
    for part, (source, at) in enumerate(((series, "p"), (other, "q"))):
        cut = blocks(source, span, size).withColumnRenamed("block", at)
        dealt = dealt.unionByName(tiles.join(cut, ["series_id", at]).select("series_id", "p", "q", F.lit(part).alias("part"), "values", none.alias("i"), none.alias("j"), none.alias("n")))

    def follow(key, table):
        sid, p, q = (k.as_py() for k in key)
        part = table.column("part").to_numpy()
        values = [table.column("values")[int(np.flatnonzero(part == k)[0])].as_py() for k in (0, 1)]
        (x, mean_x, inv_x, ok_x), (y, mean_y, inv_y, ok_y) = (moments(np.array(v, float), w) for v in values)
        mine = np.flatnonzero(part == 2)
        found = []
        for i0, j0, n in zip(*(table.column(c).to_numpy(zero_copy_only=False)[mine].astype(np.int64) for c in ("i", "j", "n"))):
            a, b = int(i0 - p * size), int(j0 - q * size)
            n = min(int(n), len(mean_x) - a, len(mean_y) - b)
            if n <= 0:
                continue
            s = np.concatenate([[0.0], np.cumsum(x[a : a + n + w - 1] * y[b : b + n + w - 1])])
            i, j = slice(a, a + n), slice(b, b + n)
            r = np.minimum(np.round((s[w:] - s[:-w] - w * mean_x[i] * mean_y[j]) * inv_x[i] * inv_y[j], 10), 1.0)
            at = np.flatnonzero(ok_x[i] & ok_y[j])
            rows, cols = i0 + at, j0 + at
            # side 0 is a neighbour that starts before the window, or with it
            for u, v in ((rows, cols), (cols, rows))[: 1 + same]:
                if len(at):
                    found.append((sid, 0, w, u, int(v[0] > u[0]), r[at], v))
        return _table(found)

    return dealt.groupBy("series_id", "p", "q").applyInArrow(follow, _RESULT)
