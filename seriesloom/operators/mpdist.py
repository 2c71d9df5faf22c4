"""Distances between whole series, and what builds on them: vectors, pairwise tables, snippets.

The distance of two series is a low quantile of the nearest-neighbour distances
of all their windows, in both directions; it takes the windows they share and
forgives the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.errors import check_fraction, check_window
from seriesloom.functions.sliding import missing
from seriesloom.operators import nearest
from seriesloom.session import checkpoints, ship
from seriesloom.sources.tables import pack


BINS = 4096
SERIES = 64  # of a group of ``pairwise``; two groups make a task


def rank(threshold: float, total, least_one: bool) -> int:
    """Place (from 0) of the quantile among sorted distances; ``least_one`` counts places from 1."""
    return max(0, math.ceil(threshold * total) - (1 if least_one else 0))


def distance(series: DataFrame, other: DataFrame, w: int, threshold: float = 0.05) -> DataFrame:
    """(series_id, dist) of the series of equal id in two tables; infinite if no window has a neighbour."""
    check_window(w)
    check_fraction(threshold, "threshold", low_open=True, high_open=True)
    found = nearest.choose(nearest.pairs(series, other, [w], lambda _: 0), "nearest", False)
    both = nearest.profile(series, found.filter("part = 0"), [w], False).unionByName(nearest.profile(other, found.filter("part = 1"), [w], False))
    sizes = series.groupBy("series_id").agg(F.count("*").alias("na")).join(other.groupBy("series_id").agg(F.count("*").alias("nb")), "series_id")
    finite = both.filter(F.col("mp").isNotNull() & (F.col("mp") < float("inf")))
    # the place is found among BINS counts first, and then among the distances of one bin, so a long series is not sorted
    place = F.least(F.col("all") - 1, F.ceil(F.lit(threshold) * (F.col("na") + F.col("nb"))) - 1)
    binned = finite.withColumn("bin", F.floor(F.col("mp") / math.sqrt(4 * w) * BINS))
    counts = binned.groupBy("series_id", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("series_id").orderBy("bin"))
    totals = counts.groupBy("series_id").agg(F.sum("n").alias("all")).join(sizes, "series_id").select("series_id", place.alias("place"))
    one = counts.withColumn("upto", upto).join(totals, "series_id").filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    inside = binned.join(one.select("series_id", "bin", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place")), ["series_id", "bin"])
    equal = inside.groupBy("series_id", "mp").agg(F.count("*").alias("n"), F.max("place").alias("place"))
    got = equal.withColumn("upto", F.sum("n").over(Window.partitionBy("series_id").orderBy("mp"))).filter(F.col("upto") > F.col("place")).groupBy("series_id").agg(F.min("mp").alias("dist"))
    return sizes.select("series_id").join(got, "series_id", "left").select("series_id", F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


def _pair(a: np.ndarray, b: np.ndarray, w: int, threshold: float) -> float:
    """Distance of two short series in one task."""
    if len(a) < w or len(b) < w:
        return float("inf")
    x, y = nearest.sweep(a, 0, b, 0, w, 0, False, False, max(len(a), len(b)))
    r = np.concatenate([x.r.max(axis=0), y.r.max(axis=0)])
    d = np.sort(np.sqrt(2 * w * (1 - r[np.isfinite(r)])))
    if not len(d):
        return float("inf")
    return float(d[min(len(d) - 1, math.ceil(threshold * (len(a) + len(b))) - 1)])


def pairwise(series: DataFrame, w: int, threshold: float = 0.05) -> DataFrame:
    """(id_a, id_b, dist) for every two series with id_a < id_b; series are short (they travel whole), their number need not be small.

    Series are cut into ``groups`` by a hash of their id, and every two groups meet once.
    """
    check_window(w)
    check_fraction(threshold, "threshold", low_open=True, high_open=True)
    ship(series.sparkSession)
    cleaned = series.withColumn("value", F.when(missing(), float("nan")).otherwise(F.col("value")))
    packed = pack(cleaned)
    n = packed.count()
    groups = max(1, math.ceil(n / SERIES))
    mine = F.pmod(F.xxhash64("series_id"), F.lit(groups)).cast("int")
    dealt = packed.withColumn("g", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.select(F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"), "g", "series_id", "values")

    def compare(key, table):
        p, q = (k.as_py() for k in key)
        rows = sorted(zip(table.column("series_id").to_pylist(), table.column("g").to_pylist(), table.column("values").to_pylist()))
        arrays = [np.array(r[2], float) for r in rows]
        out = [[], [], []]
        for x in range(len(rows)):
            for y in range(x + 1, len(rows)):
                if p == q or rows[x][1] != rows[y][1]:
                    for col, v in zip(out, (rows[x][0], rows[y][0], _pair(arrays[x], arrays[y], w, threshold))):
                        col.append(v)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["id_a", "id_b", "dist"])

    return dealt.groupBy("p", "q").applyInArrow(compare, "id_a string, id_b string, dist double")


def vector(series: DataFrame, query: DataFrame, w: int, threshold: float = 0.05) -> DataFrame:
    """(series_id, idx, dist): distance of ``query`` to every stretch of the series as long as it.

    The series is cut into blocks of stretches; every block meets the whole query of its series, which must fit a row.
    """
    check_window(w)
    ship(series.sparkSession)
    whole = pack(query).withColumnRenamed("values", "query")
    longest = whole.agg(F.max(F.size("query"))).first()[0] or 0
    if longest < w:
        raise ValueError("the query is shorter than a window")
    cut = nearest.blocks(series, longest, nearest.BLOCK).join(whole, "series_id")

    def run(batches):
        for batch in batches:
            for sid, block, values, q in zip(*[batch.column(c).to_pylist() for c in ("series_id", "block", "values", "query")]):
                d = _vector(_known(values), _known(q), w, threshold)[: nearest.BLOCK]
                at = np.flatnonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array([sid] * len(at), pa.string()), pa.array(at + block * nearest.BLOCK, pa.int64()), pa.array(d[at])], ["series_id", "idx", "dist"])

    return cut.mapInArrow(run, "series_id string, idx bigint, dist double")


def _known(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float)


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours along the last axis, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        a = np.minimum(a[..., : a.shape[-1] - step], a[..., step:])
        done += step
    return a


def _vector(ts: np.ndarray, query: np.ndarray, w: int, threshold: float = 0.05) -> np.ndarray:
    """Distances of one query to all stretches of one block, by sliding minima; infinite where no window is whole."""
    if len(ts) < len(query) or len(query) < w:
        return np.zeros(0)
    za, ok_a = nearest.normalise(ts, w)
    zb, ok_b = nearest.normalise(query, w)
    flat_a, flat_b = ~za.any(axis=1), ~zb.any(axis=1)
    d = np.sqrt(np.maximum(0.0, 2 * w * (1 - np.round(zb @ za.T, 10))))
    d[:, flat_a] = math.sqrt(w)
    d[flat_b, :] = math.sqrt(w)
    d[np.ix_(flat_b, flat_a)] = 0.0
    d[:, ~ok_a] = np.inf
    d[~ok_b, :] = np.inf
    rows = len(zb)
    left = sliding_min(d, rows)
    right = np.lib.stride_tricks.sliding_window_view(d.min(axis=0), rows)
    both = np.sort(np.concatenate([left.T, right], axis=1), axis=1)
    place = np.minimum(np.isfinite(both).sum(axis=1) - 1, math.ceil(threshold * 2 * len(query)))
    return both[np.arange(len(both)), np.maximum(place, 0)]


CANDIDATES = 64  # stretches whose vectors one task computes for one block


def snippets(series: DataFrame, size: int, k: int = 2, w: int | None = None) -> DataFrame:
    """(series_id, rank, idx, snippet, neighbors, fraction): the stretches that stand for most of a series.

    Candidates are the stretches that start at multiples of ``size`` (the series is filled up with zeros).  Their
    distance vectors are computed and kept in blocks, some candidates and one block a task; a pick is one
    sum per candidate over all blocks, and no task holds a series or a whole vector.
    """
    if isinstance(size, bool) or not isinstance(size, int) or size < 4:
        raise ValueError("the snippet size must be an integer of at least 4")
    w = w or size // 2
    if w >= size:
        raise ValueError("the window must be shorter than a snippet")
    ship(series.sparkSession)
    checkpoints(series.sparkSession)
    spans = series.groupBy("series_id").agg(F.count("*").alias("n"))
    shortest = spans.agg(F.min("n")).first()[0]
    if shortest is not None and shortest < 2 * size:
        raise ValueError("a series is too short for such snippets")
    spans = spans.withColumn("m", (F.ceil(F.col("n") / size) * size).cast("bigint"))
    more = spans.filter("n < m").select("series_id", F.explode(F.sequence(F.col("n"), F.col("m") - 1)).alias("idx"), F.lit(0.0).alias("value"))
    padded = series.select("series_id", F.col("idx").cast("bigint").alias("idx"), "value").unionByName(more)
    cut = nearest.blocks(padded, size - 1, nearest.BLOCK)
    start = F.floor(F.col("idx") / size) * size
    points = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
    cands = padded.join(spans, "series_id").filter(start < F.col("m") - size).groupBy("series_id", start.cast("bigint").alias("start")).agg(points.alias("query"))
    dealt = cands.groupBy("series_id", F.floor(F.col("start") / (size * CANDIDATES)).alias("c")).agg(F.collect_list(F.struct("start", "query")).alias("cands"))

    def vectors(batches):
        for batch in batches:
            for sid, block, values, some in zip(*[batch.column(c).to_pylist() for c in ("series_id", "block", "values", "cands")]):
                ts = _known(values)
                if len(ts) < size - 1:
                    continue
                d = [_vector(ts, _known(x["query"])[: size - 1], w)[: nearest.BLOCK] for x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid] * len(some), pa.string()), pa.array([x["start"] for x in some], pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([x.tolist() for x in d], pa.list_(pa.float64()))],
                    ["series_id", "start", "block", "d"],
                )

    scored = cut.join(dealt, "series_id").mapInArrow(vectors, "series_id string, start bigint, block bigint, d array<double>").checkpoint()
    total = lambda d: F.sum(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))
    lower = lambda x, y: F.zip_with(x, y, lambda p, q: F.least(p, q))
    best, picks = None, None
    for rank_ in range(1, k + 1):
        now = scored if best is None else scored.join(best, ["series_id", "block"]).withColumn("d", lower(F.col("d"), F.col("best"))).drop("best")
        sums = now.groupBy("series_id", "start").agg(total(F.col("d")).alias("t")).groupBy("series_id").agg(F.min_by("start", F.struct("t", "start")).alias("start"))
        pick = sums.select("series_id", F.lit(rank_).alias("rank"), "start").checkpoint()
        best = now.join(pick, ["series_id", "start"]).select("series_id", "block", F.col("d").alias("best")).checkpoint()
        picks = pick if picks is None else picks.unionByName(pick)
    mine = scored.join(picks, ["series_id", "start"]).groupBy("series_id", "block").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "d"))).alias("p")).join(best, ["series_id", "block"])

    def explain(batches):
        """Per block and pick: the places that it explains; one that two explain equally well counts for the first."""
        for batch in batches:
            rows = []
            for sid, block, chosen, rest in zip(*[batch.column(c).to_pylist() for c in ("series_id", "block", "p", "best")]):
                rest = np.array(rest)
                for x in chosen:
                    hit = np.array(x["d"]) <= rest
                    rest = rest - hit
                    rows.append((sid, x["rank"], x["start"], (np.flatnonzero(hit) + block * nearest.BLOCK).tolist()))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["series_id", "rank", "idx", "hits"])

    hits = mine.mapInArrow(explain, "series_id string, rank int, idx bigint, hits array<bigint>")
    hits = hits.groupBy("series_id", "rank", "idx").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).join(spans, "series_id")
    near = F.filter("hits", lambda x: x <= F.col("n") - size)
    # the last whole stretch stands for what is left of the series too
    tail = F.when(F.array_contains("hits", F.col("n") - size), F.sequence(F.col("n") - size + 1, F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))
    shapes = padded.join(picks, "series_id").filter((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + size)).groupBy("series_id", "rank").agg(points.alias("snippet"))
    return hits.join(shapes, ["series_id", "rank"]).select("series_id", "rank", "idx", "snippet", F.concat(near, tail).alias("neighbors"), (F.size("hits") / (F.col("m") - size)).alias("fraction"))
