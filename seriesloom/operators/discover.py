"""Greedy discovery on profiles: discords, motifs, regimes; and the arc curve.

A greedy pick excludes a fixed number of places around itself, so the first k picks
are among the (k - 1) * (places + 1) + 1 best rows of a series, and only those go
to the task that picks.  No task holds a whole series.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.sliding import running_sum
from seriesloom.operators import nearest
from seriesloom.session import checkpoints, ship


def _finite(c: str):
    v = F.col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


PART = 4096  # rows of a series that are sorted together before its best are


def greedy(df: DataFrame, value: str, k: int, zone, largest: bool, late_first: bool, by_window: bool = False) -> DataFrame:
    """(series_id, w, rank, idx, value): k picks per series, each excluding the places idx - before .. idx + after.

    ``zone`` gives (before, after) from a series' longest window, for columns and for numbers alike.  Only the best rows of
    each part of a series meet in the task that picks.
    ``late_first``: ties go to the higher idx.  ``by_window``: picks exclude only rows of the same w; ties go to the smaller w.
    """
    ship(df.sparkSession)
    top = df.filter(_finite(value)).select("series_id", "w", "idx", F.col(value).alias("v"))
    span = top.groupBy("series_id").agg(F.max("w").alias("longest"))
    before, after = zone(F.col("longest"))
    most = F.lit((k - 1) * (before + after + 1) + 1)
    order = [F.desc("v") if largest else F.asc("v"), F.asc("w"), F.desc("idx") if late_first else F.asc("idx")]
    # no row beyond the first ``most`` of its part can be picked
    part = F.floor(F.col("idx") / F.greatest(F.lit(PART), most))
    top = top.join(span, "series_id").withColumn("place", F.row_number().over(Window.partitionBy("series_id", "w", part).orderBy(*order))).filter(F.col("place") <= most)
    top = top.withColumn("turn", F.row_number().over(Window.partitionBy("series_id").orderBy(*order))).filter(F.col("turn") <= most)

    def pick(key, table):
        at = np.argsort(table.column("turn").to_numpy(), kind="stable")
        before, after = zone(int(table.column("longest")[0].as_py()))
        w, idx, val = (table.column(c).to_numpy()[at] for c in ("w", "idx", "v"))
        free, out = np.ones(len(at), bool), []
        for rank in range(1, k + 1):
            left = np.flatnonzero(free)
            if not len(left):
                break
            p = left[0]
            out.append((key[0].as_py(), int(w[p]), rank, int(idx[p]), float(val[p])))
            near = (idx >= idx[p] - before) & (idx <= idx[p] + after)
            near[p] = True
            free &= ~(near & (w == w[p])) if by_window else ~near
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["series_id", "w", "rank", "idx", "value"])

    return top.groupBy("series_id").applyInArrow(pick, "series_id string, w int, rank int, idx bigint, value double")


def discords(profile: DataFrame, k: int = 3, zone: int | None = None, column: str = "mp") -> DataFrame:
    """The k windows farthest from their neighbours; each excludes ``zone`` places before it and zone - 1 after it.

    ``zone`` defaults to a quarter of the window; 0 excludes nothing.
    """
    return greedy(profile, column, k, lambda w: _around(_quarter(w) if zone is None else zone), True, True).withColumnRenamed("value", column)


def _quarter(w):
    return F.ceil(w / 4) if isinstance(w, Column) else math.ceil(w / 4)


def _around(zone):
    """Places before and after a pick that a zone excludes."""
    if isinstance(zone, Column):
        return F.greatest(zone, F.lit(0)), F.greatest(zone - 1, F.lit(0))
    return max(0, zone), max(0, zone - 1)


def pan_discords(pan: DataFrame, k: int = 3, zone: int | None = None) -> DataFrame:
    """Discords over all window lengths; picks exclude only rows of their own length.

    Without ``zone`` it is half the length of the first hit, for all picks.
    """
    if zone is None:
        first = pan.filter(_finite("mp")).groupBy("series_id").agg(F.max_by("w", F.struct("mp", -F.col("w"), -F.col("idx"))).alias("w"))
        out = None
        for (half,) in first.select(F.floor(F.col("w") / 2).cast("int")).distinct().collect():  # one of the lengths that were asked for
            mine = first.filter(F.floor(F.col("w") / 2) == half).select("series_id")
            part = greedy(pan.join(mine, "series_id"), "mp", k, lambda _, h=half: _around(h), True, False, True)
            out = part if out is None else out.unionByName(part)
        if out is not None:
            return out.withColumnRenamed("value", "mp")
    return greedy(pan, "mp", k, lambda _: _around(zone or 0), True, False, True).withColumnRenamed("value", "mp")


def _distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances of a query to the windows of x, a constant window being sqrt(w) from any other."""
    w = len(query)
    if w <= nearest.LONG:
        z, q = nearest.normalise(x, w)[0], nearest.normalise(query, w)[0][0]
        r, flat, same = z @ q, ~z.any(axis=1), not q.any()
    else:
        c, mean, inv, _ = nearest.moments(x, w)
        cq, mq, iq, _ = nearest.moments(query, w)
        n = 1 << (len(c) + w - 2).bit_length()
        dot = np.fft.irfft(np.fft.rfft(c, n) * np.fft.rfft(cq[::-1], n), n)[w - 1 : len(c)]
        r, flat, same = (dot - w * mean * mq[0]) * inv * iq[0], inv == 0, iq[0] == 0
    if same:
        return np.where(flat, 0.0, math.sqrt(w))
    return np.where(flat, math.sqrt(w), np.sqrt(np.maximum(0.0, 2 * w * (1 - np.round(r, 10)))))


def motifs(series: DataFrame, profile: DataFrame, k: int = 3, zone: int | None = None, max_neighbors: int = 10, radius: float = 3.0, column: str = "mp") -> DataFrame:
    """(series_id, rank, w, role, place, idx): pairs of like windows, and the windows like the first of them.

    Greedy: the least profile value and its neighbour are a motif; windows within
    ``radius`` times its distance of its first occurrence are neighbours; everything within ``zone``
    places of any of them is out for what follows.  ``profile`` may hold several
    window lengths; then a pick is out only for its own length, and the zone
    defaults to half the length of the first motif.

    A pick is one aggregation; its neighbours come from the series in blocks, and only the best of those within the
    radius meet in a task.  Picks are written to the session's shared folder, a few rows each.
    """
    ship(series.sparkSession)
    checkpoints(series.sparkSession)
    value = F.when(_finite(column), F.col(column))
    rows = profile.select("series_id", "w", "idx", value.alias("v"), "pi").checkpoint()
    pan = rows.select("w").distinct().limit(2).count() > 1
    default = F.floor(F.col("w") / 2) if pan else F.ceil(F.col("w") / 4)
    taken, zones, found = None, None, []

    def free(df):
        if taken is None:
            return df
        near = F.exists("at", lambda a: F.abs(F.col("idx") - a) <= F.greatest(F.col("z"), F.lit(0)))
        return df.join(taken, ["series_id", "w"], "left").filter(F.col("at").isNull() | ~near).drop("at", "z")

    def take(*more):
        """The places that are out: those of before and of (series_id, w, idx) tables."""
        every = None if taken is None else taken.select("series_id", "w", F.explode("at").alias("idx"))
        for m in more:
            every = m.select("series_id", "w", "idx") if every is None else every.unionByName(m.select("series_id", "w", "idx"))
        return every.groupBy("series_id", "w").agg(F.collect_list("idx").alias("at")).join(zones, "series_id").checkpoint()

    for rank in range(1, k + 1):
        best = free(rows.filter("v is not null")).groupBy("series_id").agg(F.min(F.struct("v", "w", "idx", "pi")).alias("p")).filter("p.pi >= 0")
        if found:
            best = best.join(found[-1].select("series_id"), "series_id", "left_semi")  # a series that ended has no more
        pick = best.select("series_id", "p.w", F.col("p.v").alias("least"), F.least("p.idx", "p.pi").alias("a"), F.greatest("p.idx", "p.pi").alias("b")).checkpoint()
        if not pick.limit(1).count():
            break
        if zones is None:
            zones = pick.select("series_id", (default if zone is None else F.lit(zone)).cast("bigint").alias("z")).checkpoint()
        found.append(pick)
        pair = pick.select("series_id", "w", F.explode(F.array("a", "b")).alias("idx"))
        taken = take(pair)
        # the first occurrence as a query, against the blocks of its series
        mine = series.join(pick.select("series_id", F.col("w").alias("w_"), "least", "a"), "series_id")
        points = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
        query = mine.filter("idx >= a and idx < a + w_").groupBy("series_id", "w_", "least").agg(points.alias("query"))
        longest = pick.agg(F.max("w")).first()[0]
        cut = nearest.blocks(mine.select("series_id", "idx", "value"), longest, nearest.BLOCK).join(query, "series_id")

        def close(batches):
            for batch in batches:
                for sid, values, block, w, least, q in zip(*[batch.column(c).to_pylist() for c in ("series_id", "values", "block", "w_", "least", "query")]):
                    x = np.array(values, float)
                    d = _distances(x, np.array(q, float))[: nearest.BLOCK] if len(x) >= w else np.zeros(0)
                    at = np.flatnonzero(d <= radius * least)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.string()), pa.array([w] * n, pa.int32()), pa.array(at + block * nearest.BLOCK, pa.int64()), pa.array(d[at])], ["series_id", "w", "idx", "d"])

        near = cut.select("series_id", "values", "block", "w_", "least", "query").mapInArrow(close, "series_id string, w int, idx bigint, d double")
        near = free(near.join(rows.filter("v is not null").select("series_id", "w", "idx"), ["series_id", "w", "idx"])).join(zones, "series_id")
        others = None
        for (z,) in zones.select("z").distinct().collect():  # one, or one of the lengths that were asked for
            around = max(0, z)
            part = greedy(near.filter(F.col("z") == z), "d", max_neighbors, lambda _, n=around: (n, n), False, False)
            others = part if others is None else others.unionByName(part)
        others = others.select("series_id", "w", "idx", F.col("rank").alias("place")).checkpoint()
        taken = take(others.join(zones.filter("z > 0"), "series_id"))
        found[-1] = pick.withColumn("rank", F.lit(rank))
        role = lambda df, name, place: df.select("series_id", F.lit(rank).alias("rank"), "w", F.lit(name).alias("role"), place.cast("int").alias("place"), "idx")
        out = role(pick.withColumn("idx", F.col("a")), "first", F.lit(0)).unionByName(role(pick.withColumn("idx", F.col("b")), "second", F.lit(0))).unionByName(role(others, "neighbor", F.col("place")))
        result = out if rank == 1 else result.unionByName(out)
    if not found:
        return series.sparkSession.createDataFrame([], "series_id string, rank int, w int, role string, place int, idx bigint")
    return result.select("series_id", "rank", F.col("w").cast("int").alias("w"), "role", "place", F.col("idx").cast("bigint").alias("idx"))


def arc_curve(profile: DataFrame) -> DataFrame:
    """(series_id, w, idx, cac): share of the expected neighbour arcs that cross each window; low where the series changes.

    Arcs run from a window to its neighbour; the expected number is a parabola half as high as the profile is long.
    """
    # written once: sizes, arcs and places are read from it
    checkpoints(profile.sparkSession)
    profile = profile.select("series_id", "w", "idx", "pi").checkpoint()
    size = profile.groupBy("series_id").agg(F.count("*").alias("n"))
    arcs = profile.filter("pi >= 0").select("series_id", F.least("idx", "pi").alias("a"), F.greatest("idx", "pi").alias("b"))
    marks = arcs.select("series_id", (F.col("a") + 1).alias("idx"), F.lit(1).alias("d")).unionByName(arcs.select("series_id", F.col("b").alias("idx"), F.lit(-1).alias("d")))
    delta = marks.groupBy("series_id", "idx").agg(F.sum("d").alias("d"))
    every = profile.select("series_id", "w", "idx").join(delta, ["series_id", "idx"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    crossed = running_sum(every, "d", "crossed").join(size, "series_id")
    ideal = ideal_arcs(F.col("n"), F.col("idx"))
    cac = F.when((F.col("idx") < F.col("w")) | (F.col("idx") >= F.col("n") - F.col("w")), 1.0).otherwise(F.least(F.lit(1.0), F.when(ideal == 0, 1.0).otherwise(F.col("crossed") / ideal)))
    return crossed.select("series_id", "w", "idx", cac.alias("cac"))


def ideal_arcs(n, idx):
    """Arcs expected to cross place idx of n if neighbours were anywhere: a parabola of height n / 2 over n."""
    half = n / 2.0
    return half - (idx - half) * (idx - half) / half


def regimes(profile: DataFrame, k: int = 3) -> DataFrame:
    """(series_id, w, rank, idx, cac): the k lowest places of the arc curve, five windows apart."""
    return greedy(arc_curve(profile), "cac", k, lambda w: (5 * w, 5 * w - 1), False, False).withColumnRenamed("value", "cac")
