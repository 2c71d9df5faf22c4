"""Nearest-neighbour join over several dimensions.

Two windows are compared in every dimension; sorted, the first k distances'
mean is their distance over the best k dimensions.  Row k of the profile is the
least such mean.  Tables carry ``dim``: (series_id, dim, idx, value).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import check_window
from seriesloom.operators import nearest
from seriesloom.session import ship


def self_join(series: DataFrame, w: int, block: int = 1024) -> DataFrame:
    """(series_id, k, w, idx, mp, pi, dims) for k = 1 .. dimensions; exclusion half a window, ties to the smallest index.

    A window that is constant in some dimension is nobody's neighbour there and
    has none itself at any k that would need that dimension.
    """
    check_window(w)
    ship(series.sparkSession)
    size = block
    keyed = series.select(F.struct("series_id", F.col("dim").cast("int").alias("dim")).alias("series_id"), "idx", "value")
    cut = nearest.blocks(keyed, w, size).select("series_id.series_id", "series_id.dim", "block", "values")
    last = cut.groupBy("series_id").agg(F.max("block").alias("last"))
    dealt = cut.join(last, "series_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    dealt = dealt.select("series_id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "dim", "values")
    zone = nearest.zone_half(w)

    def compare(key, table):
        sid, p, q = (k.as_py() for k in key)
        rows = {(b, d): np.array(v, float) for b, d, v in zip(table.column("block").to_pylist(), table.column("dim").to_pylist(), table.column("values").to_pylist())}
        dims = sorted({d for _, d in rows})
        cols = [[] for _ in range(6)]
        if all(len(rows[b, d]) >= w for b in (p, q) for d in dims):
            za = [nearest.normalise(rows[p, d], w) for d in dims]
            zb = [nearest.normalise(rows[q, d], w) for d in dims]
            na, nb = min(size, min(len(z[0]) for z in za)), min(size, min(len(z[0]) for z in zb))
            for a in range(0, na, 256):
                m = slice(a, min(na, a + 256))
                d2 = []
                for (x, ok_x), (y, ok_y) in zip(za, zb):
                    d = np.sqrt(np.maximum(0.0, 2 * w * (1 - np.minimum(1.0, np.round(x[m] @ y[:nb].T, 10)))))
                    bad = (~ok_x[m] | ~x[m].any(axis=1))[:, None] | (~ok_y[:nb] | ~y[:nb].any(axis=1))[None, :]
                    d[bad] = np.inf
                    d2.append(d)
                d2 = np.stack(d2)
                order = np.argsort(d2, axis=0, kind="stable")
                mean = np.cumsum(np.take_along_axis(d2, order, axis=0), axis=0) / np.arange(1, len(dims) + 1)[:, None, None]
                i, j = np.arange(p * size + m.start, p * size + m.stop), np.arange(q * size, q * size + nb)
                mean[:, np.abs(i[:, None] - j[None, :]) <= zone] = np.inf
                mean = np.round(mean, 9)
                for k in range(len(dims)):
                    for rows_idx, cols_idx, d, o in ((i, j, mean[k], order[: k + 1]), (j, i, mean[k].T, order[: k + 1].transpose(0, 2, 1))):
                        best = d.argmin(axis=1)
                        dist = d[np.arange(len(rows_idx)), best]
                        got = np.flatnonzero(np.isfinite(dist))
                        cols[0] += [k + 1] * len(got)
                        cols[1] += rows_idx[got].tolist()
                        cols[2] += dist[got].tolist()
                        cols[3] += cols_idx[best[got]].tolist()
                        cols[4] += [sorted(dims[x] for x in o[:, g, best[g]]) for g in got]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int32())]
        return pa.table([pa.array([sid] * len(cols[0]), pa.string()), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["series_id", "k", "idx", "mp", "pi", "dims"])

    found = dealt.groupBy("series_id", "p", "q").applyInArrow(compare, "series_id string, k int, idx bigint, mp double, pi bigint, dims array<int>")
    best = found.groupBy("series_id", "k", "idx").agg(F.min(F.struct("mp", "pi", "dims")).alias("b"))
    size_of = series.groupBy("series_id").agg((F.max("idx") - (w - 1)).alias("last"), F.countDistinct("dim").alias("dims"))
    every = size_of.filter("last >= 0").select("series_id", F.explode(F.sequence(F.lit(1), F.col("dims").cast("int"))).alias("k"), "last")
    every = every.select("series_id", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("idx"))
    out = every.join(best, ["series_id", "k", "idx"], "left")
    return out.select("series_id", "k", F.lit(w).alias("w"), "idx", F.coalesce("b.mp", F.lit(float("inf"))).alias("mp"), F.coalesce("b.pi", F.lit(-1).cast("bigint")).alias("pi"), F.col("b.dims").alias("dims"))
