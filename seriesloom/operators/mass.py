"""Distance profiles of a query, dot products and window distance matrices, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.sliding import windows
from seriesloom.operators import nearest
from seriesloom.session import ship


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


LONG = 256  # a longer query is multiplied by Fourier transforms of blocks instead of window by window


def sliding_dot(series: DataFrame, query: list[float]) -> DataFrame:
    """(series_id, idx, dot): dot product of the query with every window; null where a value is missing."""
    if len(query) > LONG:
        return _by_transform(series, np.array(query, float))
    return windows(series, len(query)).select("series_id", "idx", dot(F.col("window"), _array(query)).alias("dot"))


def _by_transform(series: DataFrame, query: np.ndarray) -> DataFrame:
    w = len(query)
    size = max(nearest.BLOCK, 1 << (2 * w - 1).bit_length()) - w + 1

    def run(batches):
        for batch in batches:
            for sid, block, values in zip(*[batch.column(c).to_pylist() for c in ("series_id", "block", "values")]):
                x = np.array(values, float)
                if len(x) < w:
                    continue
                gone = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
                x = np.where(np.isfinite(x), x, 0.0)
                n = 1 << (len(x) + w - 2).bit_length()
                # a correlation is a product with the query turned round
                dot = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(query[::-1], n), n)[w - 1 : len(x)][:size]
                at = np.arange(len(dot))
                yield pa.RecordBatch.from_arrays([pa.array([sid] * len(at), pa.string()), pa.array(at + block * size, pa.int64()), pa.array(dot, mask=gone[at + w] > gone[at])], ["series_id", "idx", "dot"])

    return nearest.blocks(ship(series.sparkSession) and series, w, size).mapInArrow(run, "series_id string, idx bigint, dot double")


def _moments(window: Column, w: int) -> tuple[Column, Column]:
    mean = F.aggregate(window, F.lit(0.0), lambda s, v: s + v) / w
    var = F.aggregate(window, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / w
    return mean, F.when(F.array_max(window) == F.array_min(window), 0.0).otherwise(F.sqrt(var))


def distance_of(p: Column, mu: Column, sd: Column, q_mu: Column, q_sd: Column, w: int) -> Column:
    """Distance from a dot product and moments; a constant window is sqrt(w) away, two constant ones 0."""
    r = (p - w * mu * q_mu) / (w * sd * q_sd)
    d2 = 2.0 * w * (1 - r)
    return F.when((sd == 0) & (q_sd == 0), 0.0).when((sd == 0) | (q_sd == 0), math.sqrt(w)).otherwise(F.sqrt(F.when(d2 < 0, 0.0).otherwise(d2)))


def profile(series: DataFrame, query: list[float], extras: bool = False, threshold: float = 0.0) -> DataFrame:
    """(series_id, idx, dist): z-normalised distance of one query to every window.

    A window (or query) whose standard deviation is below ``threshold`` counts as constant.  With ``extras`` also ``product`` (the
    dot product), and mean and deviation of window and query.
    """
    w = len(query)
    q = [float(v) for v in query]
    q_mu = sum(q) / w
    q_sd = 0.0 if max(q) == min(q) else math.sqrt(sum((v - q_mu) ** 2 for v in q) / w)
    q_sd = 0.0 if q_sd < threshold else q_sd
    win = windows(series, w).withColumn("p", dot(F.col("window"), _array(q)))
    mu, sd = _moments(F.col("window"), w)
    win = win.withColumns({"mu": mu, "sd": F.when(sd < threshold, 0.0).otherwise(sd)})
    more = [F.col("p").alias("product"), F.col("mu").alias("mean"), F.col("sd").alias("std"), F.lit(q_mu).alias("query_mean"), F.lit(q_sd).alias("query_std")] if extras else []
    return win.select("series_id", "idx", distance_of(F.col("p"), F.col("mu"), F.col("sd"), F.lit(q_mu), F.lit(q_sd), w).alias("dist"), *more)


def matrix(series: DataFrame, query: DataFrame, w: int) -> DataFrame:
    """(series_id, q, idx, dist): distance of every window of ``query`` to every window of the series of the same id."""
    side = lambda s, idx: _described(windows(s, w), w, idx)
    a, b = side(series, "i"), side(query, "q")
    both = a.join(b, "series_id")
    return both.select("series_id", F.col("q_idx").alias("q"), F.col("i_idx").alias("idx"), distance_of(dot(F.col("i_win"), F.col("q_win")), F.col("i_mu"), F.col("i_sd"), F.col("q_mu"), F.col("q_sd"), w).alias("dist"))


def _described(win: DataFrame, w: int, name: str) -> DataFrame:
    mu, sd = _moments(F.col("window"), w)
    return win.select("series_id", F.col("idx").alias(f"{name}_idx"), F.col("window").alias(f"{name}_win"), mu.alias(f"{name}_mu"), sd.alias(f"{name}_sd"))
