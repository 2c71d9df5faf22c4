"""Annotation vectors: a weight in [0, 1] for every window, and the profile corrected by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.errors import check_choice
from seriesloom.functions.sliding import over

KINDS = ("default", "complexity", "meanstd", "clipping")


def complexity(series: DataFrame, w: int) -> DataFrame:
    """Length of the line through a window's points, scaled."""
    nxt = over(series, 2, {"d": lambda f: F.last("value").over(f) - F.first("value").over(f)}).select("series_id", "idx", (F.col("d") * F.col("d")).alias("d2"))
    raw = over(nxt, w - 1, {"raw": lambda f: F.sqrt(F.sum("d2").over(f))}).select("series_id", "idx", "raw")
    # scaled as (x - least) / largest, where the largest is taken before the least is subtracted
    ends = raw.groupBy("series_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.join(ends, "series_id").select("series_id", "idx", F.when(F.col("hi") == 0, 0.0).otherwise((F.col("raw") - F.col("lo")) / F.col("hi")).alias("av"))


def meanstd(series: DataFrame, w: int) -> DataFrame:
    """1 where a window's deviation is below the mean deviation."""
    v = F.col("value")
    std = over(series, w, {"s": lambda f: F.when(F.min(v).over(f) == F.max(v).over(f), 0.0).otherwise(F.stddev_pop(v).over(f))}).select("series_id", "idx", "s")
    mean = std.groupBy("series_id").agg(F.avg("s").alias("m"))
    return std.join(mean, "series_id").select("series_id", "idx", F.when(F.col("s") < F.col("m"), 1.0).otherwise(0.0).alias("av"))


def clipping(series: DataFrame, w: int) -> DataFrame:
    """1 less the scaled number of points in a window that equal the series' least or largest value."""
    ends = series.groupBy("series_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    flag = series.join(ends, "series_id").select("series_id", "idx", ((F.col("value") == F.col("a")) | (F.col("value") == F.col("b"))).cast("double").alias("hit"))
    raw = over(flag, w, {"raw": lambda f: F.sum("hit").over(f)}).select("series_id", "idx", "raw")
    least = raw.groupBy("series_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return raw.join(least, "series_id").select("series_id", "idx", F.when(span == 0, 0.0).otherwise(1 - (F.col("raw") - F.col("lo")) / span).alias("av"))


def make(series: DataFrame, w: int, kind: str) -> DataFrame:
    """(series_id, idx, av) of one kind."""
    check_choice(kind, KINDS, "annotation vector")
    if kind == "default":
        return over(series, w, {"av": lambda f: F.lit(1.0)}).select("series_id", "idx", "av")
    return {"complexity": complexity, "meanstd": meanstd, "clipping": clipping}[kind](series, w)


def apply(profile: DataFrame, av: DataFrame) -> DataFrame:
    """The profile with ``av`` and ``cmp`` = mp + (1 - av) max(mp).

    ``av`` must have a weight in [0, 1] for every window; the query fails otherwise.
    """
    top = profile.groupBy("series_id").agg(F.max("mp").alias("_top"))
    joined = profile.join(av.select("series_id", "idx", "av"), ["series_id", "idx"], "left").join(top, "series_id")
    ok = F.when(F.col("av").isNull(), F.raise_error(F.lit("the annotation vector is shorter than the profile"))).when(~F.col("av").between(0, 1), F.raise_error(F.lit("annotation values must lie between 0 and 1"))).otherwise(F.col("av"))
    return joined.withColumn("av", ok.cast("double")).withColumn("cmp", F.col("mp") + (1 - F.col("av")) * F.col("_top")).drop("_top")
