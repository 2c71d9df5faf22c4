"""Sliding-window functions.

A window of length w starts at idx i and covers i .. i + w - 1; only whole
windows have a row.  Points are dealt into blocks of ``block`` window starts
plus the w - 1 points that follow, so a long series is many window partitions
rather than one, and the frames run in Spark's own window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.errors import check_window

BLOCK = 65536


def missing(value: Column | str = "value") -> Column:
    """Null, NaN and infinite values."""
    v = F.col(value) if isinstance(value, str) else value
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def clean(series: DataFrame) -> DataFrame:
    """Missing values become 0."""
    return series.withColumn("value", F.when(missing(), 0.0).otherwise(F.col("value")))


def blocked(points: DataFrame, w: int, block: int = BLOCK) -> DataFrame:
    """Every point in each block (column ``block``) whose windows cover it."""
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - (w - 1)) / block)).cast("bigint")
    last = F.floor(F.col("idx") / block).cast("bigint")
    if w == 1:
        return points.withColumn("block", last)
    return points.withColumn("block", F.explode(F.sequence(first, last)))


def over(points: DataFrame, w: int, columns: dict, block: int = BLOCK) -> DataFrame:
    """``columns`` (name -> function of a window spec giving a Column) for each whole window."""
    check_window(w, 1)
    part = Window.partitionBy("series_id", "block").orderBy("idx")
    frame = part.rowsBetween(0, w - 1)
    cols = {name: fn(frame) for name, fn in columns.items()}
    out = blocked(points, w, block).withColumns({**cols, "_n": F.count(F.lit(1)).over(frame)})
    return out.filter((F.col("_n") == w) & (F.floor(F.col("idx") / block) == F.col("block"))).drop("_n", "block")


def skip_locations(series: DataFrame, w: int) -> DataFrame:
    """(series_id, idx, skip): whether the window holds a missing value."""
    flag = missing().cast("int")
    return over(series, w, {"skip": lambda f: F.max(flag).over(f) == 1}).select("series_id", "idx", "skip")


def moving(series: DataFrame, w: int) -> DataFrame:
    """Mean, population deviation, least, largest, median and inverse norm of every window."""
    v = F.col("value")
    deviation = lambda f: F.when(F.min(v).over(f) == F.max(v).over(f), 0.0).otherwise(F.stddev_pop(v).over(f))
    out = over(
        series, w,
        {
            "moving_avg": lambda f: F.avg(v).over(f), "moving_std": deviation,
            "moving_min": lambda f: F.min(v).over(f), "moving_max": lambda f: F.max(v).over(f),
            "moving_median": lambda f: F.percentile(v, F.lit(0.5)).over(f),
        },
    )
    norm = F.when(F.col("moving_std") == 0, 0.0).otherwise(1 / (F.col("moving_std") * F.sqrt(F.lit(float(w)))))
    return out.select("series_id", "idx", "moving_avg", "moving_std", "moving_min", "moving_max", "moving_median", norm.alias("inverse_norm"))


def statistics(series: DataFrame, w: int) -> tuple[DataFrame, DataFrame]:
    """Global figures per series, and the moving ones."""
    check_window(w, 3)
    v = F.col("value")
    whole = series.groupBy("series_id").agg(
        F.min(v).alias("ts_min"), F.max(v).alias("ts_max"), F.avg(v).alias("ts_mean"), F.stddev_pop(v).alias("ts_std"), F.percentile(v, F.lit(0.5)).alias("ts_median"), F.count("*").alias("n")
    )
    return whole, moving(series, w)


def windows(series: DataFrame, w: int, block: int = BLOCK) -> DataFrame:
    """(series_id, idx, window): the values of every whole window."""
    return over(series, w, {"window": lambda f: F.collect_list(F.coalesce("value", F.lit(float("nan")))).over(f)}, block).select("series_id", "idx", "window")


def running_sum(df: DataFrame, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Running sum over idx per series, in two steps: within blocks, and over the sums of the blocks before."""
    cut = df.withColumn("_b", F.floor(F.col("idx") / block).cast("bigint"))
    sums = cut.groupBy("series_id", "_b").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("series_id", "_b", before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("series_id", "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_in", inside).join(sums, ["series_id", "_b"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")
