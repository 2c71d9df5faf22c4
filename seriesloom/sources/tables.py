"""Series derived from relational tables.

A series is a table (series_id, idx, value) with idx = 0, 1, 2, ... per series;
null, NaN and infinite values are all missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def by_time(df: DataFrame, unit: str, ts: str, value, series_id=None) -> DataFrame:
    """Sum of ``value`` per time unit and series; only units that occur, numbered in order.

    The sums have a row per unit, so numbering sorts far fewer rows than the table has.
    """
    sid = F.lit("all") if series_id is None else series_id
    sums = df.groupBy(sid.alias("series_id"), F.date_trunc(unit, ts).alias("ts")).agg(F.sum(value).alias("value"))
    sums = sums.filter("ts is not null")
    return sums.withColumn("idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).cast("bigint")).select("series_id", "idx", "ts", "value")


def dense(series: DataFrame, unit: str) -> DataFrame:
    """The series with a row for every time unit between its first and last; absent values are null."""
    step = F.expr(f"interval 1 {unit}")
    span = series.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("series_id", F.posexplode(F.sequence("a", "b", step)).alias("idx", "ts"))
    return grid.join(series.select("series_id", "ts", "value"), ["series_id", "ts"], "left").select("series_id", F.col("idx").cast("bigint").alias("idx"), "ts", "value")


def events_hourly(spark, sf_dir):
    return by_time(table(spark, sf_dir, "events"), "hour", "ts", F.round(F.col("value"), 6).cast("decimal(30,6)")).withColumn("value", F.col("value").cast("double"))


def events_hourly_by_type(spark, sf_dir):
    return by_time(table(spark, sf_dir, "events"), "hour", "ts", F.round(F.col("value"), 6).cast("decimal(30,6)"), F.col("event_type")).withColumn("value", F.col("value").cast("double"))


def orders_daily(spark, sf_dir):
    return by_time(table(spark, sf_dir, "orders"), "day", "o_orderdate", F.round(F.col("o_totalprice"), 2).cast("decimal(30,2)")).withColumn("value", F.col("value").cast("double"))


def lineitem_daily(spark, sf_dir):
    return by_time(table(spark, sf_dir, "lineitem"), "day", "l_shipdate", F.round(F.col("l_quantity"), 2).cast("decimal(30,2)")).withColumn("value", F.col("value").cast("double"))


def embedding_series(spark, sf_dir, most: int | None = None):
    """One series per vector; ``most`` keeps vectors with vec_id below it."""
    vecs = table(spark, sf_dir, "embeddings")
    vecs = vecs if most is None else vecs.filter(F.col("vec_id") < most)
    long = vecs.select(F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("idx", "value"))
    return long.select("series_id", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double").alias("value"))


def from_values(spark: SparkSession, series: dict[str, list]) -> DataFrame:
    """A series table from Python sequences."""
    rows = []
    for sid, values in series.items():
        if not hasattr(values, "__iter__") or isinstance(values, (str, bytes)):
            raise ValueError("a series must be a sequence of numbers")
        rows += [(str(sid), i, None if v is None else float(v)) for i, v in enumerate(values)]
    return ship(spark).createDataFrame(rows, "series_id string, idx bigint, value double")


def pack(series: DataFrame) -> DataFrame:
    """(series_id, values): one array per series, in order."""
    got = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return series.groupBy("series_id").agg(F.transform(got, lambda x: x["value"]).alias("values"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("series_id", F.posexplode("values").alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))
