"""Series from streams: tumbling sums with late data, and the profile kept up over a sliding horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators import nearest


def tumbling(events: DataFrame, ts: str, value: str, unit: str = "1 hour", late: str = "2 hours", key: str | None = None) -> DataFrame:
    """(series_id, ts, value): sums per time unit of a streaming (or static) table; later than ``late`` is dropped."""
    sid = F.lit("all") if key is None else F.col(key)
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    sums = marked.groupBy(sid.alias("series_id"), F.window(ts, unit).alias("win")).agg(F.sum(value).alias("value"))
    return sums.select("series_id", F.col("win.start").alias("ts"), "value")


def keep_profile(sums: DataFrame, w: int, sink, horizon: int = 4096):
    """A foreachBatch writer: after every micro-batch, ``sink(profile, batch_id)`` gets the profile of the last ``horizon`` points.

    Each batch writes the points of the horizon to a folder of its own in ``store`` and reads only the one before it, so what is
    read and compared does not grow with the stream.  A time unit's newest sum replaces earlier ones, whether it is more or less.
    A batch that runs again overwrites its own folder; folders before the last two are deleted.
    """

    def run(batch: DataFrame, batch_id: int, store: str):
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(store)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(n[6:]) for n in (f.getPath().getName() for f in (fs.listStatus(root) if fs.exists(root) else [])) if n.startswith("batch="))
        earlier = [n for n in done if n < batch_id and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{store}/batch={n}/_SUCCESS"))]
        new = batch.select("series_id", "ts", "value", F.lit(1).alias("age"))
        seen = new if not earlier else new.unionByName(spark.read.parquet(f"{store}/batch={earlier[-1]}").withColumn("age", F.lit(0)))
        seen = seen.groupBy("series_id", "ts").agg(F.max_by("value", "age").alias("value"))
        back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ts")))
        here = f"{store}/batch={batch_id}"
        seen.withColumn("back", back).filter(F.col("back") <= horizon).select("series_id", "ts", "value").write.mode("overwrite").parquet(here)
        for n in earlier[:-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{store}/batch={n}"), True)
        idx = F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1
        series = spark.read.parquet(here).select("series_id", idx.cast("bigint").alias("idx"), "ts", "value")
        sink(nearest.self_join(series, w), batch_id)

    return lambda store: (lambda batch, batch_id: run(batch, batch_id, store))
