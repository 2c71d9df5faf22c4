"""Reading series from files, and storing profiles."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.errors import check_choice

FORMATS = ("json", "parquet", "binary")
EXTENSIONS = {"json": ".json", "parquet": ".parquet", "binary": ".bin"}


def read_text(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """One number a line (plain or gzip), one series per file, in file order.

    A file is one record, since line order within a file must not depend on splits.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("v"))
    long = lines.select(F.lit(series_id).alias("series_id") if series_id else F.regexp_replace("file", r"\.txt(\.gz)?$", "").alias("series_id"), F.posexplode("v").alias("idx", "s"))
    return long.select("series_id", F.col("idx").cast("bigint").alias("idx"), F.expr("try_cast(s as double)").alias("value"))


def csv_roles(header: list[str]) -> tuple[str | None, list[str]]:
    """Which column of a CSV header is the time (the last that names a date or time), and which are values."""
    times = [c for c in header if re.search("date|time", c, re.I)]
    return (times[-1] if times else None), [c for c in header if c not in times]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (plain or gzip): one series per value column, ordered by the time column or, without one, by line."""
    raw = spark.read.csv(path, header=True)
    time, values = csv_roles(raw.columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("series_id"), F.col(f"`{c}`").cast("double").alias("value")) for c in values]))
    order = F.to_timestamp(F.col(f"`{time}`")) if time else F.lit(None).cast("timestamp")
    long = raw.select(order.alias("ts"), F.monotonically_increasing_id().alias("line"), cells.alias("c")).select("c.series_id", "ts", "line", "c.value")
    idx = F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "line")) - 1
    return long.select("series_id", idx.cast("bigint").alias("idx"), "ts", "value")


def listing(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Entries of a JSON listing of series files (name, category, ...), of one category if given."""
    entries = spark.read.json(path, multiLine=True)
    if category is None:
        return entries
    out = entries.filter(F.lower("category") == category.lower())
    if not out.limit(1).count():
        raise ValueError(f"no series of category {category!r}")
    return out


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A series file of a folder by its name, with or without extension, in any case."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(hadoop)]
    for p in sorted(files, key=lambda p: p.getName()):
        base = re.sub(r"\.(txt|csv)(\.gz)?$", "", p.getName())
        if name.lower() in (p.getName().lower(), base.lower()):
            return (read_csv if ".csv" in p.getName() else read_text)(spark, p.toString())
    raise ValueError(f"no series named {name!r}")


def format_of(path: str) -> str:
    """The format that a path's extension names."""
    for kind, ext in EXTENSIONS.items():
        if path.lower().endswith(ext):
            return kind
    raise RuntimeError(f"unknown file format: {path}")


def with_extension(path: str, kind: str) -> str:
    return path if path.lower().endswith(EXTENSIONS[kind]) else path + EXTENSIONS[kind]


def write(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Store any table of the library; Parquet is laid out by window length, so one length is read alone."""
    check_choice(kind, FORMATS, "format")
    path = with_extension(path, kind)
    if kind == "parquet":
        writer = df.write.partitionBy("w") if "w" in df.columns else df.write
        writer.parquet(path)
    elif kind == "json":
        df.write.json(path)
    else:
        encode(df).write.parquet(path)
    return path


def read(spark: SparkSession, path: str, kind: str = "infer", schema=None) -> DataFrame:
    kind = format_of(path) if kind == "infer" else check_choice(kind, FORMATS, "format")
    if kind == "json":
        return spark.read.json(path, schema=schema)
    if kind == "binary":
        return decode(spark.read.parquet(path))
    return spark.read.parquet(path)


_HEAD = "<4sBI"
_MAGIC = b"SLP1"


def encode(profile: DataFrame) -> DataFrame:
    """One binary value per (series_id, w): a header and the compressed columns mp, pi and, if there, lmp, lpi, rmp, rpi."""
    names = [c for c in ("mp", "pi", "lmp", "lpi", "rmp", "rpi") if c in profile.columns]
    rows = profile.groupBy("series_id", "w").agg(F.array_sort(F.collect_list(F.struct("idx", *names))).alias("rows"))
    arrays = rows.select("series_id", "w", *[F.col(f"rows.{c}").alias(c) for c in ["idx", *names]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                cols = [np.array([np.nan if v is None else v for v in batch.column(c)[i].as_py()], "<f8") for c in ["idx", *names]]
                body = zlib.compress(np.concatenate(cols).tobytes() if cols else b"")
                out.append(struct.pack(_HEAD, _MAGIC, len(cols), len(cols[0])) + ",".join(["idx", *names]).encode() + b"\0" + body)
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("w"), pa.array(out, pa.binary())], ["series_id", "w", "data"])

    return arrays.mapInArrow(run, "series_id string, w int, data binary")


def decode(stored: DataFrame) -> DataFrame:
    """The profile from binary values; columns that were not stored are null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for sid, w, data in zip(*[c.to_pylist() for c in batch.columns]):
                magic, k, n = struct.unpack_from(_HEAD, data)
                if magic != _MAGIC:
                    raise ValueError("not a stored profile")
                names, body = data[struct.calcsize(_HEAD) :].split(b"\0", 1)
                cols = dict(zip(names.decode().split(","), np.frombuffer(zlib.decompress(body), "<f8").reshape(k, n)))
                out = [pa.array([sid] * n, pa.string()), pa.array([w] * n, pa.int32())]
                for c in ("idx", "mp", "pi", "lmp", "lpi", "rmp", "rpi"):
                    kind = pa.int64() if c in ("idx", "pi", "lpi", "rpi") else pa.float64()
                    x = cols.get(c)
                    out.append(pa.nulls(n, kind) if x is None else pa.array(x.astype(np.int64) if kind == pa.int64() else x, kind, mask=np.isnan(x)))
                yield pa.RecordBatch.from_arrays(out, ["series_id", "w", "idx", "mp", "pi", "lmp", "lpi", "rmp", "rpi"])

    return stored.select("series_id", "w", "data").mapInArrow(run, "series_id string, w int, idx bigint, mp double, pi bigint, lmp double, lpi bigint, rmp double, rpi bigint")
