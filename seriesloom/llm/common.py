"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import textops
from seriesloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local master may do without: all its tasks see the machine's temporary
    folder.  Any other session must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loom_shared", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark._loom_shared = f"file://{tempfile.mkdtemp(prefix='loom-')}"
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with files that survive lost executors; the folder goes
    when the session's JVM ends, or with ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``keep`` wrote; the table must not be read again."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._loom_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of a key as text, modulo n; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def map_text(df: DataFrame, text: str, carry: list[str] | None, fields: T.StructType, fn: Callable[[pa.Array], list]) -> DataFrame:
    """Columns that ``fn`` computes from whole texts, beside carried columns.

    ``carry`` lists the columns to keep at top level, or is None to keep the
    whole row in one struct column ``row`` (so no name can clash).  ``fn`` gets
    slices of a few MB and returns one array per field, in row order.
    """
    if carry is None:
        src = df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text_in"))
        if dict(df.dtypes)[text] == "string":
            src = df.select(F.struct("*").alias("row"))
    else:
        src = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("text_in"))
    bounded(df.sparkSession)
    kept = src.drop("text_in")
    schema = T.StructType(kept.schema.fields + fields.fields)
    names = kept.columns

    def run(batches):
        for batch in batches:
            if "text_in" in batch.schema.names:
                texts = batch.column("text_in")
            else:
                row = batch.column("row")
                texts = row.flatten()[row.type.get_field_index(text)]
            for at, part in textops.pieces(texts):
                rows = [batch.column(c).slice(at, len(part)) for c in names]
                new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in fn(part)]
                yield pa.RecordBatch.from_arrays(rows + new, names + fields.names)

    return src.mapInArrow(tidy(run), schema)


def bounded(spark: SparkSession) -> None:
    """Batches for Python of a few MB, however long texts are, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str((1 << 31) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tidy(run):
    """``run``, an Arrow function over batches, that hands freed memory back when a task ends: Python workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def fields(spec: str) -> T.StructType:
    """A schema from DDL text, every column nullable."""
    return T.StructType.fromDDL(spec) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(spec)
