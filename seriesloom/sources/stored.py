"""Results kept whole: one row per series with everything a router made, as a table, JSON text or a binary profile message.

A row holds the arrays of one series.  Unlike a plain profile table it carries the settings, the series, motifs, discords,
corrected profiles and pan profiles too.  Nothing is dropped on the way out or back: left and right profiles and the query
are always written.  Absent fields come back as null.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.errors import check_choice
from seriesloom.session import ship
from seriesloom.sources.tables import pack

_PLACE = "struct<row:bigint,col:bigint>"
SCHEMA = (
    "series_id string, klass string, algorithm string, metric string, sample_pct double, windows array<bigint>, ts array<double>, query array<double>, "
    "mp array<double>, pi array<bigint>, lmp array<double>, lpi array<bigint>, rmp array<double>, rpi array<bigint>, ez bigint, joined boolean, "
    f"pmp array<array<double>>, pmpi array<array<bigint>>, motifs array<struct<motifs:array<{_PLACE}>,neighbors:array<{_PLACE}>>>, discords array<{_PLACE}>, "
    "cmp array<double>, av array<double>, av_type string"
)
FORMATS = ("json", "mpf")

# Field numbers of the messages.  A matrix has rows, columns (0 for a plain array) and data.
_MATRIX = {"rows": 1, "cols": 2, "data": 3}
_LOCATION = {"row": 1, "col": 2}
_MOTIF = {"motifs": 1, "neighbors": 2}
_PROFILE = {"mp": 1, "pi": 2, "lmp": 3, "lpi": 4, "rmp": 5, "rpi": 6, "ez": 9, "joined": 10}
_PAN = {"pmp": 1, "pmpi": 2}
_OUTPUT = {"klass": 1, "algorithm": 2, "metric": 3, "sample_pct": 4, "windows": 5, "ts": 6, "query": 7, "profile": 8, "pan": 9, "motifs": 10, "discords": 11, "cmp": 12, "av": 13, "av_type": 14}
_WHOLE = {"pi", "lpi", "rpi", "pmpi"}


def _ordered(df: DataFrame, *columns: str) -> DataFrame:
    """(series_id, one array per column) in the order of idx."""
    rows = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("r"))
    return rows.select("series_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def gather(made, query: DataFrame | None = None, ez: int | None = None, av_type: str | None = None) -> DataFrame:
    """``SCHEMA`` rows of a router's result (``plans.compute.Result``); corrected profiles come from its table ``cmp`` (idx, av, cmp)."""
    pan = made.kind == "pan"
    out = pack(made.series).withColumnRenamed("values", "ts")
    join = lambda right: out.join(right, "series_id", "left")
    if query is not None:
        out = join(pack(query).withColumnRenamed("values", "query"))
    at = {w: k for k, w in enumerate(made.windows)}
    row = F.element_at(F.create_map(*[F.lit(x) for pair in at.items() for x in pair]), F.col("w")) if pan else None
    place = lambda: F.struct((row if pan else F.col("idx")).cast("bigint").alias("row"), (F.col("idx") if pan else F.lit(0)).cast("bigint").alias("col"))
    if pan:
        lines = made.profile.groupBy("series_id", "w").agg(F.array_sort(F.collect_list(F.struct("idx", "mp", "pi"))).alias("r"))
        width = made.series.groupBy("series_id").agg((F.count("*") - min(made.windows) + 1).cast("int").alias("n"))
        padded = lambda c, none: F.concat(F.col(f"r.{c}"), F.array_repeat(F.lit(none), F.col("n") - F.size("r"))).alias(c)
        lines = lines.join(width, "series_id").select("series_id", "w", padded("mp", None), padded("pi", -1))
        both = lines.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("w", "mp", "pi"))).alias("r"))
        out = join(both.select("series_id", F.col("r.mp").alias("pmp"), F.col("r.pi").alias("pmpi")))
    else:
        out = join(_ordered(made.profile, *[c for c in ("mp", "pi", "lmp", "lpi", "rmp", "rpi") if c in made.profile.columns]))
    if "cmp" in made.tables:
        out = join(_ordered(made.tables["cmp"], "av", "cmp"))
    if "motifs" in made.tables:
        m = made.tables["motifs"].withColumn("at", place()).groupBy("series_id", "rank")
        pick = lambda *roles: F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles), F.struct("role", "place", "at")))), lambda x: x["at"])
        m = m.agg(pick("first", "second").alias("motifs"), pick("neighbor").alias("neighbors"))
        m = m.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("rank", "motifs", "neighbors"))).alias("r"))
        out = join(m.select("series_id", F.transform("r", lambda x: F.struct(x["motifs"].alias("motifs"), x["neighbors"].alias("neighbors"))).alias("motifs")))
    if "discords" in made.tables:
        d = made.tables["discords"].withColumn("at", place()).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("rank", "at"))).alias("r"))
        out = join(d.select("series_id", F.col("r.at").alias("discords")))
    told = {"klass": "PMP" if pan else "MatrixProfile", "algorithm": made.algorithm, "metric": "euclidean", "sample_pct": float(made.sample_pct), "joined": query is not None, "ez": ez, "av_type": av_type}
    out = out.withColumns({k: F.lit(v) for k, v in told.items()}).withColumn("windows", F.array(*[F.lit(w) for w in made.windows]))
    fields = [c.strip() for c in _names()]
    kinds = dict(zip(fields, made.series.sparkSession.createDataFrame([], SCHEMA).schema.fields))
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in fields])


def _names() -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMA).names


# --- the message --------------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _part(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n) -> bytes:
    return _varint(field << 3) + _varint(int(n)) if n else b""


def _matrix(field: int, name: str, values) -> bytes:
    if values is None:
        return b""
    nested = bool(values) and isinstance(values[0], (list, np.ndarray))
    flat = [x for line in values for x in line] if nested else values
    if name in _WHOLE:
        data = b"".join(_varint(-1 if x is None else int(x)) for x in flat)
    else:
        data = np.array([np.nan if x is None else x for x in flat], "<f8").tobytes()
    shape = _number(_MATRIX["rows"], len(values)) + _number(_MATRIX["cols"], len(values[0]) if nested else 0)
    return _part(field, shape + _part(_MATRIX["data"], data))


def _places(field: int, places) -> bytes:
    return b"".join(_part(field, _number(_LOCATION["row"], p["row"]) + _number(_LOCATION["col"], p["col"])) for p in places or ())


def encode_message(row: dict) -> bytes:
    """One ``SCHEMA`` row as a message."""
    out = b"".join(_part(_OUTPUT[c], row[c].encode()) for c in ("klass", "algorithm", "metric", "av_type") if row[c])
    if row["sample_pct"]:
        out += _varint(_OUTPUT["sample_pct"] << 3 | 1) + struct.pack("<d", row["sample_pct"])
    out += _part(_OUTPUT["windows"], b"".join(map(_varint, row["windows"] or ())))
    out += b"".join(_matrix(_OUTPUT[c], c, row[c]) for c in ("ts", "query", "cmp", "av"))
    inner = b"".join(_matrix(_PROFILE[c], c, row[c]) for c in ("mp", "pi", "lmp", "lpi", "rmp", "rpi"))
    inner += _number(_PROFILE["ez"], row["ez"]) + _number(_PROFILE["joined"], row["joined"])
    pan = b"".join(_matrix(_PAN[c], c, row[c]) for c in _PAN)
    out += (_part(_OUTPUT["profile"], inner) if inner else b"") + (_part(_OUTPUT["pan"], pan) if pan else b"")
    out += b"".join(_part(_OUTPUT["motifs"], _places(_MOTIF["motifs"], m["motifs"]) + _places(_MOTIF["neighbors"], m["neighbors"])) for m in row["motifs"] or ())
    return out + _places(_OUTPUT["discords"], row["discords"])


def _read(data: bytes) -> dict[int, list]:
    """Field number -> values as they stand: numbers, eight or four bytes, or parts."""
    out: dict[int, list] = {}
    at, n = 0, len(data)

    def number():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < n:
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size = number()
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("the message is cut short")
        else:
            raise ValueError("not a stored profile")
        out.setdefault(tag >> 3, []).append(value)
    return out


def _integers(parts: list, signed: bool) -> list[int]:
    out = []
    for part in parts:
        if isinstance(part, int):
            got = [part]
        else:
            got, x, shift = [], 0, 0
            for b in part:
                x |= (b & 127) << shift
                shift += 7
                if b < 128:
                    got.append(x)
                    x = shift = 0
        out += [v - (1 << 64) if signed and v >> 63 else v for v in got]
    return out


def _array(fields: dict, field: int, name: str):
    if field not in fields:
        return None
    m = _read(fields[field][-1])
    parts = m.get(_MATRIX["data"], [])
    flat = _integers(parts, True) if name in _WHOLE else [None if np.isnan(v) else float(v) for p in parts for v in np.frombuffer(p, "<f8")]
    cols = m.get(_MATRIX["cols"], [0])[-1]
    return [flat[i : i + cols] for i in range(0, len(flat), cols)] if cols else flat


def _locations(parts: list) -> list[dict]:
    return [{c: m.get(k, [0])[-1] for c, k in _LOCATION.items()} for m in map(_read, parts)]


def decode_message(data: bytes) -> dict:
    """A ``SCHEMA`` row (without series_id) from a message."""
    f = _read(data)
    text = lambda c: f[_OUTPUT[c]][-1].decode() if _OUTPUT[c] in f else None
    out = {c: text(c) for c in ("klass", "algorithm", "metric", "av_type")}
    out["sample_pct"] = struct.unpack("<d", f[_OUTPUT["sample_pct"]][-1])[0] if _OUTPUT["sample_pct"] in f else 0.0
    out["windows"] = _integers(f.get(_OUTPUT["windows"], []), False)
    out |= {c: _array(f, _OUTPUT[c], c) for c in ("ts", "query", "cmp", "av")}
    inner, pan = (_read(f[_OUTPUT[c]][-1]) if _OUTPUT[c] in f else {} for c in ("profile", "pan"))
    out |= {c: _array(inner, _PROFILE[c], c) for c in ("mp", "pi", "lmp", "lpi", "rmp", "rpi")} | {c: _array(pan, _PAN[c], c) for c in _PAN}
    out["ez"] = inner[_PROFILE["ez"]][-1] if _PROFILE["ez"] in inner else None
    out["joined"] = bool(inner.get(_PROFILE["joined"], [0])[-1])
    motifs = [_read(m) for m in f.get(_OUTPUT["motifs"], [])]
    out["motifs"] = [{c: _locations(m.get(k, [])) for c, k in _MOTIF.items()} for m in motifs] or None
    out["discords"] = _locations(f.get(_OUTPUT["discords"], [])) or None
    return out


# --- tables ------------------------------------------------------------------------------------------------


def to_messages(rows: DataFrame) -> DataFrame:
    """(series_id, data): every row as a message."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            got = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["series_id"] for r in got], pa.string()), pa.array([encode_message(r) for r in got], pa.binary())], ["series_id", "data"])

    return rows.mapInArrow(run, "series_id string, data binary")


def from_messages(stored: DataFrame) -> DataFrame:
    """``SCHEMA`` rows from (series_id, data)."""
    ship(stored.sparkSession)
    names = _names()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            got = [{"series_id": s} | decode_message(d) for s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in got], arrow)

    return stored.select("series_id", F.col("data").cast("binary")).mapInArrow(run, SCHEMA)


def to_json(rows: DataFrame) -> DataFrame:
    """(series_id, value): every row as JSON text; infinite values and NaN are kept as names."""
    return rows.select("series_id", F.to_json(F.struct(*_names())).alias("value"))


def from_json(stored: DataFrame) -> DataFrame:
    return stored.select(F.from_json("value", SCHEMA, {"allowNonNumericNumbers": "true"}).alias("r")).select("r.*")


def write(rows: DataFrame, path: str, kind: str) -> str:
    """Store results as JSON lines, or as a table of messages (``export`` makes single files)."""
    check_choice(kind, FORMATS, "format")
    if kind == "json":
        to_json(rows).select("value").write.text(path)
    else:
        to_messages(rows).write.parquet(path)
    return path


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    check_choice(kind, FORMATS, "format")
    return from_json(spark.read.text(path)) if kind == "json" else from_messages(spark.read.parquet(path))


def export(rows: DataFrame, folder: str) -> None:
    """One message file per series, ``<series_id>.mpf``, written one after the other through Spark's file system."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for r in to_messages(rows).toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(folder, f"{r.series_id}.mpf")
        out = where.getFileSystem(conf).create(where)
        out.write(bytes(r.data))
        out.close()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Message files, also those that others wrote; series are named by their files."""
    files = spark.read.format("binaryFile").load(path)
    return from_messages(files.select(F.regexp_extract("path", r"([^/]*?)(\.mpf)?$", 1).alias("series_id"), F.col("content").alias("data")))
