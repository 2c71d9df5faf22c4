"""WARC records and a Merkle fixity audit of replicas.

``records`` writes every page as a WARC/1.1 resource record, ``place`` gives it the
file it belongs to and its offset and length there.  ``tree`` hashes a replica: a leaf is the place (file, offset, length)
and the hash of the record (or records) of one number, an inner node the hash of the ordered hashes of the
up to ``FAN`` nodes below it.  Numbers are in the order of offsets, so a node stands for an
offset range of a file.  ``audit`` compares two replicas from the root and goes down only
below nodes that differ; what differs at the bottom are damaged, moved, missing or
surplus records.

Scale: a level is one aggregation keyed by node, at most ``FAN`` rows a group;
leaves with repeated numbers are added up, not collected.  Comparing replicas
moves the trees' upper levels and the differing branches, not the records; trees are
deleted after it.

Defined results: records without a number share one leaf of number -1; null url or html
counts as empty; records of any length are hashed whole; equal repeated records lie one after the other and count by how
often they occur (ties cannot be told apart and need not); two empty replicas agree; an empty table has no records; other columns, whatever
their names, are not looked at.  ``read_warc`` reads files of up to 2 GB, Spark's limit for one value.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import forget, keep

FAN = 64
FILE_RECORDS = 1000
CRLF = "\r\n"


def record(key: Column, url: Column, html: Column) -> Column:
    """One WARC record as text (its bytes are the UTF-8 of it)."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF * 2),
    )


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(number, record): every page as a record."""
    return pages.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-1)).alias("number"), record(F.col(key), F.col(url), F.col(html)).alias("record"))


def place(recs: DataFrame) -> DataFrame:
    """(number, record, more) -> (number, file, offset, length, sha256, more); files hold ``FILE_RECORDS`` numbers each, in order."""
    more = [c for c in recs.columns if c not in ("number", "record")]
    sized = recs.withColumns({"file": F.floor(F.col("number") / FILE_RECORDS).cast("bigint"), "length": F.octet_length("record").cast("bigint"), "sha256": F.sha2(F.col("record").cast("binary"), 256)}).drop("record")
    # offsets per number first, then within repeated numbers, so that a repeated number is no hot window of a file
    per = sized.groupBy("file", "number").agg(F.sum("length").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("file", "number", before.alias("start"))
    within = F.coalesce(F.sum("length").over(Window.partitionBy("file", "number").orderBy("sha256", "length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("within", within).join(starts, ["file", "number"]).select("number", "file", (F.col("start") + F.col("within")).cast("bigint").alias("offset"), "length", "sha256", *more)


def _sums(sha) -> Column:
    """A hash over a set of hashes in any order, by how often each occurs."""
    parts = [F.sum(F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[p.cast("string") for p in parts]), 256)


def leaves(placed: DataFrame) -> DataFrame:
    """(node, hash, content): one leaf per number; ``content`` leaves places out."""
    whole = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("file", "offset", "length")], "sha256"), 256)
    return placed.select("number", "sha256", whole.alias("whole")).groupBy(F.col("number").alias("node")).agg(_sums("whole").alias("hash"), _sums("sha256").alias("content"))


def tree(placed: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of (node, hash), leaves first; node n of a level covers nodes n * FAN .. of the level below."""
    out = [keep(leaves(placed), "merkle")]
    for _ in range(levels):
        below = out[-1].select(F.floor(F.col("node") / FAN).cast("bigint").alias("up"), "node", "hash")
        group = F.array_sort(F.collect_list(F.struct("node", "hash")))
        text = F.array_join(F.transform(group, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), "\n")
        out.append(keep(below.groupBy("up").agg(F.sha2(text, 256).alias("hash")).withColumnRenamed("up", "node"), "merkle"))
    return out


def depth_for(*replicas: DataFrame) -> int:
    """Levels above the leaves until one node on either side of zero covers all numbers."""
    most = 0
    for r in replicas:
        lo, hi = r.agg(F.min("number"), F.max("number")).first()
        most = max(most, abs(lo or 0), abs(hi or 0))
    n = 1
    while FAN**n <= most:
        n += 1
    return n


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(number, status) of every record that differs between replicas as ``place`` gives them.

    Status is damaged, moved (the same records elsewhere), missing (in b) or surplus (in b).
    """
    levels = depth_for(a, b)
    ta, tb = tree(a, levels), tree(b, levels)
    differ = None
    for x, y in zip(reversed(ta), reversed(tb)):
        if differ is not None:
            inside = differ.select("node").withColumnRenamed("node", "up")
            x, y = (t.withColumn("up", F.floor(F.col("node") / FAN).cast("bigint")).join(inside, "up", "left_semi").drop("up") for t in (x, y))
        x, y = (t.select("node", *[F.col(c).alias(f"{c}_{side}") for c in t.columns if c != "node"]) for t, side in ((x, "a"), (y, "b")))
        above, differ = differ, keep(x.join(y, "node", "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))), "differ")
        if above is not None:
            forget(above)
    for t in ta + tb:
        forget(t)
    status = F.when(F.col("hash_a").isNull(), "surplus").when(F.col("hash_b").isNull(), "missing").when(F.col("content_a") == F.col("content_b"), "moved").otherwise("damaged")
    return differ.select(F.col("node").alias("number"), status.alias("status"))


def parse(data: bytes):
    """(offset, headers, payload) of every record in the bytes of a WARC file; gzip members are unpacked first."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at offset {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        n = int(headers["Content-Length"])
        body = data[end + 4 : end + 4 + n]
        if len(body) < n:
            raise ValueError(f"the record at offset {at} is cut short")
        yield at, headers, body
        at = end + 4 + n + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, uri, payload) of the records of WARC files (plain or gzip), one file per row of the source at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(parse(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].get("WARC-Target-URI") for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())],
                    ["file", "offset", "uri", "payload"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, offset bigint, uri string, payload binary")
