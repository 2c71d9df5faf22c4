import gzip

import duckdb

from seriesloom.llm import fixity as X
from seriesloom.llm import registry

PAGES = [(i, f"http://h/{i}", f"<p>é{i}</p>" * (i % 5), 1) for i in range(300)] + [(7, "u", "twice", 1), (None, None, None, 1), (5000, "far", "x", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, number int")


def test_records_round_trip(spark):
    rows = X.records(frame(spark, PAGES)).collect()
    data = b"".join(r.record.encode() for r in rows)
    back = list(X.parse(data))
    assert [b[2].decode() for b in back] == [p[2] or "" for p in PAGES]
    assert [b[1]["WARC-Target-URI"] for b in back] == [p[1] or "" for p in PAGES]
    assert list(X.parse(gzip.compress(data))) == back


def test_read_warc(spark, tmp_path):
    rows = X.records(frame(spark, PAGES[:5])).collect()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(r.record.encode() for r in rows)))
    got = X.read_warc(spark, str(tmp_path)).collect()
    assert [bytes(r.payload).decode() for r in got] == [p[2] for p in PAGES[:5]]


def test_audit_finds_what_differs(spark):
    a = X.place(X.records(frame(spark, PAGES)))
    assert X.audit(a, a).count() == 0
    harmed = [p for p in PAGES if p[0] not in (3, 5000)] + [(901, "u", "new", 1), (-9, "u", "new", 1)]
    harmed = [(p[0], p[1], "!" if p[0] in (100, 299) else p[2], 1) for p in harmed]
    harmed.remove((7, "u", "twice", 1))
    got = {(r.number, r.status) for r in X.audit(a, X.place(X.records(frame(spark, harmed)))).collect()}
    told = {(3, "missing"), (5000, "missing"), (100, "damaged"), (299, "damaged"), (7, "damaged"), (901, "surplus"), (-9, "surplus")}
    # file 0 is shorter from record 3 on; what follows has moved.  File -1 holds -9 before the record without a number.
    assert got == told | {(n, "moved") for n in range(4, 299) if n not in (7, 100)} | {(-1, "moved")}
    assert {r.status for r in X.audit(a, a.limit(0)).collect()} == {"missing"}
    assert X.audit(a.limit(0), a.limit(0)).count() == 0


def test_other_offsets_or_files_are_not_sound(spark):
    a = X.place(X.records(frame(spark, PAGES)))
    shifted = a.withColumn("offset", X.F.col("offset") + (X.F.col("number") == 250).cast("bigint"))
    assert [tuple(r) for r in X.audit(a, shifted).collect()] == [(250, "moved")]
    elsewhere = a.withColumn("file", X.F.when(X.F.col("number") == 5000, 9).otherwise(X.F.col("file")))
    assert [tuple(r) for r in X.audit(a, elsewhere).collect()] == [(5000, "moved")]


def test_long_records_and_clashing_names(spark):
    rows = [(1, "u", "x" * 3_000_000, "a"), (2, "u", "y" * 10, "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    a = X.place(X.records(pages))
    assert {r.number: r.length > 3_000_000 for r in a.collect()} == {1: True, 2: False}
    b = X.place(X.records(pages.withColumn("html", X.F.regexp_replace("html", "x$", "z"))))
    assert [tuple(r) for r in X.audit(a, b).collect()] == [(1, "damaged")]


def test_offsets_are_where_the_records_lie(spark):
    recs = X.records(frame(spark, PAGES))
    text = {}
    for r in recs.collect():
        text.setdefault(r.number, []).append(r.record.encode())
    for p in X.place(recs).collect():
        before = sum(len(x) for n, xs in text.items() if n // X.FILE_RECORDS == p.file and n < p.number for x in xs)
        assert before <= p.offset < before + sum(map(len, text[p.number])) and p.length in map(len, text[p.number])


def test_query_equals_sql(spark, tmp_path):
    frame(spark, PAGES[:300]).write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.op6_fixity(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.OP6_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
