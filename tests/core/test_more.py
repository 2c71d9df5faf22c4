import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.errors import NoSolutionPossible
from seriesloom.functions import annotation, registered
from seriesloom.operators import cluster, discover, impute, mpdist, multidim, nearest, pan
from seriesloom.plans import compute as routers
from seriesloom.plans import frames
from seriesloom.sources import files, stored
from seriesloom.sources import tables as T
from seriesloom.streaming import rolling

RNG = np.random.default_rng(11)


def rows(df, *key):
    return sorted(df.collect(), key=lambda r: tuple(r[k] for k in key))


@pytest.mark.parametrize("block", [1024, 7])
def test_multidim_equals_brute_force(spark, block):
    x = RNG.integers(0, 5, (3, 30)).astype(float)
    x[1, 5:12] = 2.0
    w, zone = 4, 2
    df = spark.createDataFrame([("a", d, i, float(v)) for d in range(3) for i, v in enumerate(x[d])], "series_id string, dim int, idx long, value double")
    got = {(r.k, r.idx): r for r in multidim.self_join(df, w, block).collect()}
    z = [nearest.normalise(x[d], w)[0] for d in range(3)]
    for i in range(27):
        best = {k: (math.inf, -1) for k in (1, 2, 3)}
        for j in range(27):
            if abs(i - j) <= zone:
                continue
            d = sorted(math.inf if not z[m][i].any() or not z[m][j].any() else math.sqrt(max(0, 2 * w * (1 - min(1, round(float(z[m][i] @ z[m][j]), 10))))) for m in range(3))
            for k in best:
                best[k] = min(best[k], (round(sum(d[:k]) / k, 9), j))
        for k, (m, j) in best.items():
            r = got[k, i]
            assert (r.pi, abs(r.mp - m) < 1e-6 or r.mp == m) == (j if math.isfinite(m) else -1, True)
            assert r.dims is None or len(r.dims) == k


def test_breadth_first():
    assert pan.breadth_first(10) == [0, 5, 2, 7, 1, 3, 6, 8, 4, 9]
    assert pan.breadth_first(1) == [0] and sorted(pan.breadth_first(33)) == list(range(33))


def test_pan_profile(spark):
    s = T.from_values(spark, {"a": RNG.random(80).tolist()})
    whole = pan.pan_profile(s, [8, 10, 12])
    for w in (8, 10, 12):
        assert rows(pan.pick(whole, w), "idx") == rows(nearest.self_join(s, w), "idx")
    assert {r.w for r in pan.pan_profile(s, [8, 10, 12], 0.34).collect()} == {8}
    more = pan.pan_profile(s, [8, 10], known=pan.pick(whole, 8))
    assert rows(more, "w", "idx") == rows(whole.filter("w < 12"), "w", "idx")
    with pytest.raises(ValueError):
        pan.pick(whole, 9)
    with pytest.raises(ValueError):
        pan.pan_profile(s, [8], 1.5)


@pytest.mark.parametrize("length,want", [(32, 36), (64, 68)])
def test_maximum_subsequence(spark, length, want):
    x = np.random.RandomState(9999).uniform(size=1024)
    x[length + 100 : 2 * length + 100] = x[:length]
    s = T.from_values(spark, {"a": x.tolist()})
    assert pan.maximum_subsequence(s, 0.98) == want
    with pytest.raises(NoSolutionPossible):
        pan.maximum_subsequence(s, 1.0)


def test_impute(spark):
    nan, inf = math.nan, math.inf
    x = [nan, 1, 2, 3, inf, nan, 6, 7, 8, None, 10, 11, nan, nan, 14, 15, inf]
    s = T.from_values(spark, {"a": x, "b": [1.0, 2.0]})
    for method, direction in itertools.product(impute.METHODS, ("forward", "b")):
        got = [r.value for r in rows(impute.impute(s, 4, method, direction), "series_id", "idx")]
        assert all(v is not None and math.isfinite(v) for v in got)
        assert got[1:4] == [1, 2, 3] and got[-2:] == [1, 2]
    assert impute.fill(np.array([1, nan, 3.0, 4]), 3, "mean", True).tolist() == [1, 2, 3, 4]
    for bad in ({"method": "x"}, {"direction": "up"}, {"window": 0}):
        with pytest.raises(ValueError):
            impute.impute(s, **{"window": 4, **bad})
    for bad in ({"nope": 1}, {"window": "a"}, {"add_noise": 1}):
        with pytest.raises(ValueError):
            impute.options(bad)
    flat = T.from_values(spark, {"a": [5.0] * 6 + [1.0, 2.0, 3.0]})
    noisy = [r.value for r in rows(impute.add_noise(flat, 4, 1), "idx")]
    assert len(set(noisy[:6])) == 6 and all(0 <= v - 5 < 1e-6 for v in noisy[:6]) and noisy[6:] == [1, 2, 3]


def test_clustering(spark):
    d = np.array([[0, 1, 5, 9], [1, 0, 4, 8], [5, 4, 0, 3], [9, 8, 3, 0.0]])
    z = cluster.linkage(d, "single")
    assert z.tolist() == [[0, 1, 1, 2], [2, 3, 3, 2], [4, 5, 4, 4]]
    assert cluster.linkage(d, "complete")[-1, 2] == 9 and cluster.linkage(d, "average")[-1, 2] == 6.5
    r = cluster.inconsistent(z, 2)
    assert r[2, 2] == 3 and abs(r[2, 0] - 8 / 3) < 1e-12
    assert cluster.assign(z, r, 3.5, "distance").tolist() == [1, 1, 2, 2]
    assert cluster.assign(z, r, 2, "maxclust").tolist() == [1, 1, 2, 2]
    assert cluster.assign(z, r, 1, "maxclust").tolist() == [1, 1, 1, 1]
    heights, corr = cluster.cophenet(z, d)
    at = np.triu_indices(4, 1)
    assert heights[0, 3] == 4 and abs(corr - np.corrcoef(d[at], heights[at])[0, 1]) < 1e-12
    a, b, c = (RNG.random(64).tolist() for _ in range(3))
    s = T.from_values(spark, {"1": a, "2": a, "3": b, "4": b, "5": c})
    tree, out = cluster.hierarchical(s, 16, 2)
    assert [r.cluster for r in rows(out, "series_id")] == [1, 1, 2, 2, 3]
    assert 0.9 < tree.correlation <= 1
    for bad in ({"method": "x"}, {"criterion": "x"}, {"t": "x"}, {"depth": 0}, {"threshold": 1}):
        with pytest.raises(ValueError):
            cluster.hierarchical(s, 16, **{"t": 2, **bad})


def test_files(spark, tmp_path):
    (tmp_path / "One.txt").write_text("1.5\n2\nnan\n4\n")
    with gzip.open(tmp_path / "two.txt.gz", "wt") as f:
        f.write("7\n8\n")
    (tmp_path / "three.csv").write_text("date,x,y\n2020-01-02,2,20\n2020-01-01,1,10\n")
    (tmp_path / "listing.json").write_text('[{"name": "One", "category": "Real"}, {"name": "two", "category": "other"}]')
    assert [r.value for r in rows(files.read_text(spark, str(tmp_path / "One.txt")), "idx")][:2] == [1.5, 2.0]
    assert [r.value for r in rows(files.load(spark, str(tmp_path), "TWO"), "idx")] == [7, 8]
    assert [(r.series_id, r.value) for r in rows(files.load(spark, str(tmp_path), "three"), "series_id", "idx")] == [("x", 1), ("x", 2), ("y", 10), ("y", 20)]
    assert files.listing(spark, str(tmp_path / "listing.json"), "real").count() == 1
    with pytest.raises(ValueError):
        files.listing(spark, str(tmp_path / "listing.json"), "none")
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path), "none")
    with pytest.raises(RuntimeError):
        files.format_of("x.doc")
    p = nearest.exact_rows(T.from_values(spark, {"a": RNG.random(40).tolist() + [None, 1.0]}), 5)
    for kind in files.FORMATS:
        path = files.write(p, str(tmp_path / kind), kind)
        back = files.read(spark, path, schema=p.schema if kind == "json" else None).select(p.columns)
        assert rows(back, "idx") == rows(p, "idx")
    with pytest.raises(ValueError):
        files.write(p, str(tmp_path / "z"), "doc")


def test_routers(spark):
    s = T.from_values(spark, {"a": (np.sin(np.arange(120) / 5) + 0.1 * RNG.random(120)).tolist()})
    assert (routers.compute(s, 16).algorithm, routers.compute(s, [16]).kind, routers.compute(s, 16, sample_pct=0.5).algorithm) == ("exact", "profile", "sampled")
    assert routers.compute(s, [8, 16]).kind == "pan"
    auto = routers.compute(s, threshold=0.9)
    assert auto.windows[0] == 8 and auto.kind == "pan"
    made = routers.analyze(s, 16, preprocessing={"window": 4})
    assert {"motifs", "discords", "lines", "discord_windows", "motif_windows"} <= set(made.tables)
    assert made.tables["lines"].count() == 120 and made.tables["discord_windows"].groupBy("rank").count().first()["count"] == 16
    assert "heat" in routers.analyze(s, [8, 16]).tables
    for bad in (0, 3, [4, 0], [4, 3]):
        with pytest.raises(ValueError):
            routers.compute(s, bad)
    with pytest.raises(ValueError):
        routers.compute(s, None, threshold=None)
    with pytest.raises(RuntimeError):
        routers.analyze(s, 16, sample_pct=0.0)
    snip = spark.createDataFrame([("a", 1, [1, 2, 3, 7, 8])], "series_id string, rank int, neighbors array<long>")
    assert [(r.start, r.stop) for r in rows(frames.intervals(snip), "start")] == [(1, 3), (7, 8)]


def test_streaming(spark, tmp_path):
    src, store, seen = tmp_path / "in", str(tmp_path / "store"), []
    schema = "ts timestamp, value double"
    hours = spark.range(60).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.sin(F.col("id") / 3.0).alias("value"))
    hours.write.parquet(str(src))
    sums = rolling.tumbling(spark.readStream.schema(schema).parquet(str(src)), "ts", "value")
    batch = rolling.keep_profile(sums, 8, lambda p, i: seen.append((i, p.count())))(store)
    q = sums.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen and seen[-1][1] > 40


def test_dense_and_pack(spark):
    rows_ = [(0, 1.0), (3, 4.0)]
    df = spark.createDataFrame([("a", *r) for r in rows_], "k string, h long, v double").select("k", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "v")
    s = T.by_time(df, "hour", "ts", F.col("v"), F.col("k"))
    assert [(r.idx, r.value) for r in rows(T.dense(s, "hour"), "idx")] == [(0, 1.0), (1, None), (2, None), (3, 4.0)]
    packed = T.pack(T.dense(s, "hour"))
    assert packed.first()["values"] == [1.0, None, None, 4.0]
    assert T.unpack(packed).count() == 4


def test_stored_results(spark, tmp_path):
    x = (np.sin(np.arange(90) / 5) + 0.1 * RNG.random(90)).tolist()
    s = T.from_values(spark, {"a": x, "b": x[::-1]})
    made = routers.analyze(s, 16)
    p = nearest.exact_rows(s, 16)
    made.profile = p
    made.tables["cmp"] = annotation.apply(p, annotation.make(s, 16, "clipping"))
    pans = routers.analyze(s, [8, 16])
    for rows_, q in ((stored.gather(made, ez=4, av_type="clipping"), 1), (stored.gather(pans), 2), (stored.gather(routers.compute(s, 16, query=s), query=s), 3)):
        rows_ = rows_.checkpoint()
        want = rows(rows_, "series_id")
        assert want[0].ts == x and len(want) == 2
        for kind in stored.FORMATS:
            back = stored.read(spark, stored.write(rows_, str(tmp_path / f"{kind}{q}"), kind), kind)
            for a, b in zip(rows(back, "series_id"), want):
                assert {k: v for k, v in a.asDict(True).items() if v} == {k: v for k, v in b.asDict(True).items() if v}
    one = rows(stored.gather(made, ez=4, av_type="clipping"), "series_id")[0]
    assert one.lmp and one.rpi and one.motifs[0].motifs and one.discords[0].row >= 0 and one.cmp and one.windows == [16]
    two = rows(stored.gather(pans), "series_id")[0]
    assert len(two.pmp) == 2 and len(two.pmp[0]) == len(two.pmp[1]) == 83 and two.pmp[1][-1] is None
    stored.export(stored.gather(made), str(tmp_path / "files"))
    got = rows(stored.load(spark, str(tmp_path / "files")), "series_id")
    assert [r.series_id for r in got] == ["a", "b"] and got[0].mp == one.mp
    with pytest.raises(ValueError):
        stored.decode_message(b"\x0b")


def test_message_layout():
    """Bytes by hand: class, windows, a plain array, a location."""
    row = dict.fromkeys(stored._names()) | {"klass": "PMP", "windows": [8, 300], "ts": [1.0], "pi": [-1, 3], "discords": [{"row": 2, "col": 0}]}
    assert stored.encode_message(row) == (
        b"\x0a\x03PMP" + b"\x2a\x03\x08\xac\x02" + b"\x32\x0c\x08\x01\x1a\x08" + np.array([1.0]).tobytes()
        + b"\x42\x11\x12\x0f\x08\x02\x1a\x0b" + b"\xff" * 9 + b"\x01\x03" + b"\x5a\x02\x08\x02"
    )
    back = stored.decode_message(stored.encode_message(row))
    assert back["pi"] == [-1, 3] and back["discords"] == [{"row": 2, "col": 0}] and back["windows"] == [8, 300] and back["mp"] is None


def test_registered_functions(spark):
    registered.register(spark)
    ts, q = [1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 4.0, 5.0], [2.0, 1.0, 1.0, 4.0]
    df = spark.createDataFrame([(ts, q)], "ts array<double>, q array<double>")
    got = df.selectExpr("mass(q, ts) AS m", "znorm_dist(q, slice(ts, 4, 4)) AS d", "znorm_dist(array(1D, 1D), array(2D, 2D)) AS flat", "mpdist(ts, q, 4, 0.05D) AS p").first()
    assert np.allclose(got.m, [0.67640791, 3.43092352, 3.43092352, 0, 1.85113597], atol=1e-6)
    assert abs(got.d) < 1e-6 and got.flat == 0 and got.p >= 0


def test_plot_tables(spark):
    s = T.from_values(spark, {"a": (np.sin(np.arange(120) / 5) + 0.1 * RNG.random(120)).tolist()})
    made = routers.analyze(s, 16)
    made.tables["cmp"] = annotation.apply(made.profile, annotation.make(s, 16, "meanstd"))
    made.tables["snippets"] = mpdist.snippets(s, 24)
    made.tables["regimes"] = discover.regimes(made.profile, 1)
    out = frames.plot(made)
    assert {"lines", "corrected", "discord_windows", "motif_windows", "snippet_lines", "snippet_intervals", "regime_marks"} == set(out)
    assert out["corrected"].groupBy("line").count().count() == 3 and out["snippet_lines"].filter("rank = 1").count() == 24
    st = routers.Result("statistics", "none", [16], None, s)
    assert frames.plot(st)["statistics"].count() == 120
    both = frames.combine({"lines": out["lines"]}, {"lines": out["lines"], "other": out["corrected"]})
    assert both["lines"].count() == 240 and "other" in both
    assert not frames.is_visualizable(object())
    with pytest.raises(ValueError):
        frames.plot(object())


def test_kinds_of_profiles(spark):
    s = T.from_values(spark, {"a": RNG.random(40).tolist()})
    assert nearest.is_correlation(nearest.self_join(s, 8, correlation=True)) and not nearest.is_correlation(nearest.self_join(s, 8))
    assert {(r.mp, r.pi) for r in nearest.empty(s, 8).collect()} == {(math.inf, -1)} and nearest.empty(s, 8).count() == 33
    for bad in (s.drop("idx"), s.withColumn("value", F.lit("x"))):
        with pytest.raises(ValueError):
            nearest.self_join(bad, 8)


def test_known_distances(spark):
    a = [1, 2, 3, 1, 2, 3, 4, 5, 6, 0, 0, 1, 1, 2, 2, 4, 5, 1, 1, 9]
    q = [0.23595094, 0.9865171, 0.1934413, 0.60880883, 0.55174926, 0.77139988, 0.33529215, 0.63215848]
    got = mpdist.distance(T.from_values(spark, {"a": a}), T.from_values(spark, {"a": q}), 4).first().dist
    assert abs(got - 0.437690617625298) < 1e-5
    line = np.arange(100.0).tolist()
    s = T.from_values(spark, {"1": line, "2": line, "3": [1.0] * 100, "4": [0.0] * 100})
    assert [round(r.dist, 6) for r in rows(mpdist.pairwise(s, 8), "id_a", "id_b")] == [0, 4, 4, 4, 4, 4]


def test_known_clusters(spark):
    rng = np.random.RandomState(9999)
    a, b, c = (rng.uniform(size=1024).tolist() for _ in range(3))
    tree, out = cluster.hierarchical(T.from_values(spark, {"1": a, "2": a, "3": b, "4": b, "5": c}), 64, 2)
    assert [r.cluster for r in rows(out, "series_id")] == [1, 1, 2, 2, 3]
    assert abs(tree.correlation - 0.9999870997174531) < 1e-6
    made = cluster.tables(spark, tree)
    assert made["merges"].count() == 4 and made["cophenetic"].filter("height = 0").count() == 2
    dist = [0, 8.2299501, 8.2299501, 8.29915377, 8.2299501, 8.2299501, 8.29915377, 0, 8.2558308, 8.2558308]
    assert np.allclose([r.dist for r in rows(mpdist.pairwise(T.from_values(spark, {"1": a, "2": a, "3": b, "4": b, "5": c}), 64), "id_a", "id_b")], dist, atol=1e-6)


def test_linkage_equals_plain_search():
    """The chain against searching all pairs for every merge."""
    rng = np.random.default_rng(2)
    for m in (2, 5, 12):
        d = rng.random((m, m))
        d = np.round(d + d.T, 6)
        np.fill_diagonal(d, 0)
        for method in cluster.METHODS:
            groups = {i: ([i], 1) for i in range(m)}
            dist = {(i, j): d[i, j] for i in range(m) for j in range(i)}
            want = []
            for step in range(m - 1):
                (x, y), h = min(dist.items(), key=lambda kv: kv[1])
                want.append((min(x, y), max(x, y), h, groups[x][1] + groups[y][1]))
                get = lambda p, q: dist[max(p, q), min(p, q)]
                new = m + step
                for k in groups:
                    if k not in (x, y):
                        p, q = get(x, k), get(y, k)
                        nx, ny = groups[x][1], groups[y][1]
                        dist[new, k] = {"single": min(p, q), "complete": max(p, q), "average": (nx * p + ny * q) / (nx + ny), "weighted": (p + q) / 2}[method]
                groups[new] = ([], groups[x][1] + groups[y][1])
                del groups[x], groups[y]
                dist = {k: v for k, v in dist.items() if not {x, y} & set(k)}
            assert np.allclose(cluster.linkage(d, method), want)
    z = cluster.linkage(d, "single")
    assert cluster.assign(z, cluster.inconsistent(z, 2), 0.5, "monocrit", z[:, 2]).tolist() == cluster.assign(z, cluster.inconsistent(z, 2), 0.5, "distance").tolist()
    with pytest.raises(ValueError):
        cluster.assign(z, cluster.inconsistent(z, 2), 0.5, "monocrit")


def test_rolling_keeps_the_newest_sums_of_the_horizon(spark, tmp_path):
    seen, store = {}, str(tmp_path / "store")
    batch = rolling.keep_profile(None, 4, lambda p, i: seen.update({i: rows(p, "idx")}), horizon=20)(store)
    frame = lambda hours, f: spark.createDataFrame([("a", h, float(f(h))) for h in hours], "series_id string, h long, value double").select("series_id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "value")
    wave = lambda h: math.sin(h / 2)
    batch(frame(range(15), lambda h: 100.0), 0)
    batch(frame(range(15), wave), 1)  # lower than before, and newer
    for i in range(2, 7):
        batch(frame(range(5 * i + 5, 5 * i + 10), wave), i)
    batch(frame(range(35, 40), wave), 6)  # once more
    want = rows(nearest.self_join(T.from_values(spark, {"a": [wave(h) for h in range(20, 40)]}), 4), "idx")
    assert [(r.idx, round(r.mp, 6), r.pi) for r in seen[6]] == [(r.idx, round(r.mp, 6), r.pi) for r in want]
    assert len(list((tmp_path / "store").glob("batch=*"))) <= 4
