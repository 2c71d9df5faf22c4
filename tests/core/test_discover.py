import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import annotation, sliding
from seriesloom.operators import discover, mass, mpdist, nearest
from seriesloom.sources.tables import from_values


def col(df, name="dist"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r.idx)]


TS20 = [1, 2, 3, 1, 2, 3, 4, 5, 6, 0, 0, 1, 1, 2, 2, 4, 5, 1, 1, 9]
Q8 = [0, 1, 2, 3, 0, 2, 1, 4]


def test_mass(spark):
    got = col(mass.profile(from_values(spark, {"a": [1, 1, 1, 2, 1, 1, 4, 5]}), [2, 1, 1, 4]))
    assert np.allclose(got, [0.67640791, 3.43092352, 3.43092352, 0, 1.85113597], atol=1e-6)
    got = col(mass.profile(from_values(spark, {"a": [1, 1, 1, 1, 2, 1]}), [2, 1, 1, 4]))
    assert abs(got[0] - 2.0) < 1e-12


def test_sliding_dot(spark):
    rng = np.random.default_rng(0)
    x = rng.random(13).tolist()
    got = col(mass.sliding_dot(from_values(spark, {"a": x}), [1, 2, 3, 4]), "dot")
    assert np.allclose(got, np.correlate(x, [1, 2, 3, 4], "valid"))


def test_statistics(spark):
    x = [1, 3, 2, 4, 5, 1, 1, 1, 2, 4, 9, 7]
    for block in (65536, 5):
        whole, moving = sliding.statistics(from_values(spark, {"a": x}), 4) if block == 65536 else (None, sliding.over(from_values(spark, {"a": x}), 4, {"moving_avg": lambda f: F.avg("value").over(f)}, 5))
        win = np.lib.stride_tricks.sliding_window_view(np.array(x, float), 4)
        assert np.allclose(col(moving, "moving_avg"), win.mean(axis=1))
        if whole is not None:
            w = whole.first()
            assert (w.ts_min, w.ts_max, w.ts_median, w.n) == (1, 9, 2.5, 12) and abs(w.ts_std - np.std(x)) < 1e-12
            for name, fn in (("moving_std", np.std), ("moving_min", np.min), ("moving_max", np.max), ("moving_median", np.median)):
                assert np.allclose(col(moving, name), fn(win, axis=1))
    flat = sliding.moving(from_values(spark, {"a": [10.1] * 7}), 3).collect()
    assert all(r.moving_std == 0 and r.inverse_norm == 0 for r in flat)
    with pytest.raises(ValueError):
        sliding.statistics(from_values(spark, {"a": x}), 2)


def test_skip_and_clean(spark):
    s = from_values(spark, {"a": [1, float("inf"), float("nan"), 4, 5, 6, 7, 8]})
    assert col(sliding.skip_locations(s, 4), "skip") == [True, True, True, False, False]
    assert col(sliding.clean(s), "value") == [1, 0, 0, 4, 5, 6, 7, 8]


def test_annotation(spark):
    x = [1.0, 2.0, 4.0, 4.0, 1.0, 0.0, 4.0]
    s = from_values(spark, {"a": x})
    win = np.lib.stride_tricks.sliding_window_view(np.array(x), 3)
    ce = np.sqrt((np.diff(win, axis=1) ** 2).sum(axis=1))
    assert np.allclose(col(annotation.make(s, 3, "complexity"), "av"), (ce - ce.min()) / ce.max())
    sd = win.std(axis=1)
    assert col(annotation.make(s, 3, "meanstd"), "av") == (sd < sd.mean()).astype(float).tolist()
    clip = np.isin(win, [0.0, 4.0]).sum(axis=1).astype(float)
    clip -= clip.min()
    assert np.allclose(col(annotation.make(s, 3, "clipping"), "av"), 1 - clip / clip.max())
    p = s.filter("idx < 5").select("series_id", F.lit(3).alias("w"), "idx", F.lit(3.0).alias("mp"))
    assert col(annotation.apply(p, annotation.make(s, 3, "default")), "cmp") == [3.0] * 5
    assert col(annotation.apply(p, annotation.make(s, 3, "default").withColumn("av", F.lit(0.0))), "cmp") == [6.0] * 5
    with pytest.raises(ValueError):
        annotation.make(s, 3, "none")
    with pytest.raises(Exception, match="between 0 and 1"):
        annotation.apply(p, annotation.make(s, 3, "default").withColumn("av", F.lit(1.5))).collect()


def frame(spark, mp, w=4):
    return spark.createDataFrame([("a", w, i, float(v), 0) for i, v in enumerate(mp)], "series_id string, w int, idx long, mp double, pi long")


def test_discords(spark):
    pick = lambda mp, **k: [r.idx for r in sorted(discover.discords(frame(spark, mp), **k).collect(), key=lambda r: r.rank)]
    assert pick([1] * 10, zone=2) == [9, 6, 3]
    assert pick([1, 2, 3, 4], zone=0) == [3, 2, 1]
    assert pick([1, 2, 3, 4], zone=1) == [3, 1]
    assert pick([math.inf, 2, math.nan, 1], zone=0) == [1, 3]


def test_motifs(spark):
    s = from_values(spark, {"a": [0, 1, 1, 1, 0, 0, 2, 1, 0, 0, 2, 1] * 4})
    p = nearest.self_join(s, 4)
    got = discover.motifs(s, p, k=2, zone=1).collect()
    first = {r.role: r.idx for r in got if r.rank == 1}
    assert first["first"] < first["second"]
    near = [r.idx for r in got if r.rank == 1]
    assert all(abs(a - b) > 1 for i, a in enumerate(near) for b in near[:i])
    assert discover.motifs(s, p.withColumn("mp", F.lit(float("inf")))).count() == 0


def test_arc_curve(spark):
    rng = np.random.default_rng(4)
    n, w = 60, 5
    pi = rng.integers(0, n, n)
    p = spark.createDataFrame([("a", w, i, 1.0, int(j)) for i, j in enumerate(pi)], "series_id string, w int, idx long, mp double, pi long")
    cross = np.zeros(n)
    for i, j in enumerate(pi):
        lo, hi = min(i, j), max(i, j)
        cross[lo + 1 : hi] += 1
    # an arc onto itself counts nowhere; its marks leave the places after it one too many in both directions
    got = col(discover.arc_curve(p), "cac")
    assert got[:w] == [1.0] * w and got[-w:] == [1.0] * w and all(0 <= x <= 1 for x in got)
    ideal = n / 2 - (np.arange(n) - n / 2) ** 2 / (n / 2)
    no_self = all(i != j for i, j in enumerate(pi))
    if no_self:
        assert np.allclose(got[w:-w], np.minimum(1, cross / ideal)[w:-w])
    assert discover.regimes(p, 2).count() <= 2


def test_distance_of_series(spark):
    a, b = from_values(spark, {"s": TS20}), from_values(spark, {"s": Q8})
    got = mpdist.distance(a, b, 4).first().dist
    one = mpdist._pair(np.array(TS20, float), np.array(Q8, float), 4, 0.05)
    assert abs(got - one) < 1e-9
    for t in (1, 0.0, 1.0, "x"):
        with pytest.raises(ValueError):
            mpdist.distance(a, b, 4, t)


def test_pairwise(spark):
    s = from_values(spark, {"0": list(range(100)), "1": list(range(100)), "2": [1] * 100, "3": [0] * 100, "4": [1, 2]})
    got = {(r.id_a, r.id_b): r.dist for r in mpdist.pairwise(s, 8).collect()}
    assert len(got) == 10 and abs(got["0", "1"]) < 1e-6
    assert all(abs(got[k] - 4) < 1e-9 for k in [("0", "2"), ("0", "3"), ("1", "2"), ("1", "3"), ("2", "3")])
    assert got["0", "4"] == math.inf


def test_vector_paths_agree(spark):
    rng = np.random.default_rng(5)
    ts, q = rng.random(40), rng.random(9)
    want = mpdist._vector(ts, q, 4)
    got = col(mpdist.vector(from_values(spark, {"s": ts.tolist()}), from_values(spark, {"s": q.tolist()}), 4))
    assert np.allclose(got, want, atol=1e-8)


def test_snippets_and_regimes_of_a_known_mixture(spark):
    """Three regimes of different shape: a snippet from the two longest, regime changes where they meet."""
    rng = np.random.default_rng(6)
    t = np.arange(256)
    x = np.concatenate([np.sin(t / 3), np.sign(np.sin(t / 7)) + 0.2 * np.sin(t), (t % 40) / 40.0]) + 0.02 * rng.standard_normal(768)
    s = from_values(spark, {"a": x.tolist()})
    got = sorted(mpdist.snippets(s, 64, 3, 32).collect(), key=lambda r: r.rank)
    assert sorted(r.idx // 256 for r in got) == [0, 1, 2]
    assert all(0 < r.fraction <= 1 and len(r.snippet) == 64 for r in got)
    cuts = sorted(r.idx for r in discover.regimes(nearest.self_join(s, 32), 2).collect())
    assert abs(cuts[0] - 256) < 64 and abs(cuts[1] - 512) < 64
    with pytest.raises(ValueError):
        mpdist.snippets(s, 3)
    with pytest.raises(ValueError):
        mpdist.snippets(s, 500)
    with pytest.raises(ValueError):
        mpdist.snippets(s, 64, 2, 64)
