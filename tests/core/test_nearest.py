import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import mass
from seriesloom.operators import nearest as N
from seriesloom.sources.tables import from_values


def brute(a, b, w, zone, tie):
    same = b is None
    b = a if same else b
    za, zb = N.normalise(np.array(a, float), w)[0], N.normalise(np.array(b, float), w)[0]
    r = np.minimum(np.round(za @ zb.T, 10), 1)
    out = []
    for i in range(len(za)):
        cand = [(-r[i, j], j if tie == "first" else ((abs(i - j), j) if same else (j > i, abs(i - j))), j) for j in range(len(zb)) if not same or abs(i - j) > zone]
        out.append((min(cand)[2], -min(cand)[0]) if cand else (-1, -1.0))
    return out


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.series_id, r.w, r.idx))


SMALL = [0, 1, 1, 1, 0, 0, 2, 1, 0, 0, 2, 1]


def test_small_self_join(spark):
    got = rows(N.self_join(from_values(spark, {"a": SMALL}), 4))
    assert [round(r.mp, 4) for r in got] == [1.9550, 1.9550, 0.8739, 0, 0, 1.9550, 0.8739, 0, 0]
    assert [r.pi for r in got] == [4, 5, 6, 7, 8, 1, 2, 3, 4]
    got = rows(N.self_join(from_values(spark, {"a": SMALL}), 4, correlation=True))
    assert [round(r.mp, 5) for r in got] == [0.52223, 0.52223, 0.90453, 1, 1, 0.52223, 0.90453, 1, 1]


def test_small_left_right(spark):
    got = rows(N.exact_rows(from_values(spark, {"a": [0, 1, 1, 0] * 3}), 4))
    assert all(abs(r.mp) < 1e-4 for r in got)
    assert [r.lpi for r in got][:4] == [-1, -1, -1, 0] or got[4].lpi == 0
    assert got[0].rpi == 4 and got[8].lpi in (0, 4)


@pytest.mark.parametrize("block", [None, 16, 33])
@pytest.mark.parametrize("tie", ["nearest", "first"])
def test_self_join_equals_brute_force(spark, block, tie):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, 120).astype(float).tolist()
    a[40:60] = [2.0] * 20
    b = rng.random(90).tolist()
    got = rows(N.self_join(from_values(spark, {"a": a, "b": b}), [8, 12], tie=tie, block=block))
    for sid, x in (("a", a), ("b", b)):
        for w in (8, 12):
            mine = [r for r in got if r.series_id == sid and r.w == w]
            want = brute(x, None, w, N.zone_quarter(w), tie)
            assert [r.pi for r in mine] == [p for p, _ in want]
            assert np.allclose([r.mp for r in mine], [np.sqrt(2 * w * (1 - c)) for _, c in want], atol=1e-4)


@pytest.mark.parametrize("block", [None, 10])
def test_ab_join_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, 60).astype(float).tolist(), rng.integers(0, 3, 25).astype(float).tolist()
    x, y = from_values(spark, {"s": a}), from_values(spark, {"s": b})
    for tie in ("nearest", "first"):
        assert [r.pi for r in rows(N.ab_join(x, y, 6, tie=tie, block=block))] == [p for p, _ in brute(a, b, 6, 0, tie)]
        assert [r.pi for r in rows(N.ab_join(x, y, 6, tie=tie, block=block, reverse=True))] == [p for p, _ in brute(b, a, 6, 0, tie)]


def test_missing_values_and_short_series(spark):
    a = SMALL + [None] + SMALL + [float("inf"), 1.0]
    got = rows(N.self_join(from_values(spark, {"a": a, "b": [1, 2, 3], "c": [1, 2, 3, 4, 5]}), 4))
    bad = [r.idx for r in got if r.mp is None]
    assert bad == [9, 10, 11, 12, 22, 23] and all(r.pi == -1 for r in got if r.mp is None)
    assert not [r for r in got if r.series_id == "b"]
    assert [(r.pi, round(r.mp, 6)) for r in got if r.series_id == "c"] == [(-1, 4.0), (-1, 4.0)]


def test_approximations(spark):
    rng = np.random.default_rng(3)
    s = from_values(spark, {"a": rng.random(200).tolist()})
    exact = [r.mp for r in rows(N.self_join(s, 16))]
    assert [r.mp for r in rows(N.sampled(s, 16, 1.0))] == exact
    part = rows(N.sampled(s, 16, 0.3, seed=5))
    assert all(a.mp >= e - 1e-9 for a, e in zip(part, exact)) and part == rows(N.sampled(s, 16, 0.3, seed=5, block=32))
    pre = rows(N.stepped(s, 16))
    assert all(a.mp >= e - 1e-6 for a, e in zip(pre, exact))
    assert all(abs(a.mp - e) < 1e-6 for a, e in zip(pre[::4], exact[::4]))


def test_arguments(spark):
    s = from_values(spark, {"a": SMALL})
    for w in (0, 3, 4.0, True):
        with pytest.raises(ValueError):
            N.self_join(s, w)
    for pct in (1, -0.1, 2.0):
        with pytest.raises(ValueError):
            N.sampled(s, 4, pct)
    with pytest.raises(ValueError):
        from_values(spark, {"a": "text"})


def test_lineage_has_no_cross_product(spark):
    plan = N.self_join(from_values(spark, {"a": SMALL}), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    assert F is not None


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("same", [True, False])
def test_long_windows_equal_matrices(first, same):
    rng = np.random.default_rng(3)
    a = np.round(np.cumsum(rng.normal(size=400)), 2)
    a[60:120] = 1.5
    b = np.round(np.cumsum(rng.normal(size=300)), 2)
    a[200] = np.nan
    for w in (5, 40):
        for x, x0, y, y0 in ((a, 0, a, 0), (a, 0, b, 400)) if same else ((a, 0, b, 0), (a, 300, b, 0)):
            y = x if y is a else y
            for more in ({}, {"keep_diagonal": N._diagonals(0.4, 3)}, {"rows_of": lambda i: i % 3 == 0} if same else {}):
                got = N.sweep_long(x, x0, y, y0, w, 7, first, same, 200, **more)
                want = N.sweep(x, x0, y, y0, w, 7, first, same, 200, **more)
                for g, e in zip(got, want):
                    assert np.allclose(g.r, e.r, atol=2e-9) and (np.where(np.isfinite(e.r), g.j == e.j, True).mean() > 0.995)


def test_long_windows_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(3000) / 40) + 0.1 * rng.normal(size=3000)
    s = from_values(spark, {"a": x})
    got = {r.idx: (r.mp, r.pi) for r in N.self_join(s, 900, block=512).collect()}
    z, _ = N.normalise(x, 900)
    c = np.round(z @ z.T, 10)
    i = np.arange(len(z))
    c[np.abs(i[:, None] - i[None, :]) <= 225] = -2
    assert len(got) == len(z)
    assert all(abs(got[k][0] - np.sqrt(1800 * (1 - c[k].max()))) < 1e-4 for k in range(0, len(z), 7))


def test_sampled_profiles_never_lie_below_the_exact_one(spark):
    rng = np.random.default_rng(8)
    x, y = np.sin(np.arange(300) / 7) + 0.3 * rng.normal(size=300), np.sin(np.arange(260) / 7) + 0.3 * rng.normal(size=260)
    s, q = from_values(spark, {"a": x}), from_values(spark, {"a": y})
    for other in (None, q):
        exact = {r.idx: r.mp for r in (N.self_join(s, 16) if other is None else N.ab_join(s, q, 16)).collect()}
        step = {r.idx: r.mp for r in N.stepped(s, 16, query=other).collect()}
        few = {r.idx: r.mp for r in N.sampled(s, 16, 0.2, query=other, step_size=None).collect()}
        both = {r.idx: r.mp for r in N.sampled(s, 16, 0.2, query=other).collect()}
        assert set(step) == set(few) == set(both) == set(exact)
        for i, least in exact.items():
            assert both[i] >= least - 1e-9 and abs(both[i] - min(step[i], few[i])) < 1e-9
        assert np.mean([abs(step[i] - exact[i]) < 0.5 for i in exact]) > 0.6
        assert [abs(r.mp - exact[r.idx]) < 1e-9 for r in N.sampled(s, 16, 1.0, query=other).collect()] == [True] * len(exact)


def test_long_queries_by_transforms(spark):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=9000), rng.normal(size=300)
    x[4000] = np.nan
    got = {r.idx: r.dot for r in mass.sliding_dot(from_values(spark, {"a": x}), q.tolist()).collect()}
    want = np.lib.stride_tricks.sliding_window_view(x, 300) @ q
    assert len(got) == len(want)
    assert all((got[i] is None) == bool(np.isnan(want[i])) and (got[i] is None or abs(got[i] - want[i]) < 1e-8) for i in range(0, len(want), 13))
    more = mass.profile(from_values(spark, {"a": [1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 4.0, 5.0]}), [2.0, 1.0, 1.0, 4.0], extras=True).collect()
    assert more[0].product == 12.0 and more[3].std == more[3].query_std
    flat = mass.profile(from_values(spark, {"a": [1.0, 1.0 + 1e-12, 1.0, 1.0]}), [2.0, 1.0, 1.0, 4.0], threshold=1e-10).first()
    assert flat.dist == 2.0
