"""Registered queries over the driver's tables, and the same queries in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import annotation, sliding
from seriesloom.operators import cluster, discover, impute, mass, mpdist, multidim, nearest, pan
from seriesloom.plans import compute as routers
from seriesloom.plans import frames
from seriesloom.sources import files
from seriesloom.sources import tables as T
from seriesloom.streaming import rolling

W = 24  # a day of hours
D = 28  # four weeks of days
PAN = [8, 16, 24, 48]
SHAPE = [float((7 * i) % 11) for i in range(W)]  # a fixed query

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 4, **columns) -> DataFrame:
    """Doubles rounded for comparison; adding 0 turns -0 into 0."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({n: F.round(F.col(n), columns.get(n, places)) + 0.0 for n in names})


# --- SQL text ---------------------------------------------------------------------------------------


def _sum_by(table: str, unit: str, ts: str, value: str, digits: int, sid: str = "'all'") -> str:
    total = f"CAST(sum(CAST(round({value}, {digits}) AS DECIMAL(30,{digits}))) AS DOUBLE)"
    return (
        f"SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, ts, value FROM "
        f"(SELECT {sid} AS series_id, date_trunc('{unit}', {ts}) AS ts, {total} AS value FROM {table} GROUP BY 1, 2)"
    )


HOURLY = _sum_by("events", "hour", "ts", "value", 6)
BY_TYPE = _sum_by("events", "hour", "ts", "value", 6, "event_type")
ORDERS = _sum_by("orders", "day", "o_orderdate", "o_totalprice", 2)
LINES = _sum_by("lineitem", "day", "l_shipdate", "l_quantity", 2)
DENSE = (
    f"SELECT g.series_id, g.idx, s.value FROM (SELECT series_id, a, unnest(range(0, date_diff('hour', a, b) + 1)) AS idx FROM "
    f"(SELECT series_id, min(ts) AS a, max(ts) AS b FROM ({BY_TYPE}) GROUP BY 1)) g "
    f"LEFT JOIN ({BY_TYPE}) s ON s.series_id = g.series_id AND s.ts = g.a + to_hours(CAST(g.idx AS INTEGER))"
)


def r(x: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0.0"


def frame(w: int) -> str:
    return f"PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING"


def windows(name: str, source: str, w: int) -> str:
    """CTEs: ``name`` (series_id, idx, z) holds the windows scaled to norm 1; z is null if the window is not whole."""
    return f"""{name}_a AS (SELECT series_id, idx, list(value) OVER ({frame(w)}) AS a FROM ({source})),
{name}_m AS (SELECT series_id, idx, a, list_avg(a) AS mu, list_min(a) = list_max(a) AS flat FROM {name}_a WHERE len(a) = {w}),
{name}_n AS (SELECT series_id, idx, flat, list_transform(a, lambda x: x - mu) AS c FROM {name}_m),
{name} AS (SELECT series_id, idx, flat, list_transform(c, lambda x: CASE WHEN flat THEN 0.0 ELSE x / sqrt(list_dot_product(c, c)) END) AS z FROM {name}_n)"""


def neighbours(name: str, a: str, b: str, on: str, order: str) -> str:
    """CTE: for each window of a its best window of b: r and j."""
    return f"""{name} AS (SELECT series_id, idx, max(r) AS r, arg_min(j, (-r, {order})) AS j FROM
  (SELECT x.series_id, x.idx, y.idx AS j, least(1.0, round(list_dot_product(x.z, y.z), 10)) AS r FROM {a} x JOIN {b} y ON x.series_id = y.series_id AND {on})
  GROUP BY 1, 2)"""


NEAREST = "abs(idx - j), j"
PAIR = "j > idx, abs(idx - j)"


def self_sql(source: str, w: int, zone: int, order: str = NEAREST) -> str:
    return f"{windows('w', source, w)},\n{neighbours('p', 'w', 'w', f'abs(x.idx - y.idx) > {zone}', order)}"


def mp(w: int, x: str = "r") -> str:
    return f"sqrt({2.0 * w} * (1 - {x}))"


QUARTER, HALF = math.ceil(W / 4), math.ceil(W / 2)
SELF = self_sql(HOURLY, W, QUARTER)
PROFILE = f"{SELF}, prof AS (SELECT w.series_id, {W} AS w, w.idx, {mp(W, 'coalesce(r, -1)')} AS mp, coalesce(j, -1) AS pi FROM w LEFT JOIN p USING (series_id, idx))"


# --- series and sliding windows ---------------------------------------------------------------------------


@query(f"SELECT series_id, idx, {r('value')} AS value FROM ({HOURLY})")
def series_hourly(spark, sf_dir):
    return rounded(T.events_hourly(spark, sf_dir).drop("ts"))


@query(f"SELECT series_id, idx, {r('value')} AS value FROM ({DENSE})")
def series_dense(spark, sf_dir):
    return rounded(T.dense(T.events_hourly_by_type(spark, sf_dir), "hour").drop("ts"))


@query(f"SELECT series_id, idx, max(CAST(value IS NULL AS INTEGER)) OVER ({frame(6)}) = 1 AS skip FROM ({DENSE}) QUALIFY count(*) OVER ({frame(6)}) = 6")
def skip_locations(spark, sf_dir):
    return sliding.skip_locations(T.dense(T.events_hourly_by_type(spark, sf_dir), "hour"), 6)


@query(f"SELECT series_id, idx, {r('coalesce(value, 0)')} AS value FROM ({DENSE})")
def clean_missing(spark, sf_dir):
    return rounded(sliding.clean(T.dense(T.events_hourly_by_type(spark, sf_dir), "hour").drop("ts")))


_SD = f"CASE WHEN min(value) OVER ({frame(W)}) = max(value) OVER ({frame(W)}) THEN 0 ELSE stddev_pop(value) OVER ({frame(W)}) END"


@query(f"""SELECT series_id, idx, {r(f'avg(value) OVER ({frame(W)})', 7)} AS moving_avg, {r(_SD)} AS moving_std, {r(f'min(value) OVER ({frame(W)})')} AS moving_min,
{r(f'max(value) OVER ({frame(W)})')} AS moving_max, {r(f'median(value) OVER ({frame(W)})')} AS moving_median,
{r(f'1 / (({_SD}) * sqrt({W}.0))', 8)} AS inverse_norm FROM ({HOURLY}) QUALIFY count(*) OVER ({frame(W)}) = {W}""")
def moving_stats(spark, sf_dir):
    return rounded(sliding.moving(T.events_hourly(spark, sf_dir), W), moving_avg=7, inverse_norm=8)


@query(f"""SELECT series_id, {r('min(value)')} AS ts_min, {r('max(value)')} AS ts_max, {r('avg(value)')} AS ts_mean, {r('stddev_pop(value)')} AS ts_std,
{r('median(value)')} AS ts_median, count(*) AS n FROM ({BY_TYPE}) GROUP BY 1""")
def statistics_global(spark, sf_dir):
    return rounded(sliding.statistics(T.events_hourly_by_type(spark, sf_dir), W)[0])


AV = {
    "default": f"SELECT series_id, idx, 1.0::DOUBLE AS av FROM ({HOURLY}) QUALIFY count(*) OVER ({frame(W)}) = {W}",
    "complexity": f"""SELECT series_id, idx, CASE WHEN max(c) OVER (PARTITION BY series_id) = 0 THEN 0 ELSE (c - min(c) OVER (PARTITION BY series_id)) / max(c) OVER (PARTITION BY series_id) END AS av FROM
 (SELECT series_id, idx, sqrt(sum(d) OVER ({frame(W - 1)})) AS c, count(d) OVER ({frame(W - 1)}) AS n FROM
 (SELECT series_id, idx, power(lead(value) OVER (PARTITION BY series_id ORDER BY idx) - value, 2) AS d FROM ({HOURLY})))  WHERE n = {W - 1}""",
    "meanstd": f"""SELECT series_id, idx, CASE WHEN s < avg(s) OVER (PARTITION BY series_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS av FROM
 (SELECT series_id, idx, {_SD} AS s FROM ({HOURLY}) QUALIFY count(*) OVER ({frame(W)}) = {W})""",
    "clipping": f"""SELECT series_id, idx, CASE WHEN max(c) OVER (PARTITION BY series_id) = min(c) OVER (PARTITION BY series_id) THEN 0 ELSE 1 - (c - min(c) OVER (PARTITION BY series_id)) / (max(c) OVER (PARTITION BY series_id) - min(c) OVER (PARTITION BY series_id)) END AS av FROM
 (SELECT series_id, idx, CAST(sum(h) OVER ({frame(W)}) AS DOUBLE) AS c FROM (SELECT *, CAST(value = min(value) OVER (PARTITION BY series_id) OR value = max(value) OVER (PARTITION BY series_id) AS INTEGER) AS h FROM ({HOURLY}))
 QUALIFY count(*) OVER ({frame(W)}) = {W})""",
}


def _av(kind):
    def fn(spark, sf_dir):
        return rounded(annotation.make(T.events_hourly(spark, sf_dir), W, kind), 8)

    fn.__name__ = f"av_{kind}"
    query(f"SELECT series_id, idx, {r('av', 8)} AS av FROM ({AV[kind]})")(fn)


for _kind in annotation.KINDS:
    _av(_kind)


@query(f"WITH {PROFILE}, a AS ({AV['complexity']}) SELECT series_id, idx, w, {r('mp')} AS mp, pi, {r('av')} AS av, {r('mp + (1 - av) * max(mp) OVER (PARTITION BY series_id)')} AS cmp FROM prof JOIN a USING (series_id, idx)")
def cmp_apply(spark, sf_dir):
    s = T.events_hourly(spark, sf_dir)
    return rounded(annotation.apply(nearest.self_join(s, W), annotation.make(s, W, "complexity")))


# --- distances of a query ---------------------------------------------------------------------------------

_Q = "[" + ", ".join(f"{v}::DOUBLE" for v in SHAPE) + "]"
_QMU = sum(SHAPE) / W
_QC = "[" + ", ".join(f"{(v - _QMU) / math.sqrt(sum((u - _QMU) ** 2 for u in SHAPE))!r}::DOUBLE" for v in SHAPE) + "]"


@query(f"SELECT series_id, idx, {r(f'list_dot_product(a, {_Q})')} AS dot FROM (SELECT series_id, idx, list(value) OVER ({frame(W)}) AS a FROM ({HOURLY})) WHERE len(a) = {W}")
def sliding_dot(spark, sf_dir):
    return rounded(mass.sliding_dot(T.events_hourly(spark, sf_dir), SHAPE))


@query(f"WITH {windows('w', HOURLY, W)} SELECT series_id, idx, {r(f'CASE WHEN flat THEN sqrt({W}.0) ELSE sqrt({2.0 * W} * (1 - least(1.0, list_dot_product(z, {_QC})))) END')} AS dist FROM w")
def mass_profile(spark, sf_dir):
    return rounded(mass.profile(T.events_hourly(spark, sf_dir), SHAPE))


# --- joins ------------------------------------------------------------------------------------------------


@query(f"WITH {PROFILE} SELECT series_id, w, idx, {r('mp')} AS mp, pi FROM prof")
def mp_self(spark, sf_dir):
    return rounded(nearest.self_join(T.events_hourly(spark, sf_dir), W))


@query(f"WITH {self_sql(ORDERS, D, math.ceil(D / 4))} SELECT w.series_id, {D} AS w, w.idx, {r(mp(D, 'coalesce(r, -1)'))} AS mp, coalesce(j, -1) AS pi FROM w LEFT JOIN p USING (series_id, idx)")
def mp_self_daily(spark, sf_dir):
    return rounded(nearest.self_join(T.orders_daily(spark, sf_dir), D))


@query(f"WITH {SELF} SELECT w.series_id, {W} AS w, w.idx, {r('coalesce(r, -1)', 6)} AS mp, coalesce(j, -1) AS pi FROM w LEFT JOIN p USING (series_id, idx)")
def mp_self_corr(spark, sf_dir):
    return rounded(nearest.self_join(T.events_hourly(spark, sf_dir), W, correlation=True), 6)


@query(f"WITH {SELF} SELECT w.series_id, w.idx, {r(mp(W, 'coalesce(r, -1)'))} AS dist FROM w LEFT JOIN p USING (series_id, idx)")
def pearson_to_euclidean(spark, sf_dir):
    p = nearest.self_join(T.events_hourly(spark, sf_dir), W, correlation=True)
    return rounded(p.select("series_id", "idx", nearest.distance(F.col("mp"), W).alias("dist")))


@query(f"""WITH {windows('w', HOURLY, W)}, {neighbours('p', 'w', 'w', f'abs(x.idx - y.idx) > {HALF}', 'j')}, {neighbours('lp', 'w', 'w', f'x.idx - y.idx > {HALF}', 'j')},
{neighbours('rp', 'w', 'w', f'y.idx - x.idx > {HALF}', 'j')}
SELECT w.series_id, {W} AS w, w.idx, {r(mp(W, 'coalesce(p.r, -1)'))} AS mp, coalesce(p.j, -1) AS pi, {r(mp(W, 'coalesce(lp.r, -1)'))} AS lmp, coalesce(lp.j, -1) AS lpi,
{r(mp(W, 'coalesce(rp.r, -1)'))} AS rmp, coalesce(rp.j, -1) AS rpi FROM w LEFT JOIN p USING (series_id, idx) LEFT JOIN lp USING (series_id, idx) LEFT JOIN rp USING (series_id, idx)""")
def mp_left_right(spark, sf_dir):
    return rounded(nearest.exact_rows(T.events_hourly(spark, sf_dir), W))


_AB = f"{windows('a', ORDERS, D)}, {windows('b', LINES, D)}"


def _ab(side: str, x: str, y: str) -> str:
    return f"WITH {_AB}, {neighbours('p', x, y, 'true', PAIR)} SELECT {x}.series_id, {D} AS w, {x}.idx, {r(mp(D, 'r'))} AS mp, j AS pi FROM {x} JOIN p USING (series_id, idx)"


@query(_ab("", "a", "b"))
def mp_ab(spark, sf_dir):
    return rounded(nearest.ab_join(T.orders_daily(spark, sf_dir), T.lineitem_daily(spark, sf_dir), D))


@query(_ab("", "b", "a"))
def mp_ab_reverse(spark, sf_dir):
    return rounded(nearest.ab_join(T.orders_daily(spark, sf_dir), T.lineitem_daily(spark, sf_dir), D, reverse=True))


def _dims(spark, sf_dir):
    dense = sliding.clean(T.dense(T.events_hourly_by_type(spark, sf_dir), "hour"))
    dim = F.dense_rank().over(Window.partitionBy(F.lit("all")).orderBy("series_id"))
    names = dense.select("series_id").distinct().withColumn("dim", dim.cast("int"))
    return dense.join(names, "series_id").select(F.lit("all").alias("series_id"), "dim", "idx", "value")


_DIMS = f"SELECT 'all' AS one, dense_rank() OVER (ORDER BY series_id) AS dim, idx, coalesce(value, 0) AS value FROM ({DENSE})"
_DIMW = windows("w", f"SELECT CAST(dim AS VARCHAR) AS series_id, idx, value FROM ({_DIMS})", W)


@query(f"""WITH {_DIMW}, d AS (SELECT x.idx AS i, y.idx AS j, x.series_id AS dim, CASE WHEN x.flat OR y.flat THEN 'infinity'::DOUBLE ELSE {mp(W, 'least(1.0, round(list_dot_product(x.z, y.z), 10))')} END AS d
  FROM w x JOIN w y ON x.series_id = y.series_id AND abs(x.idx - y.idx) > {HALF}),
k AS (SELECT i, j, row_number() OVER (PARTITION BY i, j ORDER BY d, dim) AS k, round(avg(d) OVER (PARTITION BY i, j ORDER BY d, dim ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS m FROM d)
SELECT 'all' AS series_id, CAST(k AS INTEGER) AS k, {W} AS w, i AS idx, {r('min(m)')} AS mp, arg_min(j, (m, j)) AS pi FROM k GROUP BY k.k, i""")
def mp_multidim(spark, sf_dir):
    return rounded(multidim.self_join(_dims(spark, sf_dir), W).drop("dims"))


@query(SQL["mp_self"])
def scrimp_full(spark, sf_dir):
    return rounded(nearest.sampled(T.events_hourly(spark, sf_dir), W, 1.0))


@query()
def scrimp_sampled(spark, sf_dir):
    return rounded(nearest.sampled(T.events_hourly(spark, sf_dir), W, 0.25, seed=7))


@query()
def prescrimp(spark, sf_dir):
    return rounded(nearest.stepped(T.events_hourly(spark, sf_dir), W))


# --- discovery --------------------------------------------------------------------------------------------


def _greedy(source: str, value: str, k: int, before: int, after: int, best: str, same_w: bool = False) -> str:
    """CTEs g1 .. gk: one pick each from ``source`` (series_id, w, idx, value)."""
    out = []
    for n in range(1, k + 1):
        free = "".join(f" AND NOT (s.idx BETWEEN g{m}.idx - {before} AND g{m}.idx + {after}{f' AND s.w = g{m}.w' if same_w else ''})" for m in range(1, n))
        joins = "".join(f" JOIN g{m} USING (series_id)" for m in range(1, n))
        out.append(f"g{n} AS (SELECT s.series_id, {n} AS rank, unnest(arg_max({{'w': s.w, 'idx': s.idx, 'value': s.{value}}}, {best})) FROM {source} s{joins} WHERE isfinite(s.{value}){free} GROUP BY 1)")
    return ", ".join(out)


def _picks(k: int, name: str) -> str:
    return " UNION ALL ".join(f"SELECT series_id, w, rank, idx, {r('value')} AS {name} FROM g{n}" for n in range(1, k + 1))


@query(f"WITH {PROFILE}, {_greedy('prof', 'mp', 3, QUARTER, QUARTER - 1, '(s.mp, s.idx)')} {_picks(3, 'mp')}")
def discords_topk(spark, sf_dir):
    return rounded(discover.discords(nearest.self_join(T.events_hourly(spark, sf_dir), W), 3))


def _motifs(prof: str, lengths: dict[int, str], k: int, zone: str, most: int = 10, radius: float = 3.0) -> str:
    """Greedy motifs of ``prof`` (series_id, w, idx, v, pi), pick by pick; ``lengths`` names the windows of each w, ``zone`` is SQL over the first pick b1."""
    union = " UNION ALL ".join(f"SELECT series_id, {w} AS w, idx, flat, z FROM {name}" for w, name in lengths.items())
    out = [f"allw AS MATERIALIZED ({union})", "t0 AS (SELECT series_id, w, idx FROM allw WHERE false)"]
    taken, rows = "t0", []
    free = lambda at: f"NOT EXISTS (SELECT 1 FROM {taken} t JOIN zone ON zone.series_id = t.series_id WHERE t.series_id = c.series_id AND t.w = c.w AND {at} BETWEEN t.idx - zone.z AND t.idx + zone.z)"
    for n in range(1, k + 1):
        alive = f" AND c.series_id IN (SELECT series_id FROM m{n - 1})" if n > 1 else ""
        where = f" AND {free('c.idx')}" if n > 1 else ""
        out.append(f"b{n} AS MATERIALIZED (SELECT series_id, unnest(arg_min({{'w': w, 'idx': idx, 'v': v, 'pi': pi}}, (v, w, idx))) FROM {prof} c WHERE isfinite(v){alive}{where} GROUP BY 1)")
        if n == 1:
            out.append(f"zone AS MATERIALIZED (SELECT series_id, {zone} AS z FROM b1)")
        out.append(f"m{n} AS MATERIALIZED (SELECT series_id, w, v, least(idx, pi) AS a, greatest(idx, pi) AS b FROM b{n} WHERE pi >= 0)")
        out.append(f"t{n}_0 AS MATERIALIZED (SELECT * FROM {taken} UNION ALL SELECT series_id, w, a FROM m{n} UNION ALL SELECT series_id, w, b FROM m{n})")
        taken = f"t{n}_0"
        dist = "CASE WHEN x.flat AND y.flat THEN 0 WHEN x.flat OR y.flat THEN sqrt(y.w) ELSE sqrt(greatest(0, 2.0 * y.w * (1 - round(list_dot_product(x.z, y.z), 10)))) END"
        out.append(
            f"d{n} AS MATERIALIZED (SELECT y.series_id, y.w, y.idx, m.v AS least, {dist} AS d FROM m{n} m JOIN allw x ON x.series_id = m.series_id AND x.w = m.w AND x.idx = m.a "
            f"JOIN allw y ON y.series_id = m.series_id AND y.w = m.w JOIN {prof} p ON p.series_id = y.series_id AND p.w = y.w AND p.idx = y.idx AND isfinite(p.v))"
        )
        rows += [f"SELECT series_id, {n} AS rank, w, 'first' AS role, 0 AS place, a AS idx FROM m{n}", f"SELECT series_id, {n}, w, 'second', 0, b FROM m{n}"]
        for q in range(1, most + 1):
            out.append(f"n{n}_{q} AS MATERIALIZED (SELECT series_id, w, arg_min(idx, (d, idx)) AS idx FROM d{n} c WHERE d <= {radius} * least AND {free('c.idx')} GROUP BY 1, 2)")
            out.append(f"t{n}_{q} AS MATERIALIZED (SELECT * FROM {taken} UNION ALL SELECT * FROM n{n}_{q})")
            taken = f"t{n}_{q}"
            rows.append(f"SELECT series_id, {n}, w, 'neighbor', {q}, idx FROM n{n}_{q}")
    return ", ".join(out) + " " + " UNION ALL ".join(rows)


@query(f"WITH {PROFILE}, mo AS (SELECT series_id, w, idx, mp AS v, pi FROM prof), {_motifs('mo', {W: 'w'}, 3, str(QUARTER))}")
def motifs_topk(spark, sf_dir):
    s = T.events_hourly(spark, sf_dir)
    return discover.motifs(s, nearest.self_join(s, W), 3)


@query(f"""WITH {PROFILE}, av AS ({AV['clipping']}), mo AS (SELECT series_id, w, idx, mp + (1 - av) * max(mp) OVER (PARTITION BY series_id) AS v, pi FROM prof JOIN av USING (series_id, idx)),
{_motifs('mo', {W: 'w'}, 3, str(QUARTER))}""")
def motifs_cmp(spark, sf_dir):
    s = T.events_hourly(spark, sf_dir)
    p = annotation.apply(nearest.self_join(s, W), annotation.make(s, W, "clipping"))
    return discover.motifs(s, p, 3, column="cmp")


def _arcs(profile: str, w: int) -> str:
    return f"""{profile}, n AS (SELECT series_id, count(*) AS n FROM prof GROUP BY 1),
marks AS (SELECT series_id, least(idx, pi) + 1 AS idx, 1 AS d FROM prof WHERE pi >= 0 UNION ALL SELECT series_id, greatest(idx, pi), -1 FROM prof WHERE pi >= 0),
crossed AS (SELECT series_id, w, idx, sum(coalesce(d, 0)) OVER (PARTITION BY series_id ORDER BY idx) AS c FROM prof LEFT JOIN (SELECT series_id, idx, sum(d) AS d FROM marks GROUP BY 1, 2) USING (series_id, idx)),
arcs AS (SELECT series_id, w, idx, CASE WHEN idx < {w} OR idx >= n - {w} THEN 1.0 ELSE least(1.0, c / (n / 2.0 - power(idx - n / 2.0, 2) / (n / 2.0))) END::DOUBLE AS cac FROM crossed JOIN n USING (series_id))"""


_CAC = _arcs(PROFILE, W)


@query(f"WITH {_CAC} SELECT series_id, w, idx, {r('cac', 8)} AS cac FROM arcs")
def cac_fluss(spark, sf_dir):
    return rounded(discover.arc_curve(nearest.self_join(T.events_hourly(spark, sf_dir), W)), 8)


@query(f"WITH {_CAC}, cr AS (SELECT series_id, w, idx, round(cac, 8) AS cac FROM arcs), {_greedy('cr', 'cac', 3, 5 * W, 5 * W - 1, '(-s.cac, -s.idx)')} {_picks(3, 'cac')}")
def regimes(spark, sf_dir):
    return rounded(discover.regimes(nearest.self_join(T.events_hourly(spark, sf_dir), W), 3))


@query(f"SELECT CAST(i AS BIGINT) AS idx, {r('360.0 - power(i - 360.0, 2) / 360.0')} AS ideal FROM range(0, 720) t(i)")
def idealized_arc_curve(spark, sf_dir):
    return rounded(spark.range(720).select(F.col("id").alias("idx"), discover.ideal_arcs(F.lit(720), F.col("id")).alias("ideal")))


# --- the same over several series at once -----------------------------------------------------------------

_ZERO = f"SELECT series_id, idx, coalesce(value, 0) AS value FROM ({DENSE})"
_TYPES = f"{self_sql(_ZERO, W, QUARTER)}, prof AS (SELECT w.series_id, {W} AS w, w.idx, {mp(W, 'coalesce(r, -1)')} AS mp, coalesce(j, -1) AS pi FROM w LEFT JOIN p USING (series_id, idx))"


def _types(spark, sf_dir):
    return sliding.clean(T.dense(T.events_hourly_by_type(spark, sf_dir), "hour").drop("ts"))


@query(f"WITH {_TYPES} SELECT series_id, w, idx, {r('mp')} AS mp, pi FROM prof")
def mp_self_by_type(spark, sf_dir):
    return rounded(nearest.self_join(_types(spark, sf_dir), W))


@query(SQL["mp_left_right"].replace(f"({HOURLY})", f"({_ZERO})"))
def mp_left_right_by_type(spark, sf_dir):
    return rounded(nearest.exact_rows(_types(spark, sf_dir), W))


_HALVES = (f"SELECT * FROM ({_ZERO}) WHERE idx < 360", f"SELECT series_id, idx - 360 AS idx, value FROM ({_ZERO}) WHERE idx >= 360")


@query(f"WITH {windows('a', _HALVES[0], W)}, {windows('b', _HALVES[1], W)}, {neighbours('p', 'a', 'b', 'true', PAIR)} SELECT a.series_id, {W} AS w, a.idx, {r(mp(W, 'r'))} AS mp, j AS pi FROM a JOIN p USING (series_id, idx)")
def mp_ab_by_type(spark, sf_dir):
    s = _types(spark, sf_dir)
    return rounded(nearest.ab_join(s.filter("idx < 360"), s.filter("idx >= 360").withColumn("idx", F.col("idx") - 360), W))


@query(f"WITH {_TYPES}, {_greedy('prof', 'mp', 3, QUARTER, QUARTER - 1, '(s.mp, s.idx)')} {_picks(3, 'mp')}")
def discords_by_type(spark, sf_dir):
    return rounded(discover.discords(nearest.self_join(_types(spark, sf_dir), W), 3))


@query(f"WITH {_TYPES}, mo AS (SELECT series_id, w, idx, mp AS v, pi FROM prof), {_motifs('mo', {W: 'w'}, 2, str(QUARTER))}")
def motifs_by_type(spark, sf_dir):
    s = _types(spark, sf_dir)
    return discover.motifs(s, nearest.self_join(s, W), 2)


@query(f"WITH {_arcs(_TYPES, W)}, cr AS (SELECT series_id, w, idx, round(cac, 8) AS cac FROM arcs), {_greedy('cr', 'cac', 3, 5 * W, 5 * W - 1, '(-s.cac, -s.idx)')} {_picks(3, 'cac')}")
def regimes_by_type(spark, sf_dir):
    return rounded(discover.regimes(nearest.self_join(_types(spark, sf_dir), W), 3))


# --- distances of series ----------------------------------------------------------------------------------


@query(f"""WITH {_AB}, {neighbours('pa', 'a', 'b', 'true', PAIR)}, {neighbours('pb', 'b', 'a', 'true', PAIR)},
d AS (SELECT {mp(D, 'r')} AS d FROM pa UNION ALL SELECT {mp(D, 'r')} FROM pb), n AS (SELECT (SELECT count(*) FROM ({ORDERS})) + (SELECT count(*) FROM ({LINES})) AS n)
SELECT 'all' AS series_id, {r('list_sort(list(d))[CAST(least(count(*), ceil(0.05 * any_value(n))) AS BIGINT)]')} AS dist FROM d, n""")
def mpdist_pair(spark, sf_dir):
    return rounded(mpdist.distance(T.orders_daily(spark, sf_dir), T.lineitem_daily(spark, sf_dir), D))


_PAIRS = f"""{windows('w', BY_TYPE, W)}, pr AS (SELECT x.series_id AS a, y.series_id AS b, x.idx AS i, y.idx AS j, least(1.0, round(list_dot_product(x.z, y.z), 10)) AS r FROM w x JOIN w y ON x.series_id < y.series_id),
d AS (SELECT a, b, {mp(W, 'max(r)')} AS d FROM pr GROUP BY a, b, i UNION ALL SELECT a, b, {mp(W, 'max(r)')} FROM pr GROUP BY a, b, j), n AS (SELECT series_id, count(*) AS n FROM ({BY_TYPE}) GROUP BY 1),
pairs AS (SELECT a AS id_a, b AS id_b, list_sort(list(d))[CAST(least(count(*), ceil(0.05 * (any_value(na.n) + any_value(nb.n)))) AS BIGINT)] AS dist FROM d JOIN n na ON na.series_id = a JOIN n nb ON nb.series_id = b GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT id_a, id_b, {r('dist')} AS dist FROM pairs")
def mpdist_pairwise(spark, sf_dir):
    return rounded(mpdist.pairwise(T.events_hourly_by_type(spark, sf_dir), W))


_CUT = 5.05


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT id_a AS a, id_b AS b FROM pairs WHERE round(dist, 6) <= {_CUT} UNION ALL SELECT id_b, id_a FROM pairs WHERE round(dist, 6) <= {_CUT}),
reach AS (SELECT series_id AS a, series_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS series_id, min(b) AS cluster FROM reach GROUP BY 1""")
def hclusters_single(spark, sf_dir):
    s = T.events_hourly_by_type(spark, sf_dir)
    pairs = mpdist.pairwise(s, W).withColumn("dist", F.round("dist", 6))
    return cluster.components(pairs, s, _CUT)


@query(SQL["hclusters_single"])
def hclusters_tree(spark, sf_dir):
    """The flat clusters of the tree, named by their least member."""
    got = cluster.hierarchical(T.events_hourly_by_type(spark, sf_dir), W, _CUT)[1]
    return got.select("series_id", F.min("series_id").over(Window.partitionBy("cluster")).alias("cluster"))


_SHORT = 36
_SHAPE = [float((5 * i) % 13) for i in range(_SHORT)]
_SQ = "SELECT 'all' AS series_id, unnest(range(0, {n})) AS idx, unnest([{v}]) AS value".format(n=_SHORT, v=", ".join(f"{v}::DOUBLE" for v in _SHAPE))


@query(f"""WITH {windows('a', HOURLY, W)}, {windows('q', _SQ, W)},
m AS (SELECT x.idx AS i, y.idx AS j, CASE WHEN x.flat AND y.flat THEN 0 WHEN x.flat OR y.flat THEN sqrt({W}.0) ELSE sqrt({2.0 * W} * (1 - least(1.0, list_dot_product(x.z, y.z)))) END AS d FROM a x, q y),
s AS (SELECT i, j, d, unnest(range(greatest(0, i - {_SHORT - W}), least(i, (SELECT count(*) FROM ({HOURLY})) - {_SHORT}) + 1)) AS st FROM m),
h AS (SELECT st, min(d) AS d FROM s GROUP BY st, j UNION ALL SELECT st, min(d) FROM s GROUP BY st, i)
SELECT 'all' AS series_id, st AS idx, {r(f'list_sort(list(d))[CAST(least(count(*), ceil(0.05 * 2 * {_SHORT}) + 1) AS BIGINT)]')} AS dist FROM h GROUP BY st""")
def mpdist_vector(spark, sf_dir):
    q = T.from_values(spark, {"all": _SHAPE})
    return rounded(mpdist.vector(T.events_hourly(spark, sf_dir), q, W))


_SN = 48
_SNIP = f"""WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / {_SN}.0) * {_SN} AS BIGINT) AS m FROM ({HOURLY})),
padded AS (SELECT 'all' AS series_id, idx, value FROM ({HOURLY}) UNION ALL SELECT 'all', unnest(range(n, m)), 0.0 FROM n), {windows('w', 'SELECT * FROM padded', _SN // 2)},
cand AS (SELECT unnest(range(0, m - {_SN}, {_SN})) AS c FROM n),
pair AS (SELECT c, x.idx AS q, y.idx AS i, CASE WHEN x.flat AND y.flat THEN 0 WHEN x.flat OR y.flat THEN sqrt({_SN // 2}.0)
  ELSE sqrt(greatest(0, {2.0 * (_SN // 2)} * (1 - round(list_dot_product(x.z, y.z), 10)))) END AS d FROM cand JOIN w x ON x.idx BETWEEN c AND c + {_SN - 1 - _SN // 2} CROSS JOIN w y),
least AS (SELECT c, i, min(d) AS d FROM pair GROUP BY 1, 2),
spread AS (SELECT c, q, i, d, unnest(range(greatest(0, i - {_SN - 1 - _SN // 2}), least(i, m - {_SN - 1}) + 1)) AS st FROM pair, n),
halves AS (SELECT c, st, min(d) AS d FROM spread GROUP BY c, st, q
  UNION ALL SELECT c, st, d FROM (SELECT c, d, unnest(range(greatest(0, i - {_SN - 1 - _SN // 2}), least(i, m - {_SN - 1}) + 1)) AS st FROM least, n)),
vec AS MATERIALIZED (SELECT c, st, list_sort(list(d))[CAST(least(count(*), ceil(0.05 * 2 * {_SN - 1}) + 1) AS BIGINT)] AS d FROM halves GROUP BY 1, 2),
s1 AS MATERIALIZED (SELECT arg_min(c, (t, c)) AS c FROM (SELECT c, sum(d) AS t FROM vec GROUP BY 1)), d1 AS MATERIALIZED (SELECT st, d FROM vec, s1 WHERE vec.c = s1.c),
s2 AS MATERIALIZED (SELECT arg_min(c, (t, c)) AS c FROM (SELECT c, sum(least(vec.d, d1.d)) AS t FROM vec JOIN d1 USING (st) GROUP BY 1)), d2 AS (SELECT st, d FROM vec, s2 WHERE vec.c = s2.c),
mask AS (SELECT 1 AS rank, s1.c AS idx, st, d1.d <= least(d1.d, d2.d) AS hit FROM d1 JOIN d2 USING (st), s1
  UNION ALL SELECT 2, s2.c, st, d2.d <= least(d1.d, d2.d) - CAST(d1.d <= least(d1.d, d2.d) AS INTEGER) FROM d1 JOIN d2 USING (st), s2)
SELECT 'all' AS series_id, rank, idx, CAST(count(*) FILTER (WHERE hit AND st <= n - {_SN}) + {_SN - 1} * coalesce(max(CAST(hit AS INTEGER)) FILTER (WHERE st = n - {_SN}), 0) AS INTEGER) AS n_neighbors,
  {r(f'count(*) FILTER (WHERE hit) / (m - {_SN})')} AS fraction FROM mask, n GROUP BY rank, idx, n, m"""


@query(_SNIP)
def snippets(spark, sf_dir):
    out = mpdist.snippets(T.events_hourly(spark, sf_dir), 48, 2)
    return rounded(out.select("series_id", "rank", "idx", F.size("neighbors").alias("n_neighbors"), "fraction"))


# --- many window lengths ----------------------------------------------------------------------------------


def _pan_cte() -> str:
    parts, unions = [], []
    for w in PAN:
        parts.append(f"{windows(f'w{w}', HOURLY, w)}, {neighbours(f'p{w}', f'w{w}', f'w{w}', f'abs(x.idx - y.idx) > {math.ceil(w / 4)}', NEAREST)}")
        unions.append(f"SELECT x.series_id, {w} AS w, x.idx, {mp(w, 'coalesce(r, -1)')} AS mp, coalesce(j, -1) AS pi FROM w{w} x LEFT JOIN p{w} USING (series_id, idx)")
    return ", ".join(parts) + ", pan AS (" + " UNION ALL ".join(unions) + ")"


_PANSQL = _pan_cte()


@query(f"WITH {_PANSQL} SELECT series_id, w, idx, {r('mp')} AS mp, pi FROM pan")
def pmp(spark, sf_dir):
    return rounded(pan.pan_profile(T.events_hourly(spark, sf_dir), PAN))


@query(f"WITH {_PANSQL} SELECT series_id, w, idx, {r('mp')} AS mp, pi FROM pan WHERE w = 16")
def pmp_pick(spark, sf_dir):
    return rounded(pan.pick(pan.pan_profile(T.events_hourly(spark, sf_dir), PAN), 16))


@query(f"WITH {_PANSQL}, {_greedy('pan', 'mp', 3, 24, 23, '(s.mp, -s.w, -s.idx)', True)} {_picks(3, 'mp')}")
def pmp_discords(spark, sf_dir):
    return rounded(discover.pan_discords(pan.pan_profile(T.events_hourly(spark, sf_dir), PAN), 3, 24))


@query(f"WITH {_PANSQL}, mo AS (SELECT series_id, w, idx, mp AS v, pi FROM pan), {_motifs('mo', {w: f'w{w}' for w in PAN}, 3, 'w // 2')}")
def pmp_motifs(spark, sf_dir):
    s = T.events_hourly(spark, sf_dir)
    return discover.motifs(s, pan.pan_profile(s, PAN), 3)


@query(f"WITH {_PANSQL} SELECT series_id, w, idx, {r('least(1.0, ceil(mp / sqrt(4.0 * w) * 256) / 256)', 6)} AS level FROM pan")
def pmp_heat(spark, sf_dir):
    return rounded(frames.heat(pan.pan_profile(T.events_hourly(spark, sf_dir), PAN)), 6)


_FINER = "CAST(floor((CASE WHEN s = 20 THEN 2.0::DOUBLE ELSE 1 + (0.05::DOUBLE + (s - 1) * 0.05::DOUBLE) END) * g) AS INTEGER)"


def _longest(threshold: float, lower: int) -> str:
    """Doubled lengths, then steps from the last good one; the best correlation of each length."""
    best = lambda name, of: f"""{name}_w AS (SELECT k.w, i AS idx, v[i + 1:i + k.w] AS a FROM (SELECT DISTINCT w FROM {of}) k, vals, range(0, 100000) t(i) WHERE i <= len(v) - k.w),
{name}_c AS (SELECT w, idx, list_min(a) = list_max(a) AS flat, list_transform(a, lambda x: x - list_avg(a)) AS c FROM {name}_w),
{name}_z AS MATERIALIZED (SELECT w, idx, list_transform(c, lambda x: CASE WHEN flat THEN 0.0 ELSE x / sqrt(list_dot_product(c, c)) END) AS z FROM {name}_c),
{name} AS MATERIALIZED (SELECT x.w, max(least(1.0, round(list_dot_product(x.z, y.z), 10))) AS r FROM {name}_z x JOIN {name}_z y ON x.w = y.w AND y.idx - x.idx > ceil(x.w / 4.0) GROUP BY 1)"""  # noqa: E731
    return f"""WITH vals AS (SELECT list(value ORDER BY idx) AS v FROM ({HOURLY})),
dw AS (SELECT CAST({lower} * power(2, k) AS INTEGER) AS w FROM range(0, 20) t(k), vals WHERE {lower} * power(2, k) <= len(v) // 2), {best('db', 'dw')},
tried AS (SELECT w, r, count(*) FILTER (WHERE r < {threshold}) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM db),
good AS (SELECT w, r FROM tried WHERE coalesce(before, 0) = 0 AND r > {threshold}), last AS (SELECT max(w) AS g FROM good),
fw AS (SELECT s, {_FINER} + {_FINER} % 2 AS w FROM last, range(1, 21) t(s)), {best('fb', 'fw')},
steps AS (SELECT s, fw.w, r, count(*) FILTER (WHERE r < {threshold}) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fw JOIN fb ON fw.w = fb.w),
used AS (SELECT s, w, r FROM steps WHERE coalesce(before, 0) = 0), upper AS (SELECT arg_max(w, s) AS w FROM used)
SELECT DISTINCT u.w, {r('u.r', 6)} AS correlation, u.w = upper.w AS is_upper FROM (SELECT w, r FROM good UNION SELECT w, r FROM used) u, upper"""


@query(_longest(0.8, 8))
def max_subsequence(spark, sf_dir):
    upper, best = pan.maximum_subsequence(T.events_hourly(spark, sf_dir), 0.8, include=True)
    return spark.createDataFrame([(w, round(r, 6), w == upper) for w, r in best.items()], "w int, correlation double, is_upper boolean")


# --- preparation, storage, routers ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE s AS (SELECT series_id, list(value ORDER BY idx) AS v FROM ({DENSE}) GROUP BY 1),
ends AS (SELECT series_id, list_transform(v, lambda x, i: CASE WHEN x IS NOT NULL THEN x WHEN i = 1 THEN list_filter(v, lambda y: y IS NOT NULL)[1] WHEN i = len(v) THEN list_filter(v, lambda y: y IS NOT NULL)[-1] END) AS v FROM s),
fill AS (SELECT series_id, 0 AS i, v FROM ends UNION ALL
  SELECT series_id, i + 1, CASE WHEN len(list_filter(v[i + 1:i + 4], lambda x: x IS NULL)) IN (0, 4) THEN v
    ELSE list_transform(v, lambda x, k: CASE WHEN x IS NULL AND k BETWEEN i + 1 AND i + 4 THEN list_avg(list_filter(v[i + 1:i + 4], lambda y: y IS NOT NULL)) ELSE x END) END
  FROM fill WHERE i < len(v) - 3),
done AS (SELECT series_id, v FROM fill WHERE i = len(v) - 3)
SELECT series_id, unnest(range(0, len(v))) AS idx, {r('unnest(v)')} AS value FROM done""")
def impute_forward(spark, sf_dir):
    return rounded(impute.impute(T.dense(T.events_hourly_by_type(spark, sf_dir), "hour").drop("ts"), 4))


@query(SQL["mp_self"])
def io_roundtrip(spark, sf_dir):
    p = nearest.self_join(T.events_hourly(spark, sf_dir), W)
    return rounded(files.decode(files.encode(p)).select("series_id", "w", "idx", "mp", "pi"))


@query(f"WITH {PROFILE}, s AS ({HOURLY}) SELECT s.series_id, s.idx, {r('value')} AS value, w, {r('mp')} AS mp, pi FROM s LEFT JOIN prof USING (series_id, idx)")
def plot_frames(spark, sf_dir):
    s = T.events_hourly(spark, sf_dir).drop("ts")
    return rounded(frames.series_and_profile(s, nearest.self_join(s, W)))


@query(SQL["mp_self"])
def compute_router(spark, sf_dir):
    return rounded(routers.compute(T.events_hourly(spark, sf_dir), W).profile)


@query(SQL["discords_topk"])
def analyze_router(spark, sf_dir):
    return rounded(routers.analyze(T.events_hourly(spark, sf_dir), W).tables["discords"])


@query(f"SELECT series_id, idx, {r('value')} AS value FROM ({HOURLY})")
def tumbling_sums(spark, sf_dir):
    sums = rolling.tumbling(T.table(spark, sf_dir, "events").withColumn("value", F.round("value", 6).cast("decimal(30,6)")), "ts", "value")
    return rounded(T.by_time(sums.withColumn("value", F.col("value").cast("double")), "hour", "ts", F.col("value")).drop("ts"))


def flagship(spark, sf_dir):
    """Nearest neighbours of every day of hours."""
    return mp_self(spark, sf_dir).orderBy("series_id", "idx")
