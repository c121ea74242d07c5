"""Registered queries of robust fits, plates, masks and alignment, with DuckDB oracles that write every pass out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geodesy
from driftline.functions.lsq import EPS, LIMIT, PASSES, chi2_quantile
from driftline.operators import alignment, joins, masks, quality, trajectory, upkeep, windows
from driftline.operators.selection import KEY
from driftline.plans import catalogue
from driftline.plans.catalogue import DAILY, HAVERSINE, query
from driftline.plans.station_catalogue import rows, with_
from driftline.session import table

#: Degrees of freedom up to which the oracles have the chi-square bounds as they are; beyond, by Wilson and Hilferty's rule.
TABLED = 150


def bounds() -> str:
    """bounds(dof, lo, hi) of the chi-square test at 95 %."""
    return "bounds as materialized (select * from (values " + ", ".join(f"({d}, {chi2_quantile(0.025, d)!r}, {chi2_quantile(0.975, d)!r})" for d in range(1, TABLED + 1)) + ") x(dof, lo, hi))"


def large(dof: str, z: float) -> str:
    return f"({dof} * pow(1 - 2 / (9.0 * {dof}) + ({z}) * sqrt(2 / (9.0 * {dof})), 3))"


def weighed(left: str, sigma: str) -> str:
    """The square of an observation's weight."""
    return f"pow(case when {sigma} is null then 1.0 else greatest(pow(10.0, least({LIMIT} - abs({left}) / {sigma}, 0.0)), {EPS!r}) end, 2)"


def robust_trends(series: str) -> str:
    """CTEs from series (key, t, v) to fit_{PASSES} (key, n, a, b, g): intercept, slope and deviation after the last pass of each key."""
    parts = [
        bounds(), f"d as materialized ({series})",
        "fit_0 as materialized (select key, count(*) n, 0.0::double a, 0.0::double b, null::double g, false fin from d group by key having count(distinct t) > 2)",
    ]
    for k in range(1, PASSES + 1):
        parts += [
            f"w_{k} as materialized (select d.key, t, v, n, g, {weighed('v - a - b * t', 'g')} w from d join fit_{k - 1} s on d.key is not distinct from s.key where not fin)",
            f"m_{k} as materialized (select key, sum(w * t) / sum(w) mt, sum(w * v) / sum(w) mv from w_{k} group by key)",
            f"s_{k} as materialized (select w.key, any_value(mt) mt, any_value(mv) mv, sum(w * (t - mt) * (v - mv)) / sum(w * (t - mt) * (t - mt)) b from w_{k} w join m_{k} m on w.key is not distinct from m.key group by w.key)",
            f"r_{k} as materialized (select w.key, any_value(n) n, any_value(coalesce(g, 1.0)) before, any_value(mv - b * mt) a, any_value(b) b, sqrt(sum(w * pow(v - mv - b * (t - mt), 2)) / (any_value(n) - 2)) g from w_{k} w join s_{k} s on w.key is not distinct from s.key group by w.key)",
            f"fit_{k} as materialized (select key, n, a, b, g, g < 1e-14 or pow(g / before, 2) * (n - 2) between coalesce(lo, {large('(n - 2)', -1.959963984540054)}) and coalesce(hi, {large('(n - 2)', 1.959963984540054)}) fin "
            f"from r_{k} left join bounds on dof = n - 2 union all select key, n, a, b, g, fin from fit_{k - 1} where fin)",
        ]
    return ", ".join(parts)


FLAGSHIP = f"""with {DAILY}, {robust_trends('select user_id as key, t, v from daily')},
steps as (select *, case when t - lag(t) over (partition by user_id order by t) > 1 then t - lag(t) over (partition by user_id order by t) - 1 end g from daily),
gaps as (select user_id, count(g) n_gaps, coalesce(max(g), 0) longest_gap from steps group by 1),
used as (select d.key, count(*) filter (abs(d.v - a - b * d.t) <= {LIMIT} * g or g < 1e-14) n_used from d join fit_{PASSES} f on d.key is not distinct from f.key group by 1)
select user_id, n_gaps, longest_gap, round(coalesce(b, 'nan'::double), 6) slope, round(coalesce(a, 'nan'::double), 6) intercept, round(coalesce(g, 'nan'::double), 6) wrms, coalesce(n_used, 0) n_used
from gaps left join fit_{PASSES} f on f.key = user_id left join used u on u.key = user_id"""
catalogue.ORACLE["gap_trend_flagship"] = FLAGSHIP


@query(
    f"""with {DAILY}, {robust_trends("select (user_id, c) as key, t, case c when 0 then v when 1 then v * v / 100 else (user_id % 7) * t + 3 * v end v from daily, range(3) x(c)")},
used as (select d.key, count(*) filter (abs(d.v - a - b * d.t) <= {LIMIT} * g or g < 1e-14) n_used from d join fit_{PASSES} f on d.key = f.key group by 1),
first as (select user_id, min(t) t0, count(*) n from daily group by 1)
select user_id, key[2]::int component, round(a + b * t0, 5) position, round(b, 6) velocity, round(g, 5) wrms, n_used::bigint n_used from fit_{PASSES} f join used u using (key) join first on user_id = f.key[1] where first.n > 2"""
)
def trajectories_of_series(spark, sf):
    """The trajectory model of each user's daily series in three components; series of a month have no periodic terms."""
    d, v = catalogue.daily(spark, sf), F.col("v")
    three = {"n": v, "e": v * v / 100, "u": F.col("user_id") % 7 * F.col("t") + 3 * v}
    series = d.select(F.lit("users").alias("NetworkCode"), F.col("user_id").cast("string").alias("StationCode"), "t", *[c.alias(k) for k, c in three.items()])
    terms = trajectory.fit_trajectories(series)
    by = lambda term, column: F.max(F.when(term, F.col(column)))
    one = terms.groupBy("StationCode").agg(
        by((F.col("term") == "poly") & (F.col("value") == 0), "params").alias("p"), by((F.col("term") == "poly") & (F.col("value") == 1), "params").alias("v"),
        by(F.col("term") == "wrms", "params").alias("w"), by(F.col("term") == "wrms", "sigmas").alias("used"),
    )
    own = one.select(F.col("StationCode").cast(dict(d.dtypes)["user_id"]).alias("user_id"), F.posexplode(F.arrays_zip("p", "v", "w", "used")).alias("component", "x"))
    return own.select("user_id", "component", F.round("x.p", 5).alias("position"), F.round("x.v", 6).alias("velocity"), F.round("x.w", 5).alias("wrms"), F.col("x.used").cast("long").alias("n_used"))


def moving(engine: str) -> dict[str, str]:
    """Velocities of stations on the globe by a known rotation (nrad/yr), with millimetres of noise and a few gross errors."""
    place = {"auto_x": "6371000 * cos(radians(lat)) * cos(radians(lon))", "auto_y": "6371000 * cos(radians(lat)) * sin(radians(lon))", "auto_z": "6371000 * sin(radians(lat))"}
    noise = lambda k: f"(k * {k} % 2001 - 1000) * 1e-6"
    wrong = "case when k % 60 = 7 then 1.0 else 0.0 end"
    return {"place": ", ".join(f"{v} as {c}" for c, v in place.items()), "velocity": f"2e-9 * auto_z - 1e-9 * auto_y + {noise(37)} + {wrong} as vx, 1e-9 * auto_x - 3e-9 * auto_z + {noise(53)} as vy, 3e-9 * auto_y - 2e-9 * auto_x + {noise(71)} as vz"}


def euler_sql() -> str:
    m = moving("duck")
    parts = [
        f"p as (select * exclude (auto_x, auto_y, auto_z), {m['place']} from stations)", f"v as (select *, {m['velocity']} from p)",
        "s as (select *, sqrt(auto_x ** 2 + auto_y ** 2 + auto_z ** 2) size, sqrt(auto_x ** 2 + auto_y ** 2) flat from v)",
        "t as (select auto_z / size sl, flat / size cl, auto_y / flat so, auto_x / flat co, vx, vy, vz from s)",
        f"""eq as materialized (select {geodesy.SEMI_MAJOR} * 1e-9 * so a, -{geodesy.SEMI_MAJOR} * 1e-9 * co b, 0.0 c, -sl * co * vx - sl * so * vy + cl * vz l from t
union all select -{geodesy.SEMI_MAJOR} * 1e-9 * sl * co, -{geodesy.SEMI_MAJOR} * 1e-9 * sl * so, {geodesy.SEMI_MAJOR} * 1e-9 * cl, -so * vx + co * vy from t)""",
        "fit_0 as materialized (select 0.0::double x, 0.0::double y, 0.0::double z, null::double g, false fin)",
    ]
    det = lambda a, b, c, d, e, f, g, h, i: f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"
    n = ("aa", "ab", "ac", "ab", "bb", "bc", "ac", "bc", "cc")
    swapped = lambda k: det(*[f"{'abc'[i // 3]}l" if i % 3 == k else v for i, v in enumerate(n)])
    sums = ", ".join(f"sum(w * {i} * {j}) {i}{j}" for i, j in ("aa", "ab", "ac", "bb", "bc", "cc", "al", "bl", "cl"))
    for k in range(1, PASSES + 1):
        parts += [
            f"w_{k} as materialized (select a, b, c, l, g, fin, x, y, z, {weighed('l - a * x - b * y - c * z', 'g')} w from eq, fit_{k - 1})",
            f"n_{k} as materialized (select count(*) n, any_value(coalesce(g, 1.0)) before, {sums}, bool_and(fin) fin, any_value(x) x0, any_value(y) y0, any_value(z) z0, any_value(g) g0 from w_{k})",
            f"c_{k} as materialized (select *, {swapped(0)} / {det(*n)} x1, {swapped(1)} / {det(*n)} y1, {swapped(2)} / {det(*n)} z1 from n_{k})",
            f"g_{k} as materialized (select sqrt(sum(w * pow(l - a * x1 - b * y1 - c * z1, 2)) / (count(*) - 3)) g1 from w_{k}, c_{k})",
            f"fit_{k} as materialized (select case when fin then x0 else x1 end x, case when fin then y0 else y1 end y, case when fin then z0 else z1 end z, case when fin then g0 else g1 end g, "
            f"fin or pow(g1 / before, 2) * (n - 3) between {large('(n - 3)', -1.959963984540054)} and {large('(n - 3)', 1.959963984540054)} fin from c_{k}, g_{k})",
        ]
    return ", ".join(parts) + f" select round(x, 6) wx, round(y, 6) wy, round(z, 6) wz, round(g * 1000, 6) rms_mm, (select count(*) from stations)::bigint n from fit_{PASSES}"


@query(f"{with_('stations')}, {euler_sql()}")
def plate_rotation_with_outliers(spark, sf):
    """N8 with E13: stations wrong by 1 m/yr do not move the pole."""
    m = moving("spark")
    st = rows(spark, sf, "stations").drop("auto_x", "auto_y", "auto_z").selectExpr("*", *[f"{x}" for x in m["place"].split(", ")]).selectExpr("*", *m["velocity"].split(", "))
    pole = alignment.euler_pole(st)
    values = (*[round(float(pole[k]) * 1e9, 6) for k in ("wx", "wy", "wz")], round(pole["rms"] * 1000, 6), pole["n"])
    return spark.createDataFrame([values], "wx double, wy double, wz double, rms_mm double, n long")


@query(
    f"""{with_('stations', 'solutions')}, s as (select solution_id, st.NetworkCode, case when solution_id % 11 = 0 then concat('s', lpad(cast(st.k + 7 as varchar), 6, '0')) else st.StationCode end StationCode, lat + (solution_id % 5) * 4e-5 lat, lon from solutions join stations st using (NetworkCode, StationCode)),
near as (select a.solution_id, a.NetworkCode = b.NetworkCode and a.StationCode = b.StationCode own, b.NetworkCode bn, b.StationCode bs, {HAVERSINE} d from s a join stations b on abs(a.lat - b.lat) < 0.001 where {HAVERSINE} <= coalesce(b.max_dist, 20) / 1000),
seen as (select solution_id, count(*) n, bool_or(own) has_own, arg_min(own, d) best_own, min(d) d from near group by 1)
select solution_id, round(d, 5) distance_km, case when n is null then 'none' when has_own and best_own then 'matched' when n = 1 then 'renamed' else 'several' end verdict from s left join seen using (solution_id)"""
)
def solutions_matched(spark, sf):
    """Q1: each solution against the stations within their own radius; some are put under another code, some moved aside."""
    st = rows(spark, sf, "stations")
    place = rows(spark, sf, "solutions").join(st.select(*KEY, "k", "lat", "lon"), KEY)
    other = F.concat(F.lit("s"), F.lpad((F.col("k") + 7).cast("string"), 6, "0"))
    moved = place.withColumns({"StationCode": F.when(F.col("solution_id") % 11 == 0, other).otherwise(F.col("StationCode")), "lat": F.col("lat") + F.col("solution_id") % 5 * 4e-5})
    # several solutions of a station may fall on one day: a solution is known by its number
    own = moved.select(*KEY, F.col("solution_id").alias("Year"), F.lit(0).alias("DOY"), "lat", "lon")
    return joins.match_stations(own, st).select(F.col("Year").alias("solution_id"), F.round("distance_km", 5).alias("distance_km"), "verdict")


SAME = ("ReceiverCode", "ReceiverSerial", "AntennaCode", "AntennaSerial", "RadomeCode")
EQUIPMENT = "*, ReceiverSerial as ReceiverCode, AntennaCode as AntennaSerial"


@query(
    f"""{with_('sessions')}, x as (select {EQUIPMENT} from sessions), current as (select * from x where priority <> '1-URGENT'), new as (select * from x where priority = '1-URGENT'),
hit as (select distinct n.session_id from new n join current c using (NetworkCode, StationCode) where c.DateEnd is not null and c.DateStart < coalesce(n.DateEnd, timestamp '{joins.FAR}') and c.DateEnd > n.DateStart),
every as (select * from current union all select * from new where session_id not in (select session_id from hit)),
closed as (select * replace (case when DateEnd is null and lead(DateStart) over w is not null then lead(DateStart) over w - interval 1 second else DateEnd end as DateEnd),
    row_number() over w n, lag(DateStart) over w before, {' and '.join(f'{c} is not distinct from lag({c}) over w' for c in SAME)} alike from every window w as (partition by NetworkCode, StationCode order by DateStart)),
joined as (select *, alike and n = 2 as taken from closed), gone as (select *, n = 1 and coalesce(lead(taken) over (partition by NetworkCode, StationCode order by DateStart), false) absorbed from joined)
select session_id, epoch(case when taken then before else DateStart end)::bigint s, epoch(DateEnd)::bigint e, 'kept' what from gone where not absorbed union all select session_id, epoch(DateStart)::bigint, epoch(DateEnd)::bigint, 'refused' from new where session_id in (select session_id from hit)"""
)
def equipment_inserted(spark, sf):
    """Q8: urgent records inserted among the others of their station."""
    x = rows(spark, sf, "sessions").withColumns({"ReceiverCode": F.col("ReceiverSerial"), "AntennaSerial": F.col("AntennaCode")})
    kept, refused = quality.insert_sessions(x.filter("priority <> '1-URGENT'"), x.filter("priority = '1-URGENT'"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    one = lambda df, what: df.select("session_id", seconds("DateStart").alias("s"), seconds("DateEnd").alias("e"), F.lit(what).alias("what"))
    return one(kept, "kept").union(one(refused, "refused"))


def quakes_(engine: str) -> str:
    """Each nation as an earthquake; one in five without nodal planes, one in three with one plane only."""
    k, nan = "n_nationkey", "cast('nan' as double)"
    plane = lambda v, gone: f"case when {gone} then {nan} else cast({v} as double) end"
    none, one = f"{k} % 5 = 4", f"({k} % 5 = 4 or {k} % 3 = 1)"
    return f"""select {k} as id, ({k} * 53 % 1200) / cast(10 as double) - 60 as lat, ({k} * 71 % 3599) / cast(10 as double) - 179.9 as lon, 6.5 + {k} % 9 / cast(5 as double) as mag, cast(5 + {k} % 7 * 6 as double) as depth,
{plane(f'{k} * 37 % 360', none)} as strike1, {plane(f'case when {k} % 6 = 0 then 90 else 10 + {k} * 7 % 75 end', none)} as dip1, {plane(f'{k} * 29 % 360 - 180', none)} as rake1,
{plane(f'{k} * 59 % 360', one)} as strike2, {plane(f'15 + {k} * 11 % 70', one)} as dip2, {plane(f'{k} * 43 % 360 - 180', one)} as rake2 from nation"""


def quakes(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("driftline_nation")
    return spark.sql(quakes_("spark").replace("from nation", "from driftline_nation"))


def okada_sql(source: str) -> str:
    """CTEs to moved (pid, plane, n, e, u) from source (pid, plane, e_m, n_m, depth_m, mag, strike, dip, rake), after Okada (1985), one corner of the fault a row."""
    size = lambda k: f"pow(10.0, {geodesy.FAULT[k][0]} + {geodesy.FAULT[k][1]} * mag) * {geodesy.FAULT[k][2]}"
    return f"""fault as (select *, {size('along_strike_m')} len, {size('down_dip_m')} wid, {size('mean_slip_m')} slip, sin(radians(dip)) sd, case when abs(cos(radians(dip))) < 1e-9 then 0.0 else cos(radians(dip)) end cd, radians(strike) st from ({source})),
turned as (select *, e_m * sin(st) + n_m * cos(st) + len / 2 x, n_m * sin(st) - e_m * cos(st) + wid / 2 * cd y, depth_m + wid / 2 * sd c from fault),
set_up as (select *, y * cd + c * sd p, y * sd - c * cd q from turned),
corner as (select *, x - fx * len xi, p - fe * wid eta from set_up, (values (0, 0, 1), (0, 1, -1), (1, 0, -1), (1, 1, 1)) f(fx, fe, sign)),
ray as (select *, sqrt(xi * xi + eta * eta + q * q) r, eta * cd + q * sd yt, eta * sd - q * cd dt, sqrt(xi * xi + q * q) xq from corner),
logs as (select *, greatest(r + eta, 1e-12) re, greatest(r + xi, 1e-12) rx, r + dt rd, case when abs(q) < 1e-9 then 0 else atan(xi * eta / (q * r)) end th from ray),
inner1 as (select *, case when cd = 0 then -0.5 * q / rd else 0.5 / cd * (ln(rd) - sd * ln(re)) end i4, case when cd = 0 then -0.5 * xi * sd / rd when abs(xi) < 1e-9 then 0 else 1.0 / cd * atan((eta * (xq + q * cd) + xq * (r + xq) * sd) / (xi * (r + xq) * cd)) end i5 from logs),
inner2 as (select *, case when cd = 0 then 0.25 * (eta / rd + yt * q / rd ** 2 - ln(re)) else 0.5 * (yt / (cd * rd) - ln(re)) + sd / cd * i4 end i3, case when cd = 0 then -0.25 * xi * q / rd ** 2 else -0.5 * xi / (cd * rd) - sd / cd * i5 end i1 from inner1),
inner3 as (select *, -0.5 * ln(re) - i3 i2, slip * cos(radians(rake)) ss, slip * sin(radians(rake)) ds from inner2),
parts as (select pid, plane, st, sign, ss * (xi * q / (r * re) + th + i1 * sd) + ds * (q / r - i3 * sd * cd) u1, ss * (yt * q / (r * re) + q * cd / re + i2 * sd) + ds * (yt * q / (r * rx) + cd * th - i1 * sd * cd) u2,
    ss * (dt * q / (r * re) + q * sd / re + i4 * sd) + ds * (dt * q / (r * rx) + sd * th - i5 * sd * cd) u3 from inner3),
whole as (select pid, plane, any_value(st) st, -sum(sign * u1) / (2 * pi()) u1, -sum(sign * u2) / (2 * pi()) u2, -sum(sign * u3) / (2 * pi()) u3 from parts group by pid, plane),
moved as (select pid, plane, u1 * cos(st) + u2 * sin(st) n, u1 * sin(st) - u2 * cos(st) e, u3 u from whole)"""


DEEP = "greatest({d}, case when isnan(dip1) then 0 else pow(10.0, -1.01 + 0.32 * mag) * 1000 / 2 * sin(radians(dip1)) + 500 end)"
DEEPER = f"greatest({DEEP}, pow(10.0, -1.01 + 0.32 * mag) * 1000 / 2 * sin(radians(dip2)) + 500)"


def both_planes(source: str, depth: str) -> str:
    """Rows of source once for each nodal plane that is given; the fault is put deeper where it would come out of the ground."""
    one, two = DEEP.replace("{d}", depth), DEEPER.replace("{d}", depth)
    return f"select pid, 1 plane, e_m, n_m, {one} depth_m, mag, strike1 strike, dip1 dip, rake1 rake from {source} where not isnan(strike1) union all select pid, 2, e_m, n_m, {two}, mag, strike2, dip2, rake2 from {source} where not isnan(strike2)"


@query(
    f"""with q as ({quakes_('duck')}), pairs as (select c_custkey pid, (c_custkey * 17 % 400 - 200)::double * 1000 e_m, (c_custkey * 23 % 300 - 150)::double * 1000 n_m, q.* from customer join q on id = c_custkey % 25),
{okada_sql(both_planes('pairs', 'depth * 1000'))}, best as (select pid, arg_max((n, e, u), (sqrt(n * n + e * e + u * u), -plane)) d from moved group by pid)
select pid as c_custkey, round(coalesce(d[1], 0), 7) d_n, round(coalesce(d[2], 0), 7) d_e, round(coalesce(d[3], 0), 7) d_u from pairs left join best using (pid)"""
)
def ground_displacements(spark, sf):
    """What each of some places about an event moves by."""
    k = F.col("c_custkey")
    places = table(spark, sf, "customer").select(k, (k * 17 % 400 - 200).cast("double").alias("x_km"), (k * 23 % 300 - 150).cast("double").alias("y_km"), (k % 25).alias("id"))
    moved = masks.displacements(places.join(quakes(spark, sf), "id"))
    return moved.select("c_custkey", *[F.round(f"d_{c}", 7).alias(f"d_{c}") for c in "neu"])


GRID = 60


def mask_sql() -> str:
    half = "ceil(pow(10.0, -3.22 + 0.69 * mag) * 1000) * 25"
    grid = f"select *, {half} half_m, 2 * {half} / ({GRID} - 1) step_m, pow(10.0, {geodesy.SCORE_A} * mag + {geodesy.SCORE_B}) reach from q"
    cells = f"select id * {GRID * GRID * 2} + i * {GRID * 2} + j * 2 + deep pid, g.*, i, j, deep, i * step_m - half_m e_m, j * step_m - half_m n_m, case deep when 1 then depth * 1000 else 0 end own_m from g, range({GRID}) a(i), range({GRID}) b(j), range(2) c(deep)"
    return f"""q as ({quakes_('duck')}), g as ({grid}), cells as materialized ({cells}), {okada_sql(both_planes('cells', 'own_m'))},
hit as materialized (select pid, bool_or(sqrt(n * n + e * e + u * u) >= {masks.LIMIT_M}) m from moved group by pid),
marked as materialized (select c.*, coalesce(m, false) m, sqrt(e_m * e_m + n_m * n_m) away, isnan(strike1) and isnan(strike2) plain from cells c left join hit using (pid)),
far as (select id, max(away) filter (m) far from marked group by id),
mask as materialized (select id, i, j, case when plain then away < reach * 1000 else m end during, case when plain then away < reach * 1500 else m end after_ from marked where deep = 1),
frames as (select g.*, case when isnan(strike1) and isnan(strike2) then 1000 else far / reach end during_m, case when isnan(strike1) and isnan(strike2) then 1000 else far / reach / {geodesy.AFTER_FACTOR} end after_m from g join far using (id) where far is not null or (isnan(strike1) and isnan(strike2)))"""


def at_cell(km: str, metres: str) -> str:
    return f"least(greatest(round(({km} * {metres} + half_m) / step_m), 0), {GRID - 1})::int"


@query(
    f"""with {mask_sql()}, p as ({catalogue.PLACES}), pairs as (select a.id station, b.id event, {HAVERSINE} d, 2 * 6371.0 * asin(1) half, radians(a.lat) p1, radians(b.lat) p0, radians(a.lon - b.lon) dl, b.* exclude (id) from p a join frames b on true),
near as (select *, acos(greatest(least(sin(p0) * sin(p1) + cos(p0) * cos(p1) * cos(dl), 1), -1)) c from pairs where d <= reach * 1.5 and {geodesy.SCORE_A} * mag - log10(greatest(d, 1e-3)) + {geodesy.SCORE_B} + log10(1.5) > 0),
flat as (select *, case when abs(sin(c)) < 1e-12 then 1 else c / sin(c) end * 6371 * cos(p1) * sin(dl) x, case when abs(sin(c)) < 1e-12 then 1 else c / sin(c) end * 6371 * (cos(p0) * sin(p1) - sin(p0) * cos(p1) * cos(dl)) y from near)
select station, event, case when a.during then 'both' else 'decay' end kind from flat
left join mask a on a.id = event and a.during and a.i = {at_cell('x', 'during_m')} and a.j = {at_cell('y', 'during_m')} left join mask b on b.id = event and b.after_ and b.i = {at_cell('x', 'after_m')} and b.j = {at_cell('y', 'after_m')} where a.during or b.after_"""
)
def stations_in_masks(spark, sf):
    """Each customer as a station against the level-2 masks of all events."""
    st = catalogue.places(spark, sf).withColumnRenamed("id", "station")
    found = masks.masked_pairs(st, quakes(spark, sf), density=GRID)
    return found.select("station", F.col("id").alias("event"), "kind")


@query(
    """with cells as (select distinct l_linenumber k, l_partkey % 40 i, l_suppkey % 31 j from lineitem where l_quantity < 20), sq as (select k, i - a i, j - b j, sum(bit) bits, count(*) n from cells, (values (0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)) c(a, b, bit) group by all),
area as (select k, sum(case n when 1 then 0.125 when 3 then 0.875 when 4 then 1.0 when 2 then case when bits in (5, 10) then 0.25 else 0.5 end end) area, count(*) filter (n < 4) + count(*) filter (bits in (5, 10)) corners, count(*) filter (n = 4) full_ from sq group by 1),
shape as (select k, count(*) n, (select count(*) from cells b join cells c on c.k = b.k and c.j = b.j and c.i = b.i + 1 where b.k = a.k) + (select count(*) from cells b join cells c on c.k = b.k and c.i = b.i and c.j = b.j + 1 where b.k = a.k) pairs from cells a group by 1)
select k, corners, round(area, 3) area, (n - pairs + full_)::bigint outer_less_holes from area join shape using (k)"""
)
def outlines_of_cells(spark, sf):
    """K6: rings around scattered cells: their corners, the area they hold, and outer rings less holes."""
    li = table(spark, sf, "lineitem").filter("l_quantity < 20")
    cells = li.select(F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 31).alias("j")).distinct()
    rings = masks.outlines(cells, ["k"])
    areas = masks.ring_areas(rings, ["k"]).groupBy("k").agg(F.round(F.sum("area"), 3).alias("area"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes"))
    return rings.groupBy("k").agg(F.count("*").alias("corners")).join(areas, "k")


@query()
def mask_outlines(spark, sf):
    """K6: the outlines of the level-2 masks of all events, as KML placemarks; tests check rings, areas and text."""
    events = quakes(spark, sf)
    cells, frames = masks.level2_masks(events, GRID)
    return masks.mask_placemarks(masks.mask_polygons(cells, frames, events), F.col("id").cast("string"))


def network_days(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's customers on the globe, moved by the day's own rotation and shift, by a plate's motion and by a step."""
    k = F.col("k")
    st = rows(spark, sf, "stations").select(*KEY, "k", "lat", "lon")
    on = geodesy.on_sphere(F.col("lat"), F.col("lon"), 6371000.0)
    day = (k * 31 + F.col("d") * 17) % 10 < 7
    own = st.withColumns({"p": on, "d": F.explode(F.sequence(F.lit(0), F.lit(11)))}).filter(day)
    t = F.col("d") / 12.0
    noise = lambda m: ((k * m + F.col("d") * 29) % 201 - 100) * 1e-5
    step = F.when(F.col("d") >= 6, F.when(k % 9 == 0, 0.05).otherwise(0.0)).otherwise(0.0)
    x, y, z = (F.col(f"p.{c}") for c in "xyz")
    turn = (F.col("d") % 5 - 2) * 1e-9
    moved = {"X": x + 0.02 * t + noise(37) + step - turn * y + 0.003 * F.col("d"), "Y": y - 0.01 * t + noise(53) + turn * x, "Z": z + 0.01 * t + noise(71) - 0.002 * F.col("d")}
    return own.select(*KEY, F.lit(2020).alias("Year"), (1 + F.col("d") * 30).cast("int").alias("DOY"), *[v.alias(c) for c, v in moved.items()])


@query()
def days_fitted(spark, sf):
    """The transformation of each day to the stations' mean places; tests check it against a plain robust fit."""
    days = network_days(spark, sf)
    mean = alignment.mean_positions(days)
    return alignment.helmert(days, days.select(*KEY, *alignment.DAY).join(mean, KEY))


@query()
def stack_aligned(spark, sf):
    """The days aligned to the stations' trajectories; tests check that what days have in common is gone."""
    return alignment.align_stack(network_days(spark, sf), passes=2)


@query()
def days_chained(spark, sf):
    """Each day aligned to the one before; tests check it against the same product of fits, one after the other."""
    return alignment.chain(network_days(spark, sf))


# upkeep of one table by the changes of another


def states(engine_sessions, engine_files):
    """The same rows before and after some are gone, some new and some altered."""
    before = engine_sessions.filter("session_id % 5 <> 0"), engine_files.filter("file_id % 3 <> 0 or k_file % 9 = 1")
    changed = F.when(F.col("session_id") % 97 == 0, F.col("hash") + 1).otherwise(F.col("hash"))
    return before, (engine_sessions.filter("session_id % 5 <> 0 or session_id % 35 = 0").filter("session_id % 41 <> 3").withColumn("hash", changed), engine_files.filter("file_id % 3 <> 0 or k_file % 9 = 1").filter("file_id % 53 <> 7"))


@query(
    f"""{with_('stations', 'sessions', 'files')}, f0 as (select *, file_id % 1000 k_file from files), fb as (select * from f0 where file_id % 3 <> 0 or k_file % 9 = 1), fa as (select * from fb where file_id % 53 <> 7),
sb as (select * from sessions where session_id % 5 <> 0), sa as (select * replace (case when session_id % 97 = 0 then hash + 1 else hash end as hash) from sessions where (session_id % 5 <> 0 or session_id % 35 = 0) and session_id % 41 <> 3),
cs as (select NetworkCode, StationCode from ((select * from sb except select * from sa) union all (select * from sa except select * from sb))), cf as (select NetworkCode, StationCode from ((select * from fb except select * from fa) union all (select * from fa except select * from fb)))
select NetworkCode, StationCode, (NetworkCode, StationCode) in (select (NetworkCode, StationCode) from cs union select (NetworkCode, StationCode) from cf) has_gaps_update_needed, (NetworkCode, StationCode) in (select (NetworkCode, StationCode) from sa) has_stationinfo from stations"""
)
def flags_after_changes(spark, sf):
    """Station flags kept up by the changes to equipment records and files; the oracle computes them from nothing."""
    files = rows(spark, sf, "files").withColumn("k_file", F.col("file_id") % 1000)
    (sb, fb), (sa, fa) = states(rows(spark, sf, "sessions"), files)
    had = sb.select(*KEY).distinct().withColumn("had", F.lit(True))
    meta = rows(spark, sf, "stations").select(*KEY).join(had, KEY, "left").select(*KEY, F.lit(False).alias("has_gaps_update_needed"), F.col("had").isNotNull().alias("has_stationinfo"))
    return upkeep.kept_flags(meta, upkeep.changes(fb, fa, [*KEY, "file_id"]), upkeep.changes(sb, sa, [*KEY, "session_id"]), sa)


@query(
    """with gone as (select c_custkey from customer where c_custkey % 13 = 0), o as (select * from orders where o_custkey not in (select c_custkey from gone)), l as (select * from lineitem where l_orderkey in (select o_orderkey from o) or l_orderkey not in (select o_orderkey from orders))
select 'customer' name, count(*) n, sum(c_custkey)::bigint total from customer where c_custkey % 13 <> 0 union all select 'orders', count(*), sum(o_orderkey)::bigint from o union all select 'lineitem', count(*), sum(l_orderkey)::bigint from l"""
)
def rows_left_by_cascade(spark, sf):
    """Deleting customers takes their orders along, and the lines of these."""
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    links = [upkeep.Link("orders", ("o_custkey",), "customer", ("c_custkey",)), upkeep.Link("lineitem", ("l_orderkey",), "orders", ("o_orderkey",))]
    left = upkeep.cascade(tables, "customer", tables["customer"].filter("c_custkey % 13 = 0"), links)
    one = lambda n, c: left[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(c).cast("long").alias("total"))
    return one("customer", "c_custkey").union(one("orders", "o_orderkey")).union(one("lineitem", "l_orderkey"))


@query(
    """with recursive e as (select event_id, epoch(ts) * 60 d, value from events), w as (select min(d) s from e union all select (select min(d) from e where d > w.s + 15 * 86400) from w where s is not null),
n as (select s, lead(s) over (order by s) nxt from w where s is not null) select arg_max(event_id, (value, -d, -event_id)) event_id from n join e on d >= s and (nxt is null or d < nxt) group by s"""
)
def strongest_of_all(spark, sf):
    """W10 where one key holds all events; minutes stand for seconds, so that there are many windows."""
    e = table(spark, sf, "events").select(F.lit(1).alias("k"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * 60).alias("d"), "value")
    return windows.strongest_in_window(e, ["k"], "d", "value", 15 * 86400.0).select("event_id")
