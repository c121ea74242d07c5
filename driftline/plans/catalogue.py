"""Registered queries of the relational operators on the driver's tables, each with its DuckDB oracle.

`customer` stands for a station, `orders` and `lineitem` for observation files, `events` for a series by user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import arrays, calendar, geodesy, text
from driftline.operators import archive, joins, selection, trajectory, windows
from driftline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily mean value of each user, t in days since 2024-01-01."""
    d = events(spark, sf).groupBy("user_id", "day").agg(F.avg("value").alias("v"))
    return d.withColumn("t", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double"))


DAILY = """daily as (select user_id, ts::date as day, avg(value) v, date_diff('day', date '2024-01-01', ts::date)::double t from events group by all)"""


@query(
    """select a.* exclude (l_shipdate), a.l_shipdate from lineitem a
where not exists (select 1 from lineitem b where b.l_partkey = a.l_partkey and b.l_suppkey = a.l_suppkey and b.l_quantity > a.l_quantity)
qualify l_linenumber = min(l_linenumber) over (partition by l_partkey, l_suppkey)"""
)
def best_file_per_day(spark, sf):
    return archive.best_files(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity", "l_linenumber")


@query("select o_custkey, min(o_orderdate) as first_day, max(o_orderdate) as last_day from orders group by 1")
def key_timespan(spark, sf):
    span = archive.time_span(table(spark, sf, "orders"), "o_orderdate", ["o_custkey"])
    return span.select("o_custkey", F.col("DateStart").alias("first_day"), F.col("DateEnd").alias("last_day"))


@query(
    """with f as (select o_custkey, count(*) n_files from orders group by 1),
s as (select o_custkey, count(*) n_solutions from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1)
select f.o_custkey, n_files, coalesce(n_solutions, 0) n_solutions, round(100.0 * coalesce(n_solutions, 0) / n_files, 6)::double as percent from f left join s using (o_custkey)"""
)
def completeness_ratio(spark, sf):
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    solved = orders.join(lines, "o_orderkey", "left_semi")
    return archive.completeness(orders, solved, ["o_custkey"]).withColumn("percent", F.round("percent", 6))


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def orphans_anti(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.without_solution(table(spark, sf, "customer"), orders, ["c_custkey"], F.col("o_totalprice") > 400000).select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')")
def anti_with_condition(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.without_solution(table(spark, sf, "orders"), lines, ["o_orderkey"], F.col("l_returnflag") == "A").select("o_orderkey", "o_custkey")


@query(
    """select distinct day::varchar as day from (select o_custkey, o_orderdate::date as day from orders where o_orderpriority = '1-URGENT'
except select o_custkey, o_orderdate::date from orders where o_orderstatus = 'O')"""
)
def except_then_days(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    keys = ["o_custkey", "day"]
    return selection.missing_keys(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderstatus = 'O'"), keys).select(F.col("day").cast("string")).distinct()


@query("select day::varchar as day from (select o_orderdate::date as day from orders where o_orderstatus = 'F' union select l_shipdate::date from lineitem where l_linestatus = 'O')")
def union_days(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderdate").cast("date").alias("day"))
    b = table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_shipdate").cast("date").alias("day"))
    return selection.all_days(a, b, ["day"]).select(F.col("day").cast("string"))


@query("select c_custkey as k from customer intersect select o_custkey from orders where o_totalprice > 100000")
def common_keys(spark, sf):
    key = lambda c: (F.lit("n").alias("NetworkCode"), F.col(c).alias("StationCode"))
    orders = table(spark, sf, "orders").filter("o_totalprice > 100000").select(*key("o_custkey"))
    return selection.common_stations(table(spark, sf, "customer").select(*key("c_custkey")), orders).select(F.col("StationCode").alias("k"))


@query(
    """select o_orderkey, year(o_orderdate)::integer as year, dayofyear(o_orderdate)::integer as doy from orders
where year(o_orderdate) * 1000 + dayofyear(o_orderdate) between 1994300 and 1996045"""
)
def row_value_range(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"))
    return selection.day_range(o, (1994, 300), (1996, 45), "year", "doy")


@query(
    """select o_orderkey from orders where (year(o_orderdate), dayofyear(o_orderdate)) not in
(select year(l_shipdate), dayofyear(l_shipdate) from lineitem where l_quantity > 49)"""
)
def row_value_not_in(spark, sf):
    day = lambda c: (F.year(c).alias("y"), F.dayofyear(c).alias("d"))
    o = table(spark, sf, "orders").select("o_orderkey", *day("o_orderdate"))
    return selection.without_days(o, table(spark, sf, "lineitem").filter("l_quantity > 49").select(*day("l_shipdate")), ["y", "d"]).select("o_orderkey")


@query(
    """select p_partkey, p_type from part where (regexp_full_match(p_type, '.*(DARD|MO)') or regexp_full_match(p_type, '[E-S].*M.'))
and not regexp_full_match(p_type, '.*CON.*')"""
)
def wildcard_select(spark, sf):
    p, t = table(spark, sf, "part"), F.col("p_type")
    wanted = text.similar_to(t, "%(DARD|MO)") | text.similar_to(t, "[E-S]%M_")
    return p.filter(wanted & ~text.similar_to(t, "%CON%")).select("p_partkey", "p_type")


@query("select p_brand, count(*) n from part group by 1 having count(*) > 60")
def having_duplicates(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).filter("n > 60")


@query("select distinct on (o_orderpriority) o_orderpriority, o_orderkey, o_orderdate from orders order by o_orderpriority, o_orderdate, o_orderkey")
def distinct_on_first(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return selection.first_of_each(o, ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query(
    """select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) n, count(*) over (partition by user_id) c from events)
where n % greatest(c // 10, 1) = 0"""
)
def even_sample_10(spark, sf):
    return archive.even_sample(table(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as row from orders")
def global_row_number(spark, sf):
    return archive.numbered(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("row").cast("long"))


@query("select doc_id, row_number() over (order by n_chars, doc_id) as row, length(text) n from documents")
def numbered_documents(spark, sf):
    """W3 with a wide payload, whose ranges differ in size."""
    d = archive.numbered(table(spark, sf, "documents").select("doc_id", "n_chars", "text", "lang", "source"), ["n_chars", "doc_id"])
    return d.select("doc_id", F.col("row").cast("long"), F.length("text").cast("long").alias("n"))


@query(
    f"""with {DAILY} select user_id, t, round(v - lag(v) over w, 6) d_v, t - lag(t) over w d_t from daily window w as (partition by user_id order by t)"""
)
def day_lag_diff(spark, sf):
    d = windows.lag_difference(daily(spark, sf), ["user_id"], "t", ["v"])
    return d.select("user_id", "t", F.round("d_v", 6).alias("d_v"), "d_t")


@query(
    f"""with {DAILY}, m as (select *, case when t - lag(t) over (partition by user_id order by t) > 2 then 1 else 0 end j from daily),
i as (select *, sum(j) over (partition by user_id order by t) island from m)
select user_id, island::bigint island, min(day)::varchar as first, max(day)::varchar as last, count(*) n from i group by 1, 2"""
)
def gap_islands(spark, sf):
    i = windows.islands(daily(spark, sf), ["user_id"], "t", 2)
    return i.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count("*").alias("n"))


@query(f"""with {DAILY} select user_id, t as last, nxt as next, nxt - t - 1 gap_days from (select *, lead(t) over (partition by user_id order by t) nxt from daily) where nxt - t - 1 >= 3""")
def data_gaps(spark, sf):
    return windows.gaps(daily(spark, sf), ["user_id"], "t", 3)


@query(
    """with d as (select distinct user_id, ts::date as day from events), s as (select user_id, min(day) lo, max(day) hi from d group by 1),
e as (select user_id, unnest(generate_series(lo, hi, interval 1 day))::date as day from s)
select user_id, day::varchar as day from e anti join d using (user_id, day)"""
)
def missing_days(spark, sf):
    return selection.missing_days(events(spark, sf).select("user_id", "day"), ["user_id"], "day").select("user_id", F.col("day").cast("string"))


@query(
    """select event_id, user_id, event_type from (select *, lag(event_type) over w p, row_number() over w n from events window w as (partition by user_id order by ts, event_id))
where n > 1 and event_type is distinct from p"""
)
def session_change(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return windows.changes(e, ["user_id"], "at", ["event_type"]).select("event_id", "user_id", "event_type")


@query(
    """with m as (select *, case when lag(event_type) over (partition by user_id order by event_id) is distinct from event_type then 1 else 0 end j from events),
r as (select *, sum(j) over (partition by user_id order by event_id) k from m)
select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) n from r group by user_id, event_type, k"""
)
def value_runs(spark, sf):
    return windows.runs(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type"])


@query(
    """with s as (select o_custkey k, o_orderkey, o_orderdate start, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) stop from orders where o_orderstatus = 'F'),
p as (select o_custkey k, o_orderkey p_key, o_orderdate t from orders where o_orderstatus = 'O')
select p_key, arg_min(o_orderkey, (start, o_orderkey)) session_key from p join s using (k) where t >= start and (stop is null or t <= stop) group by 1"""
)
def interval_lookup(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    nxt = F.lead("o_orderdate").over(Window.partitionBy("k").orderBy("o_orderdate", "o_orderkey"))
    sessions = o.filter("o_orderstatus = 'F'").withColumn("DateEnd", nxt).select("k", F.col("o_orderkey").alias("session_key"), F.col("o_orderdate").alias("DateStart"), "DateEnd")
    points = o.filter("o_orderstatus = 'O'").select("k", F.col("o_orderkey").alias("p_key"), F.col("o_orderdate").alias("t"))
    found = joins.valid_at(points, sessions.withColumn("order", F.struct("DateStart", "session_key")), ["k"], "t")
    return found.select("p_key", "session_key")


@query(
    """with s as (select o_custkey k, o_orderkey id, o_orderdate s, o_orderdate + interval 20 day e from orders)
select a.k, a.id id_a, b.id id_b, epoch(least(a.e, b.e))::bigint - epoch(greatest(a.s, b.s))::bigint shared_s
from s a join s b on a.k = b.k and (a.s, a.e, a.id) < (b.s, b.e, b.id) where least(a.e, b.e) > greatest(a.s, b.s)"""
)
def interval_overlap(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderdate").alias("s"), F.col("o_orderkey").alias("id")).alias("x"), (F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS")).alias("e"))
    flat = s.select("k", F.col("x.s").alias("DateStart"), F.col("e").alias("DateEnd"), F.col("x.id").alias("id"))
    both = joins.overlaps(flat, ["k"], carry=("id",))
    # orders of one day last equally long: the smaller id is the first
    swap = (F.col("DateStart_a") == F.col("DateStart_b")) & (F.col("id_a") > F.col("id_b"))
    first, second = F.when(swap, F.col("id_b")).otherwise(F.col("id_a")), F.when(swap, F.col("id_a")).otherwise(F.col("id_b"))
    return both.select("k", first.alias("id_a"), second.alias("id_b"), "shared_s")


PLACES = "select c_custkey id, (c_custkey * 37 % 1200) / 10.0 - 60 lat, (c_custkey * 91 % 3599) / 10.0 - 179.9 lon from customer"
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def places(spark: SparkSession, sf: str, **more: str) -> DataFrame:
    """Customers as places; more: names of further columns and what they are in the table."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), ((k * 37 % 1200) / 10.0 - 60).alias("lat"), ((k * 91 % 3599) / 10.0 - 179.9).alias("lon"), *[F.col(c).alias(name) for name, c in more.items()])


@query(f"with p as ({PLACES}) select a.id, b.id r_id, round({HAVERSINE}, 4) distance_km from p a join p b on a.id < b.id where {HAVERSINE} <= 420.05")
def radius_match(spark, sf):
    p = places(spark, sf)
    return joins.within_km(p, p, 420.05, only="id < r_id").select("id", "r_id", F.round("distance_km", 4).alias("distance_km"))


@query(
    f"""with p as ({PLACES}), d as (select a.id, {HAVERSINE} d from p a join p b on a.id <> b.id)
select id, round(min(d), 4) distance_km from d group by 1"""
)
def nearest_place(spark, sf):
    """J13 over the whole table in both roles: each customer with the distance of the nearest other one."""
    p = places(spark, sf)
    found = joins.nearest(p, p, ["id"], only="id <> r_id")
    return found.select("id", F.round("distance_km", 4).alias("distance_km"))


@query(
    f"""with p as ({PLACES.replace(' from customer', ', c_nationkey net from customer')}),
d as (select a.id, b.id r_id, {HAVERSINE} d from p a join p b on a.net = b.net and a.id <> b.id)
select id, round(min(d), 4) distance_km from d group by 1"""
)
def nearest_of_network(spark, sf):
    """Each customer with the distance of the nearest other one of its nation."""
    p = places(spark, sf, net="c_nationkey")
    found = joins.nearest(p, p, ["id"], only=lambda point, place: point("id") != place("id"), same=("net",))
    return found.select("id", F.round("distance_km", 4).alias("distance_km"))


@query(
    f"""with p as ({PLACES.replace(' from customer', ', c_mktsegment kind from customer')}),
d as (select a.id, {HAVERSINE} d from p a join p b on a.kind < b.kind)
select id, round(min(d), 4) distance_km from d group by 1"""
)
def nearest_of_later_kind(spark, sf):
    """Each customer with the distance of the nearest one whose segment comes later in the alphabet; the last has none."""
    p = places(spark, sf, kind="c_mktsegment")
    return joins.nearest(p, p, ["id"], later="kind").select("id", F.round("distance_km", 4).alias("distance_km"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("event_id"), ((k * 53 % 1200) / 10.0 - 60).alias("lat"), ((k * 71 % 3599) / 10.0 - 179.9).alias("lon"))


SITES = "select s_suppkey event_id, (s_suppkey * 53 % 1200) / 10.0 - 60 lat, (s_suppkey * 71 % 3599) / 10.0 - 179.9 lon from supplier"


@query(f"with p as ({PLACES}), s as ({SITES}) select id, round(min({HAVERSINE}), 4) distance_km from p a join s b on true group by 1")
def nearest_site(spark, sf):
    """J13 over whole tables: each customer with the distance of its nearest supplier."""
    found = joins.nearest(places(spark, sf), sites(spark, sf), ["id"])
    return found.select("id", F.round("distance_km", 4).alias("distance_km"))


@query(
    f"""with p as ({PLACES}), q as (select n_nationkey event_id, (n_nationkey * 53 % 1200) / 10.0 - 60 lat, (n_nationkey * 71 % 3599) / 10.0 - 179.9 lon, 6 + n_nationkey % 40 / 10.0 mag from nation),
s as (select a.id, b.event_id, {HAVERSINE} d, mag from p a join q b on true)
select id, event_id, round(0.5261 * mag - log10(greatest(d, 1e-3)) - 1.1478, 5) score from s where 0.5261 * mag - log10(greatest(d, 1e-3)) - 1.1478 + log10(1.5) > 0.00001"""
)
def haversine_score(spark, sf):
    """J15 over whole tables: each nation is an event, up to magnitude 8.4, each customer a station."""
    from driftline.operators import seismic

    k = F.col("n_nationkey")
    quakes = table(spark, sf, "nation").select(k.alias("event_id"), ((k * 53 % 1200) / 10.0 - 60).alias("lat"), ((k * 71 % 3599) / 10.0 - 179.9).alias("lon"), (6 + k % 40 / 10.0).alias("mag"))
    hit = seismic.affected(places(spark, sf), quakes)
    return hit.filter("after_score > 0.00001").select("id", "event_id", F.round("score", 5).alias("score"))


@query(
    f"""with p as ({PLACES}), q as (select *, 5 + event_id % 40 / 10.0 mag from ({SITES})), s as (select a.id, b.event_id, {HAVERSINE} d, mag from p a join q b on true)
select id, event_id, round(0.5261 * mag - log10(greatest(d, 1e-3)) - 1.1478, 5) score from s where 0.5261 * mag - log10(greatest(d, 1e-3)) - 1.1478 + log10(1.5) > 0.00001"""
)
def site_score(spark, sf):
    """J15 over whole tables: each supplier is an event, each customer a station."""
    from driftline.operators import seismic

    quakes = sites(spark, sf).withColumn("mag", 5 + F.col("event_id") % 40 / 10.0)
    hit = seismic.affected(places(spark, sf), quakes)
    return hit.filter("after_score > 0.00001").select("id", "event_id", F.round("score", 5).alias("score"))


@query(
    """with p as (select c_custkey id, (c_custkey * 37 % 1200) / 10.0 - 60 lat, (c_custkey * 91 % 3599) / 10.0 - 179.9 lon, c_custkey % 3000 * 1.0 h from customer),
v as (select *, 1 - (1 - 1 / 298.257223563) * (1 - 1 / 298.257223563) e2 from p), w as (select *, 6378137.0 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) v from v),
x as (select id, lat, lon, h, round((v + h) * cos(radians(lat)) * cos(radians(lon)), 3) x, round((v + h) * cos(radians(lat)) * sin(radians(lon)), 3) y, round((v * (1 - e2) + h) * sin(radians(lat)), 3) z from w)
select id, x, y, z, round(lat, 6) lat, round(lon, 6) lon, round(h, 2) height from x"""
)
def geodetic_roundtrip(spark, sf):
    p = places(spark, sf).withColumn("h", (F.col("id") % 3000) * 1.0)
    x = p.withColumn("c", geodesy.earth_centred(F.col("lat"), F.col("lon"), F.col("h"), 3))
    back = x.withColumn("g", geodesy.geodetic(F.col("c.x"), F.col("c.y"), F.col("c.z")))
    r = lambda c, n: F.round(F.col(c), n)
    return back.select("id", "c.x", "c.y", "c.z", r("g.lat", 6).alias("lat"), r("g.lon", 6).alias("lon"), r("g.height", 2).alias("height"))


@query(
    f"""with p as ({PLACES}), d as (select *, id % 11 - 5.0 dx, id % 7 - 3.0 dy, id % 5 - 2.0 dz, radians(lat) a, radians(lon) o from p)
select id, round(-sin(a) * cos(o) * dx - sin(a) * sin(o) * dy + cos(a) * dz, 6) n, round(-sin(o) * dx + cos(o) * dy, 6) e,
round(cos(a) * cos(o) * dx + cos(a) * sin(o) * dy + sin(a) * dz, 6) u from d"""
)
def neu_rotation(spark, sf):
    i = F.col("id")
    d = places(spark, sf).withColumn("v", geodesy.to_neu(i % 11 - 5.0, i % 7 - 3.0, i % 5 - 2.0, F.col("lat"), F.col("lon")))
    return d.select("id", *[F.round(f"v.{c}", 6).alias(c) for c in "neu"])


@query(
    """select distinct l_shipdate::date::varchar as day, year(l_shipdate)::integer as year, dayofyear(l_shipdate)::integer as doy,
(date_diff('day', date '1980-01-06', l_shipdate::date) // 7)::integer gps_week, (date_diff('day', date '1980-01-06', l_shipdate::date) % 7)::integer gps_day,
(date_diff('day', date '1970-01-01', l_shipdate::date) + 40587)::integer mjd,
round(year(l_shipdate) + (dayofyear(l_shipdate) - 0.5::double) / case when year(l_shipdate) % 4 = 0 then 366 else 365 end, 6) fyear,
(year(l_shipdate) % 4 = 0 and year(l_shipdate) % 100 <> 0) or year(l_shipdate) % 400 = 0 leap from lineitem"""
)
def calendar_all(spark, sf):
    days = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return calendar.calendar_columns(days, "day").withColumn("day", F.col("day").cast("string"))


@query()
def crc_signed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.signed_crc32(F.col("c_name")).alias("crc"))


@query(f"with {DAILY} select user_id, count(*) n, round(regr_slope(v, t), 6) slope, round(regr_intercept(v, t), 6) intercept from daily group by 1 having count(*) > 2 and count(distinct t) > 1")
def linear_trend(spark, sf):
    """E3 with two terms and no weights, from moments: built-in aggregates only."""
    return trajectory.linear_trend(daily(spark, sf), ["user_id"], "t", "v")


@query(
    f"""with {DAILY}, f as (select user_id, regr_slope(v, t) b, regr_intercept(v, t) a, count(*) n from daily group by 1 having count(*) > 2),
r as (select user_id, day, v - a - b * t r, n from daily join f using (user_id)), s as (select user_id, sqrt(sum(r * r) / (any_value(n) - 2)) s from r group by 1)
select user_id, day::varchar as day, abs(r) > 2.5 * s outlier from r join s using (user_id)"""
)
def outlier_flag(spark, sf):
    return trajectory.outliers_one_pass(daily(spark, sf), ["user_id"], "t", "v").select("user_id", F.col("day").cast("string"), "outlier")


@query("select l_suppkey, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) iqr from lineitem group by 1")
def iqr_by_key(spark, sf):
    stats, _ = archive.residual_statistics(table(spark, sf, "lineitem").withColumn("s", F.lit(1.0)), ["l_suppkey"], "l_extendedprice", "s")
    return stats.select("l_suppkey", F.round("iqr", 4).alias("iqr"))


@query("select l_suppkey, round(corr(l_quantity, l_extendedprice), 6) r, round(covar_samp(l_quantity, l_discount), 6) c from lineitem group by 1")
def corr_by_key(spark, sf):
    c = archive.residual_covariance(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", "l_discount")
    return c.select("l_suppkey", F.round("corr_l_quantityl_extendedprice", 6).alias("r"), F.round("cov_l_quantityl_discount", 6).alias("c"))


@query("select vec_id, i::integer i, round(embedding[i + 1]::double, 6) a, round(embedding[i + 33]::double, 6) b from (select *, unnest(range(0, 32)) i from embeddings)")
def array_explode_zip(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.sequence(F.lit(0), F.lit(31)).alias("i"), F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    z = v.select("vec_id", F.explode(F.arrays_zip("i", "a", "b")).alias("z"))
    return z.select("vec_id", "z.i", F.round(F.col("z.a").cast("double"), 6).alias("a"), F.round(F.col("z.b").cast("double"), 6).alias("b"))


@query("select vec_id, round(embedding[2 * 20 + 6]::double, 6) x from embeddings")
def array_term(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.term(F.col("embedding"), 2, 5, 20).cast("double"), 6).alias("x"))


@query("select event_id, (props->>'k')::integer k from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """with o as (select o_custkey, o_orderkey, o_totalprice r, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) n from orders)
select o_custkey, o_orderkey from o where r <= 50000 or n = 1"""
)
def topn_reject_keep_best(spark, sf):
    o = table(spark, sf, "orders").withColumn("r", F.col("o_totalprice"))
    return selection.reject_but_one(o, ["o_custkey"], "r", 50000).select("o_custkey", "o_orderkey")


@query(
    """with a as (select s_suppkey, nullif(s_nationkey, 3) k from supplier), b as (select nullif(n_nationkey, 3) k, n_name from nation)
select s_suppkey, a.k, n_name from a left join b on a.k is not distinct from b.k"""
)
def null_safe_join(spark, sf):
    a = table(spark, sf, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("k"))
    b = table(spark, sf, "nation").select(F.nullif(F.col("n_nationkey"), F.lit(3)).alias("k"), "n_name")
    return joins.null_safe(a, b, ["k"])


@query(
    """select s_suppkey, s_nationkey, coalesce(case when s_acctbal > 5000 then s_name end, n_name) label from supplier left join nation on s_nationkey = n_nationkey"""
)
def coalesce_override(spark, sf):
    own = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("label"))
    defaults = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))
    return joins.with_override(defaults, own, ["s_nationkey"], ["label"], ["s_suppkey"]).select("s_suppkey", "s_nationkey", "label")


@query(
    """select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') title, len(regexp_extract_all(html, '<a ')) n_links, regexp_extract(url, '^https?://([^/]+)', 1) host from pages"""
)
def parse_headers(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", F.nullif(F.regexp_extract(h, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"),
        F.size(F.regexp_extract_all(h, F.lit("<a "), 0)).cast("long").alias("n_links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


@query("""select event_type, count(*) n from events where ts > (select max(ts) - interval 5 day from events where event_type = 'click') group by 1""")
def counts_since(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").alias("EventDate"), F.col("event_type").alias("EventType"))
    runs = e.filter("EventType = 'click'").select(F.lit("x").alias("script"), (F.col("EventDate") - F.expr("INTERVAL 5 DAYS")).alias("exec_date"))
    return archive.events_since(e, runs, "x").withColumnRenamed("EventType", "event_type")


@query(
    """with a as (select o_orderdate::date as day, count(*) n_first from orders where o_orderstatus = 'F' group by 1), b as (select o_orderdate::date as day, count(*) n_second from orders where o_orderstatus = 'O' group by 1)
select day::varchar as day, coalesce(n_first, 0) n_first, coalesce(n_second, 0) n_second from a full join b using (day) where coalesce(n_first, 0) <> coalesce(n_second, 0)"""
)
def day_count_differences(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return archive.day_counts(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["day"]).withColumn("day", F.col("day").cast("string"))


@query(
    """with d as (select distinct o_custkey, round(dayofyear(o_orderdate) / 366.0::double, 9) p from orders), s as (select *, p - lag(p) over (partition by o_custkey order by p) st from d)
select o_custkey, round(greatest(coalesce(max(st), 0), 1 - max(p) + min(p)), 6) largest_gap from s group by 1"""
)
def largest_seasonal_gap(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (1990 + F.round(F.dayofyear("o_orderdate") / 366.0, 9)).alias("f"))
    o = o.withColumn("f", F.round("f", 9))
    return windows.largest_wrapped_gap(o, ["o_custkey"], "f").withColumn("largest_gap", F.round("largest_gap", 6))


@query(
    f"""with {DAILY}, m as (select *, case when t - lag(t) over (partition by user_id order by t) > 1 then t - lag(t) over (partition by user_id order by t) - 1 end g from daily)
select user_id, count(g) n_gaps, coalesce(max(g), 0) longest_gap from m group by 1"""
)
def gap_summary(spark, sf):
    return gap_totals(daily(spark, sf))


def gap_totals(d: DataFrame) -> DataFrame:
    g = windows.lag_difference(d, ["user_id"], "t", ["v"]).withColumn("g", F.when(F.col("d_t") > 1, F.col("d_t") - 1))
    return g.groupBy("user_id").agg(F.count("g").alias("n_gaps"), F.coalesce(F.max("g"), F.lit(0.0)).alias("longest_gap"))


@query()
def gap_trend_flagship(spark, sf):
    """Gaps and robust trend of each user's daily series; its oracle is with the other robust fits' (fit_catalogue)."""
    d = daily(spark, sf)
    trend = trajectory.robust_trend(d, ["user_id"], "t", "v").withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "wrms")})
    return gap_totals(d).join(trend, "user_id")
