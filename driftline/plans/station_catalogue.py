"""Registered queries of the network operators, on stations, files, sessions and solutions made from the driver's tables.

Each of these four is a list of expressions that Spark and DuckDB both read, so that a query and its oracle begin from the
same rows: `customer` gives stations, `orders` files, equipment sessions and solutions, `events` epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geodesy, text
from driftline.operators import alignment, archive, joins, network, quality, selection, trajectory, windows
from driftline.operators.selection import KEY
from driftline.plans.catalogue import query
from driftline.session import table
from driftline.sources import sinks


def span(engine: str, d: str = "0", h: str = "0", s: str = "0") -> str:
    """How the two engines write a span of days, hours and seconds."""
    if engine == "spark":
        return f"make_dt_interval(cast({d} as int), cast({h} as int), 0, cast({s} as int))"
    return f"(to_days(cast({d} as int)) + to_hours({h}) + to_seconds({s}))"


PLACE = {"lat": "(c_custkey * 37 % 1200) / cast(10 as double) - 60", "lon": "(c_custkey * 91 % 3599) / cast(10 as double) - 179.9"}
STATION_KEY = {"NetworkCode": "concat('n', {k} % 7)", "StationCode": "concat('s', lpad(cast({k} as string), 6, '0'))"}


def key(k: str) -> dict[str, str]:
    return {name: e.replace("{k}", k) for name, e in STATION_KEY.items()}


def stations_(engine: str) -> tuple[str, dict[str, str]]:
    own = {c: f"cast({a} as double)" for c, a in PLACE.items()}
    return "customer", key("c_custkey") | own | {
        "k": "c_custkey", "height": "c_acctbal", "country_code": "substr(c_mktsegment, 1, 3)", "max_dist": "case when c_acctbal > 5000 then cast(c_custkey % 9 + 1 as double) end",
        "auto_x": "cast(6000000 + c_custkey * 13 % 1000 as double)", "auto_y": "cast(c_custkey * 7 % 2000 - 1000 as double)", "auto_z": "cast(c_custkey * 11 % 3000 - 1500 as double)",
        "alias": "case when c_acctbal > 9000 then concat('x', c_custkey) end", "station_id": "c_custkey",
    }


def files_(engine: str) -> tuple[str, dict[str, str]]:
    start = f"o_orderdate + {span(engine, h='o_orderkey % 18')}"
    return "orders", key("o_custkey") | {
        "ObservationYear": "cast(year(o_orderdate) as int)", "ObservationDOY": "cast(dayofyear(o_orderdate) as int)", "Completion": "(o_orderkey * 7 % 101) / cast(100 as double)",
        "Interval": "cast(o_orderkey % 5 * 35 + 15 as int)", "ObservationSTime": start, "ObservationETime": f"{start} + {span(engine, h='o_orderkey % 7 + 1', s='o_orderkey % 59')}",
        "ReceiverSerial": "concat('S', o_orderkey % 5)", "path": "concat('a/', o_orderkey, '.gz')", "file_id": "o_orderkey", "priority": "o_orderpriority", "status": "o_orderstatus",
    }


def sessions_(engine: str) -> tuple[str, dict[str, str]]:
    start = f"o_orderdate + {span(engine, s='o_orderkey % 86399')}"
    return "orders", key("o_custkey") | {
        "DateStart": start, "DateEnd": f"case when o_orderstatus <> 'P' then {start} + {span(engine, d='o_orderkey * 7 % 500 + 1')} end", "session_id": "o_orderkey",
        "ReceiverSerial": "concat('s', o_orderkey % 3)", "AntennaCode": "concat('A', o_orderkey % 4)", "RadomeCode": "concat('R', o_orderkey % 2)", "hash": "cast(o_orderkey % 3 as int)", "priority": "o_orderpriority",
    }


def solutions_(engine: str) -> tuple[str, dict[str, str]]:
    return "orders", key("o_custkey") | {
        "Year": "cast(year(o_orderdate) as int)", "DOY": "cast(dayofyear(o_orderdate) as int)", "solution_id": "o_orderkey", "date": "o_orderdate", "ReferenceFrame": "concat('F', cast(year(o_orderdate) as int) % 3)",
        "X": "cast(6000000 + o_custkey * 13 % 1000 + o_orderkey % 13 - 6 as double)", "Y": "cast(o_custkey * 7 % 2000 - 1000 + o_orderkey % 11 - 5 as double)", "Z": "cast(o_custkey * 11 % 3000 - 1500 + o_orderkey % 17 - 8 as double)",
        "hash": "cast(o_orderkey % 4 as int)", "orbit_hash": "cast(case when o_orderkey % 3 > 0 then o_orderkey % 2 end as int)", "status": "o_orderstatus", "price": "o_totalprice",
    }


SOURCES = {"stations": stations_, "files": files_, "sessions": sessions_, "solutions": solutions_}


def rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, columns = SOURCES[name]("spark")
    return table(spark, sf, source).selectExpr(*[f"{e} as `{c}`" for c, e in columns.items()])


def with_(*names: str) -> str:
    """The WITH clause that gives DuckDB the same rows."""
    parts = []
    for name in names:
        source, columns = SOURCES[name]("duck")
        parts.append(f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source})")
    return "with " + ", ".join(parts)


URGENT, HIGH = "priority = '1-URGENT'", "priority = '2-HIGH'"


# selection


@query(f"{with_('stations')} select NetworkCode, StationCode from stations where (NetworkCode = 'n1' or StationCode like 's0000_7' or (country_code = 'AUT')) and not (NetworkCode = 'n1' and StationCode like 's00001_')")
def station_choice(spark, sf):
    return selection.stations(rows(spark, sf, "stations"), ["n1.all", "s0000_7", "AUT", "-n1.s00001_"]).select(*KEY)


@query(f"{with_('solutions')} select solution_id from solutions a where exists (select 1 from solutions b where b.status = 'P' and (a.NetworkCode, a.Year, a.DOY) = (b.NetworkCode, b.Year, b.DOY))")
def row_value_in(spark, sf):
    s = rows(spark, sf, "solutions")
    return selection.with_days(s, s.filter("status = 'P'"), ["NetworkCode", "Year", "DOY"]).select("solution_id")


@query(
    f"""{with_('stations', 'files')}, f as (select NetworkCode, StationCode, min(ObservationYear + ObservationDOY / 366.0::double) a, max(ObservationYear + ObservationDOY / 366.0::double) b from files group by 1, 2)
select NetworkCode, StationCode, k from stations join f using (NetworkCode, StationCode) where lat between -30 and 40 and lon between -90.5 and 100 and b - a >= 4.5"""
)
def box_and_span(spark, sf):
    f = rows(spark, sf, "files").withColumn("y", F.col("ObservationYear") + F.col("ObservationDOY") / 366.0)
    return selection.in_box(rows(spark, sf, "stations").join(archive.time_span(f, "y"), KEY), (-30, 40), (-90.5, 100), 4.5).select(*KEY, "k")


DISTANCE = "sqrt(pow(X - auto_x, 2) + pow(Y - auto_y, 2) + pow(Z - auto_z, 2))"


@query(
    f"""{with_('stations', 'solutions')} select solution_id, round({DISTANCE}, 6) distance_m, {DISTANCE} > coalesce(max_dist, 20) blunder
from solutions s join stations using (NetworkCode, StationCode) where not exists (select 1 from solutions e where e.status = 'P' and (e.NetworkCode, e.StationCode, e.Year, e.DOY) = (s.NetworkCode, s.StationCode, s.Year, s.DOY))"""
)
def blunder_marks(spark, sf):
    s = rows(spark, sf, "solutions")
    found = selection.near_station(s, rows(spark, sf, "stations"), s.filter("status = 'P'"))
    return found.select("solution_id", F.round("distance_m", 6).alias("distance_m"), "blunder")


@query(
    f"""{with_('solutions')}, s as (select *, X - case when status = 'F' then 6000000 else 0 end x2 from solutions)
select NetworkCode, StationCode, arg_min(sqrt(x2 * x2 + Y * Y + Z * Z), (Year, DOY, solution_id)) > 6300 absolute from s group by 1, 2"""
)
def absolute_or_difference(spark, sf):
    s = rows(spark, sf, "solutions").withColumn("X", F.col("X") - F.when(F.col("status") == "F", 6000000).otherwise(0))
    return selection.absolute_series(s.withColumn("mjd", F.struct("Year", "DOY", "solution_id"))).select(*KEY, "absolute").distinct()


@query(f"{with_('files')} select file_id from files where Completion >= 0.5 and Interval <= 120")
def processable_files(spark, sf):
    return selection.processable(rows(spark, sf, "files")).select("file_id")


FRAMES = "select concat('IGS', r_regionkey) frame, date '1992-01-01' + cast(r_regionkey * 500 as int) as start, case when r_regionkey < 4 then date '1992-01-01' + cast(r_regionkey * 500 + 520 as int) end as stop from region"


@query(
    f"""{with_('solutions')}, f as ({FRAMES}) select solution_id, arg_min(frame, start) frame from solutions left join f on date >= start and (stop is null or date <= stop) group by 1"""
)
def frame_at_day(spark, sf):
    r = table(spark, sf, "region").withColumn("start", F.date_add(F.lit("1992-01-01").cast("date"), (F.col("r_regionkey") * 500).cast("int")))
    frames = r.select(F.concat(F.lit("IGS"), "r_regionkey").alias("frame"), "start", F.when(F.col("r_regionkey") < 4, F.date_add("start", 520)).alias("end"))
    return selection.frame_of_day(rows(spark, sf, "solutions"), frames).select("solution_id", "frame")


@query(
    f"""{with_('stations')}, s as (select concat('c', k % 400) StationCode, NetworkCode, alias, k from stations)
select NetworkCode, StationCode, k from s where alias is null and StationCode in (select StationCode from s where alias is null group by 1 having count(*) > 1)"""
)
def repeated_codes(spark, sf):
    s = rows(spark, sf, "stations").withColumn("StationCode", F.concat(F.lit("c"), F.col("k") % 400))
    return selection.duplicate_codes(s).select(*KEY, "k")


@query(f"{with_('files')} select a.file_id, b.file_id other_id from files a join files b using (NetworkCode, StationCode) where a.file_id < b.file_id and a.Interval = b.Interval and abs(epoch(a.ObservationSTime) - epoch(b.ObservationSTime)) <= 8640000 and abs(epoch(a.ObservationETime) - epoch(b.ObservationETime)) <= 8640000")
def same_files(spark, sf):
    f = rows(spark, sf, "files").select(*KEY, "file_id", "Interval", "ObservationSTime", "ObservationETime")
    both = f.alias("a").join(f.alias("b"), KEY).filter("a.file_id < b.file_id")
    columns = [F.col(f"{x}.{c}") for x in "ab" for c in ("ObservationSTime", "ObservationETime", "Interval")]
    return both.filter(selection.same_file(*columns, seconds=8_640_000)).select(F.col("a.file_id").alias("file_id"), F.col("b.file_id").alias("other_id"))


@query(f"{with_('stations')} select k, case when height > 9000 or height < -400 then 'height out of range' end reason from stations")
def height_check(spark, sf):
    return rows(spark, sf, "stations").select("k", selection.height_reason(F.col("height")).alias("reason"))


@query(
    f"""{with_('solutions', 'sessions')} select solution_id from solutions a join sessions s using (NetworkCode, StationCode) where date >= DateStart and (DateEnd is null or date <= DateEnd) and a.hash <> s.hash + coalesce(orbit_hash, 0)"""
)
def stale_hashes(spark, sf):
    return selection.stale_solutions(rows(spark, sf, "solutions"), rows(spark, sf, "sessions")).select("solution_id")


@query(f"{with_('solutions')} select solution_id, price from solutions order by price limit 25")
def smallest_residuals(spark, sf):
    return selection.smallest(rows(spark, sf, "solutions").select("solution_id", "price"), "price", 25)


@query(f"{with_('stations', 'files')} select NetworkCode, StationCode from stations where height > 0 intersect select NetworkCode, StationCode from files where {HIGH}")
def stations_in_both(spark, sf):
    return selection.common_stations(rows(spark, sf, "stations").filter("height > 0"), rows(spark, sf, "files").filter(HIGH))


# windows


@query(
    f"""{with_('sessions')}, n as (select *, lead(DateStart) over (partition by NetworkCode, StationCode order by DateStart) nxt from sessions)
select session_id, (epoch(nxt) - epoch(DateEnd))::bigint gap_s from n where epoch(nxt) - epoch(DateEnd) > 1"""
)
def session_gap(spark, sf):
    return windows.session_gaps(rows(spark, sf, "sessions"), KEY).select("session_id", "gap_s")


RUNS = """m as (select *, case when lag({c}) over w is distinct from {c} then 1 else 0 end j from {t} window w as (partition by NetworkCode, StationCode order by {o})),
r as (select *, sum(j) over (partition by NetworkCode, StationCode order by {o}) g from m), runs as (select NetworkCode, StationCode, g, {c}, min({o}) f, max({o}) l, count(*) n from r group by all)"""


@query(
    f"""{with_('files')}, {RUNS.format(c='ReceiverSerial', t='files', o='file_id')}, k as (select * from (select *, row_number() over (partition by NetworkCode, StationCode order by f) p from runs) where n > 1 or p = 1),
a as (select *, case when lag(ReceiverSerial) over (partition by NetworkCode, StationCode order by f) is distinct from ReceiverSerial then 1 else 0 end j2 from k),
b as (select *, sum(j2) over (partition by NetworkCode, StationCode order by f) s from a)
select NetworkCode, StationCode, ReceiverSerial, min(f) as first, max(l) as last, sum(n)::bigint n from b group by NetworkCode, StationCode, s, ReceiverSerial"""
)
def sessions_of_headers(spark, sf):
    return windows.header_sessions(rows(spark, sf, "files"), KEY, "file_id", ["ReceiverSerial"], ignore=1)


@query(
    f"""{with_('solutions')} select NetworkCode, StationCode, min(date)::date::varchar as first, max(date)::date::varchar as last, count(distinct date) n_days, date_diff('day', min(date), max(date)) + 1 - count(distinct date) n_missing from solutions group by 1, 2"""
)
def days_expected(spark, sf):
    s = rows(spark, sf, "solutions").withColumn("date", F.to_date("date"))
    d = windows.expected_days(s, KEY, "date")
    return d.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query(f"{with_('sessions')} select * from (select session_id, lead(session_id) over (partition by NetworkCode, StationCode order by session_id) - session_id days_to_next from sessions) where days_to_next is not null")
def days_between_jumps(spark, sf):
    return windows.days_to_next(rows(spark, sf, "sessions"), KEY, "session_id").filter("days_to_next is not null").select("session_id", "days_to_next")


@query(
    f"""{with_('solutions')}, j as (select *, lead(solution_id) over (partition by NetworkCode, StationCode order by solution_id) nxt from solutions where status = 'F')
select j.NetworkCode, j.StationCode, j.solution_id, count(o.solution_id) n_points from j left join (select * from solutions where status = 'O') o
on (o.NetworkCode, o.StationCode) = (j.NetworkCode, j.StationCode) and o.solution_id >= j.solution_id and (nxt is null or o.solution_id < nxt) group by 1, 2, 3"""
)
def observations_between_jumps(spark, sf):
    s = rows(spark, sf, "solutions")
    return windows.points_between(s.filter("status = 'F'"), s.filter("status = 'O'"), KEY, "solution_id")


@query(
    """with recursive e as (select user_id, event_id, epoch(ts) / 86400 d, value from events),
w as (select user_id, min(d) s from e group by 1 union all select w.user_id, min(e.d) from w join e on e.user_id = w.user_id and e.d > w.s + 15 group by w.user_id, w.s),
n as (select *, lead(s) over (partition by user_id order by s) nxt from w where s is not null)
select e.user_id, arg_max(event_id, (value, -d, -event_id)) event_id from n join e on e.user_id = n.user_id and e.d >= s and (nxt is null or e.d < nxt) group by e.user_id, s"""
)
def strongest_of_windows(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("d"), "value")
    return windows.strongest_in_window(e, ["user_id"], "d", "value").select("user_id", "event_id")


# archive


@query(
    f"""{with_('files', 'solutions')}, m as (select NetworkCode, StationCode, count(*) missing from files f where not exists (select 1 from solutions s where s.status = 'F' and (s.NetworkCode, s.StationCode, s.Year, s.DOY) = (f.NetworkCode, f.StationCode, f.ObservationYear, f.ObservationDOY)) group by 1, 2),
n as (select NetworkCode, StationCode, count(*) n from solutions where status = 'F' group by 1, 2)
select NetworkCode, StationCode, n, coalesce(missing, 0) missing, round(100 - 100.0::double * coalesce(missing, 0) / (coalesce(missing, 0) + n), 6) completion from n left join m using (NetworkCode, StationCode)"""
)
def completion_of_series(spark, sf):
    f = rows(spark, sf, "files").withColumnsRenamed({"ObservationYear": "Year", "ObservationDOY": "DOY"})
    done = archive.series_completion(rows(spark, sf, "solutions").filter("status = 'F'"), f, [*KEY, "Year", "DOY"])
    return done.withColumn("completion", F.round("completion", 6))


@query(f"{with_('solutions')} select NetworkCode, StationCode, (sum(X * 10000) + sum(Y * 10000) + sum(Z * 10000))::bigint total, count(*) n from solutions group by 1, 2")
def series_fingerprint(spark, sf):
    f = archive.fingerprint(rows(spark, sf, "solutions"), KEY, ["X", "Y", "Z"])
    return f.withColumn("total", F.col("total").cast("long"))


@query(f"{with_('files', 'solutions')} select (2 * count(*))::bigint n_positions, (select count(*) from files) n_delays, (2 * count(*) + (select count(*) from files))::bigint n_unknowns from solutions")
def unknowns_of_combination(spark, sf):
    return archive.unknowns(rows(spark, sf, "solutions"), rows(spark, sf, "files"), ["Year", "DOY"])


@query(f"""{with_('solutions')} select NetworkCode, StationCode, Year, DOY, avg(X) X, avg(Y) Y, avg(Z) Z from (select NetworkCode, 'a' StationCode, Year, DOY, X, Y, Z from solutions) group by 1, 2, 3, 4""")
def mean_station_positions(spark, sf):
    s = rows(spark, sf, "solutions").withColumn("StationCode", F.lit("a"))
    return s.groupBy("Year", "DOY").agg(F.lit(1)).select("Year", "DOY").join(s.groupBy(*KEY, "Year", "DOY").agg(*[F.avg(c).alias(c) for c in "XYZ"]), ["Year", "DOY"])


@query("""select concat('n', l_suppkey) NetworkCode, 'a' StationCode, l_shipdate::varchar as Date, round(avg(l_quantity), 4) ZTD, round(avg(l_tax), 4) sigma from lineitem group by 1, 2, 3""")
def mean_delay_knots(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("n"), "l_suppkey").alias("NetworkCode"), F.lit("a").alias("StationCode"), F.col("l_shipdate").cast("string").alias("Date"), F.col("l_quantity").alias("ZTD"), F.col("l_tax").alias("sigma"))
    return archive.mean_knots(li)


@query(
    """select l_suppkey, round(sqrt(sum(l_quantity * l_quantity / pow(1 + l_tax, 2)) / sum(1 / pow(1 + l_tax, 2))), 6) wrms, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) iqr, count(*) n from lineitem group by 1"""
)
def residual_spread(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("s", 1 + F.col("l_tax"))
    stats, _ = archive.residual_statistics(li, ["l_suppkey"], "l_quantity", "s")
    return stats.withColumns({c: F.round(c, 6) for c in ("wrms", "iqr")})


@query("select l_suppkey, floor(l_quantity / 5.0::double)::bigint bin, count(*) n from lineitem group by 1, 2")
def residual_histogram(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("s", F.lit(1.0))
    return archive.residual_statistics(li, ["l_suppkey"], "l_quantity", "s", bin_m=5.0)[1]


@query(
    """select l_suppkey, round(corr(l_quantity, l_extendedprice), 6) corr_qp, round(corr(l_quantity, l_discount), 6) corr_qd, round(corr(l_extendedprice, l_discount), 6) corr_pd,
round(covar_samp(l_quantity, l_quantity), 4) cov_qq, round(covar_samp(l_discount, l_discount), 6) cov_dd, round(covar_samp(l_quantity, l_discount), 6) cov_qd from lineitem group by 1"""
)
def residual_correlation(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_quantity": "q", "l_extendedprice": "p", "l_discount": "d"})
    c = archive.residual_covariance(li, ["l_suppkey"], "q", "p", "d")
    digits = {"corr_qp": 6, "corr_qd": 6, "corr_pd": 6, "cov_qq": 4, "cov_dd": 6, "cov_qd": 6}
    return c.select("l_suppkey", *[F.round(k, n).alias(k) for k, n in digits.items()])


@query(f"{with_('files')} select ObservationYear, ObservationDOY, count(*) n_files, count(distinct (NetworkCode, StationCode)) n_stations from files group by 1, 2")
def files_each_day(spark, sf):
    return archive.files_per_day(rows(spark, sf, "files"))


@query(
    f"""{with_('files')} select file_id, concat_ws('/', 'n0' || NetworkCode[2:2], ObservationYear, lpad(ObservationDOY::varchar, 3, '0')) path, 'n0' || NetworkCode[2:2] network, ObservationYear::varchar as year, lpad(ObservationDOY::varchar, 3, '0') doy from files"""
)
def archive_folders(spark, sf):
    f = rows(spark, sf, "files").withColumn("network", F.concat(F.lit("n0"), F.substring("NetworkCode", 2, 1)))
    levels = ["network", "year", "doy"]
    path = archive.archive_path(levels, {"network": F.col("network"), "year": F.col("ObservationYear"), "doy": F.col("ObservationDOY")})
    named = f.select("file_id", path.alias("path")).withColumn("keys", archive.path_keys(F.concat("path", F.lit("/x.gz")), levels))
    return named.select("file_id", "path", "keys.*")


@query(
    f"""{with_('files')} select file_id, lower(StationCode[4:7]) || lpad(ObservationDOY::varchar, 3, '0') || (file_id % 10) || '.' || lpad((ObservationYear % 100)::varchar, 2, '0') || 'o' as name,
lower(StationCode[4:7]) station, ObservationYear as year, ObservationDOY as doy, (file_id % 10)::varchar as session from files"""
)
def short_file_names(spark, sf):
    f = rows(spark, sf, "files")
    name = quality.short_name(F.substring("StationCode", 4, 4), F.col("ObservationDOY"), (F.col("file_id") % 10).cast("string"), F.col("ObservationYear"))
    return f.select("file_id", name.alias("name")).withColumn("f", archive.file_name(F.col("name"))).select("file_id", "name", "f.station", "f.year", "f.doy", "f.session")


@query("select p_partkey, case when p_size % 3 = 0 then -1 else round(p_retailprice, 2) end x from part")
def header_fields(spark, sf):
    price = F.when(F.col("p_size") % 3 == 0, F.lit("  n/a   ")).otherwise(F.round("p_retailprice", 2).cast("string"))
    line = F.concat(F.rpad(F.lit("HEIGHT"), 10, " "), F.rpad(price, 14, " "), F.lit("END"))
    return table(spark, sf, "part").select("p_partkey", archive.header_number(line, 11, 14, -1.0).alias("x"))


@query(
    f"""{with_('files')}, s as (select file_id, Interval % 155 i, epoch(ObservationETime)::bigint - epoch(ObservationSTime)::bigint s, file_id % 3000 n from files)
select file_id, case when i = 0 then 'interval is zero' when i > 120 then 'interval over 120 s' when s < 7200 then 'too short' end reason,
round(n * i / 86400.0::double, 3) completion, round(n * i / (s + i)::double, 3) relative_completion from s"""
)
def inspected_files(spark, sf):
    f = rows(spark, sf, "files")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    epoch = F.struct((F.col("Interval") % 155).cast("double").alias("interval"), (F.col("file_id") % 3000).alias("number"), F.lit(0).cast("long").alias("number_extra"), at("ObservationSTime").alias("first"), at("ObservationETime").alias("last"))
    record = f.select("file_id", F.to_json(F.struct(F.struct(epoch.alias("epoch")).alias("data"))).alias("json"))
    return archive.inspected(record, "json", least_s=7200).select("file_id", "reason", "completion", "relative_completion")


WEEK = "(date_diff('day', date '1980-01-06', {d}::date) // 7)::integer", "(date_diff('day', date '1980-01-06', {d}::date) % 7)::integer"


@query(
    f"""select gps_week, gps_day, l_orderkey, l_linenumber from (select *, {WEEK[0].format(d='l_shipdate')} gps_week, {WEEK[1].format(d='l_shipdate')} gps_day from lineitem)
qualify row_number() over (partition by gps_week, gps_day order by l_linenumber, l_quantity desc, l_orderkey * 1000000 + l_partkey desc) = 1"""
)
def orbit_of_day(spark, sf):
    from driftline.functions import calendar

    day = F.to_date("l_shipdate")
    listing = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", calendar.gps_week(day).alias("gps_week"), calendar.gps_day(day).alias("gps_day"), F.col("l_linenumber").alias("precedence"), F.col("l_quantity").alias("version"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("interval"))
    return archive.orbit_choice(listing).select("gps_week", "gps_day", "l_orderkey", "l_linenumber")


@query(f"{with_('files')} select file_id from files where Interval = 50 and ReceiverSerial = 'S1'")
def records_by_property(spark, sf):
    return archive.records(rows(spark, sf, "files"), Interval=50, ReceiverSerial="S1").select("file_id")


# joins


@query(
    f"""{with_('sessions', 'files')}, s as (select * from sessions), n as (select *, lead(DateStart) over (partition by NetworkCode, StationCode order by DateStart) nxt from s),
g as (select NetworkCode, StationCode, session_id, DateEnd a, nxt b from n where epoch(nxt) - epoch(DateEnd) > 1)
select g.session_id, count(f.file_id) n_files from g left join files f on (f.NetworkCode, f.StationCode) = (g.NetworkCode, g.StationCode) and f.ObservationETime > a and f.ObservationSTime < b group by 1"""
)
def files_within_gaps(spark, sf):
    g = windows.session_gaps(rows(spark, sf, "sessions"), KEY)
    g = g.select(*KEY, "session_id", F.col("DateEnd").alias("gap_start"), F.col("next_start").alias("gap_end"))
    return joins.files_in_gaps(g, rows(spark, sf, "files"), KEY).select("session_id", "n_files")


@query(
    f"""{with_('sessions')}, s as (select *, DateStart + to_days(cast(session_id % 700 + 1 as int)) stop from sessions)
select a.session_id id_a, b.session_id id_b, epoch(least(a.stop, b.stop))::bigint - epoch(greatest(a.DateStart, b.DateStart))::bigint shared_s
from s a join s b using (NetworkCode, StationCode) where (a.DateStart, a.stop) < (b.DateStart, b.stop) and least(a.stop, b.stop) > greatest(a.DateStart, b.DateStart)"""
)
def uneven_overlaps(spark, sf):
    s = rows(spark, sf, "sessions").withColumn("DateEnd", F.col("DateStart") + F.expr("make_dt_interval(cast(session_id % 700 + 1 as int))"))
    return joins.overlaps(s, KEY, carry=("session_id",)).select(F.col("session_id_a").alias("id_a"), F.col("session_id_b").alias("id_b"), "shared_s")


@query(
    f"""{with_('files', 'sessions')} select f.NetworkCode, f.StationCode, ObservationYear y, arg_min(session_id, DateStart) session_id from (select row_number() over () r, NetworkCode, StationCode, ObservationYear, make_timestamp(ObservationYear, 7, 1, 0, 0, 0) t from files) f
join sessions s on (s.NetworkCode, s.StationCode) = (f.NetworkCode, f.StationCode) and t >= DateStart and (DateEnd is null or t <= DateEnd) group by r, 1, 2, 3"""
)
def sessions_of_repeated_points(spark, sf):
    """J9 on points that repeat: every file of a station and year asks for the same moment."""
    points = rows(spark, sf, "files").select(*KEY, F.col("ObservationYear").alias("y")).withColumn("t", F.make_timestamp_ntz("y", F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return joins.valid_at(points, rows(spark, sf, "sessions").select(*KEY, "DateStart", "DateEnd", "session_id"), KEY, "t").select(*KEY, "y", "session_id")


@query(
    f"""{with_('solutions')}, s as (select NetworkCode, StationCode, Year, DOY % 8 DOY, max(X) X, max(Y) Y, max(Z) Z from solutions group by all)
select NetworkCode, StationCode, a.X, a.Y, a.Z, b.X X2, b.Y Y2, b.Z Z2 from s a join s b using (NetworkCode, StationCode) where (a.Year, a.DOY) = (1997, 3) and (b.Year, b.DOY) = (1999, 5)"""
)
def solutions_of_two_days(spark, sf):
    s = rows(spark, sf, "solutions").withColumn("DOY", F.col("DOY") % 8).groupBy(*KEY, "Year", "DOY").agg(*[F.max(c).alias(c) for c in "XYZ"])
    return joins.two_days(s, (1997, 3), (1999, 5)).drop("Year", "DOY")


@query(f"{with_('stations')}, r as (select k, case when k % 2 = 0 then coalesce(alias, StationCode) else StationCode end code from stations) select r.k, NetworkCode, StationCode from r left join stations s on r.code = coalesce(s.alias, s.StationCode)")
def names_of_aliases(spark, sf):
    s = rows(spark, sf, "stations")
    asked = s.select("k", F.when(F.col("k") % 2 == 0, F.coalesce("alias", "StationCode")).otherwise(F.col("StationCode")).alias("code"))
    return joins.named(asked, s.select("alias", *KEY)).select("k", *KEY)


# quality


@query(
    f"""{with_('files', 'sessions')}, p as (select NetworkCode, StationCode, file_id, ReceiverSerial, make_timestamp(((epoch_us(ObservationSTime) + epoch_us(ObservationETime)) // 2)::bigint) m from files),
v as (select p.file_id, m, any_value(upper(p.ReceiverSerial)) fs, arg_min(upper(s.ReceiverSerial), DateStart) rs, any_value(p.NetworkCode) NetworkCode, any_value(p.StationCode) StationCode from p join sessions s on (s.NetworkCode, s.StationCode) = (p.NetworkCode, p.StationCode) and floor(epoch(m)) >= floor(epoch(DateStart)) and (DateEnd is null or floor(epoch(m)) <= floor(epoch(DateEnd))) group by 1, 2),
d as (select *, case when lag(fs) over w is distinct from fs or lag(rs) over w is distinct from rs then 1 else 0 end j from v window w as (partition by NetworkCode, StationCode order by m)),
r as (select *, sum(j) over (partition by NetworkCode, StationCode order by m) g from d)
select NetworkCode, StationCode, fs file_serial, rs record_serial, count(*) n from r where fs is distinct from rs group by NetworkCode, StationCode, g, fs, rs"""
)
def wrong_serials(spark, sf):
    found = quality.serial_mismatches(rows(spark, sf, "files"), rows(spark, sf, "sessions"))
    return found.select(*KEY, "file_serial", "record_serial", "n")


@query(
    f"""{with_('sessions', 'files')}, s as (select * from sessions), n as (select *, lead(DateStart) over (partition by NetworkCode, StationCode order by DateStart) nxt from s),
g as (select * from n where epoch(nxt) - epoch(DateEnd) > 1), z as (select NetworkCode, StationCode, min(DateStart) lo, max(coalesce(DateEnd, timestamp '9999-12-31 23:59:59')) hi from s group by 1, 2),
faults as (select NetworkCode, StationCode, DateStart as "at", 'open record' fault from n where DateEnd is null and nxt is not null
union all select b.NetworkCode, b.StationCode, b.DateStart, 'overlap' from s a join s b using (NetworkCode, StationCode) where a.DateStart < b.DateStart and (a.DateEnd is null or a.DateEnd > b.DateStart)
union all select NetworkCode, StationCode, DateEnd, 'files in gap' from g where exists (select 1 from files f where (f.NetworkCode, f.StationCode) = (g.NetworkCode, g.StationCode) and f.ObservationETime > g.DateEnd and f.ObservationSTime < g.nxt)
union all select NetworkCode, StationCode, DateStart, 'unknown antenna' from s where AntennaCode = 'A3'
union all select f.NetworkCode, f.StationCode, ObservationSTime, 'file without record' from files f left join z using (NetworkCode, StationCode) where lo is null or ObservationSTime < lo or ObservationETime > hi)
select fault, NetworkCode, StationCode, count(*) n, min(faults.at)::varchar as first from faults group by 1, 2, 3"""
)
def faults_of_equipment(spark, sf):
    antennas = spark.createDataFrame([("A0",), ("A1",), ("A2",)], "AntennaCode string")
    found = quality.equipment_faults(rows(spark, sf, "sessions"), rows(spark, sf, "files"), antennas)
    return found.groupBy("fault", *KEY).agg(F.count("*").alias("n"), F.min("at").cast("string").alias("first"))


@query(f"{with_('files')} select file_id from files where path not in (select path from files where status = 'F')")
def files_not_found(spark, sf):
    f = rows(spark, sf, "files")
    return quality.missing_files(f, f.filter("status = 'F'")).select("file_id")


@query(
    f"""{with_('solutions')} select solution_id from solutions s where not exists (select 1 from solutions e where e.status in ('P', 'F') and e.price > 300000 and (e.NetworkCode, e.StationCode, e.Year, e.DOY) = (s.NetworkCode, s.StationCode, s.Year, s.DOY))"""
)
def solutions_not_excluded(spark, sf):
    s = rows(spark, sf, "solutions")
    high = s.filter("price > 300000")
    return quality.excluded(s, high.filter("status = 'P'"), high.filter("status = 'F'"))[1].select("solution_id")


@query(f"{with_('files')} select file_id from files where Completion < 0.3 and ObservationYear * 1000 + ObservationDOY between 1994100 and 1997200")
def files_too_short(spark, sf):
    return quality.low_completion(rows(spark, sf, "files"), 0.3, (1994, 100), (1997, 200)).select("file_id")


@query(
    f"""{with_('solutions')}, m as (select *, NetworkCode = 'n1' and StationCode < 's000800' moved from (select *, case when solution_id % 2 = 0 then 's000001' else 's000002' end s2 from solutions)),
t as (select solution_id, Year, DOY, s2 from solutions join m using (solution_id, Year, DOY)) select solution_id, case when s2 = 's000001' then 's000002' else s2 end StationCode from t a
where not (s2 = 's000001' and exists (select 1 from t b where b.s2 = 's000002' and (a.Year, a.DOY) = (b.Year, b.DOY)))"""
)
def station_renamed(spark, sf):
    """Q7: all solutions with an even number belong to one station, which is merged into the other's."""
    s = rows(spark, sf, "solutions").withColumn("NetworkCode", F.lit("n")).withColumn("StationCode", F.when(F.col("solution_id") % 2 == 0, "s000001").otherwise("s000002"))
    found = quality.renamed({"s": s}, {"s": [*KEY, "Year", "DOY"]}, ("n", "s000001"), ("n", "s000002"))["s"]
    return found.select("solution_id", "StationCode")


@query(
    f"""{with_('files', 'solutions')}, l as (select * from files where status <> 'P') select solution_id from solutions s where not (exists (select 1 from files f where f.status = 'P' and (f.NetworkCode, f.StationCode, f.ObservationYear, f.ObservationDOY) = (s.NetworkCode, s.StationCode, s.Year, s.DOY))
and not exists (select 1 from files f where (f.NetworkCode, f.StationCode, f.ObservationYear, f.ObservationDOY) = (s.NetworkCode, s.StationCode, s.Year, s.DOY)
and not exists (select 1 from files g where g.status = 'P' and (g.NetworkCode, g.StationCode, g.ObservationYear, g.ObservationDOY, g.Interval, g.Completion) = (f.NetworkCode, f.StationCode, f.ObservationYear, f.ObservationDOY, f.Interval, f.Completion))))"""
)
def solutions_after_removal(spark, sf):
    f = rows(spark, sf, "files")
    return quality.remove_file(f, rows(spark, sf, "solutions"), f.filter("status = 'P'"))[1].select("solution_id")


@query(
    f"""{with_('files', 'stations')}, h as (select distinct NetworkCode, StationCode, ObservationYear, ObservationDOY, Interval, Completion from files where status = 'F'),
a as (select file_id, f.StationCode, case when status = 'P' and file_id % 4 = 0 then 'unreadable' end reason, k, case when file_id % 9 > 0 then lat end lat, height, h.NetworkCode is not null held
from files f left join (select * from stations where k % 6 > 0) s using (NetworkCode, StationCode) left join h using (NetworkCode, StationCode, ObservationYear, ObservationDOY, Interval, Completion)),
r as (select file_id, case when reason is not null then reason when coalesce(lat, 1) = 1 and file_id % 9 = 0 then 'no coordinate' when file_id % 9000 > 8000 then 'height out of range' when held then 'already archived' when k is null then 'station is not known' end reason from a)
select file_id, reason, case when reason is null then 'insert' when reason = 'station is not known' then 'locked' when reason = 'already archived' then 'duplicate' when reason = 'no coordinate' then 'retry' else 'reject' end status from r"""
)
def files_arriving(spark, sf):
    f = rows(spark, sf, "files")
    i = F.col("file_id")
    arrived = f.select(
        *KEY, "ObservationYear", "ObservationDOY", "Interval", "Completion", "file_id", F.when((F.col("status") == "P") & (i % 4 == 0), "unreadable").alias("reason"),
        F.when(i % 9 > 0, 1.0).alias("lat"), F.when(i % 9000 > 8000, 9999.0).otherwise(10.0).alias("height"),
    )
    return quality.ingest(arrived, f.filter("status = 'F'"), rows(spark, sf, "stations").filter("k % 6 > 0")).select("file_id", "reason", "status")


@query(f"{with_('files')} select file_id, unnest(generate_series(ObservationSTime::date, ObservationETime::date, interval 1 day))::date::varchar as day from files")
def days_of_files(spark, sf):
    return quality.file_days(rows(spark, sf, "files")).select("file_id", F.col("day").cast("string"))


@query(
    f"""{with_('files', 'stations', 'sessions')}, d as (select distinct ObservationSTime::date as day from files), b as (select min(day) lo, max(day) hi from d),
o as (select distinct s.NetworkCode, s.StationCode, d.day from sessions s join stations using (NetworkCode, StationCode) join d on d.day >= s.DateStart::date and d.day <= coalesce(s.DateEnd::date, (select hi from b)))
select NetworkCode, StationCode, any_value(k % 3) server_id, count(*) n, min(day)::varchar first_day, max(day)::varchar last_day from o join stations using (NetworkCode, StationCode)
where not exists (select 1 from files f where f.Completion >= 0.5 and (f.NetworkCode, f.StationCode) = (o.NetworkCode, o.StationCode) and make_date(f.ObservationYear, 1, 1) + f.ObservationDOY - 1 = o.day) group by 1, 2"""
)
def downloads_wanted(spark, sf):
    st, f = rows(spark, sf, "stations"), rows(spark, sf, "files")
    days = f.select(F.to_date("ObservationSTime").alias("day"))
    sources = st.select(*KEY, F.lit(1).alias("try_order"), (F.col("k") % 3).alias("server_id"))
    queue = quality.download_queue(st, days, f, rows(spark, sf, "sessions"), sources)
    return queue.groupBy(*KEY, "server_id").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


# epochs


@query("""select event_id from events where ts between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-20 12:00:00' and floor(epoch(ts))::bigint % 3 = 0 and event_type not in ('error', 'view')""")
def epochs_kept(spark, sf):
    import datetime

    e = table(spark, sf, "events").withColumn("system", F.col("event_type"))
    e = quality.window_epochs(e, datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 20, 12))
    return quality.drop_systems(quality.decimate(e, 3), ["error", "view"]).select("event_id")


@query("""with e as (select *, date_trunc('hour', ts) h from events), a as (select * from e where event_type = 'click'), b as (select * from e where event_type <> 'click')
select event_id from a union all select event_id from b where not exists (select 1 from a where a.user_id = b.user_id and a.h = b.h)""")
def files_spliced(spark, sf):
    e = table(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts"))
    return quality.splice(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), ["user_id", "h"]).select("event_id")


@query(
    f"""{with_('files', 'sessions')} select f.file_id, coalesce(arg_min(s.ReceiverSerial, s.DateStart), any_value(f.ReceiverSerial)) ReceiverSerial from files f left join sessions s
on (s.NetworkCode, s.StationCode) = (f.NetworkCode, f.StationCode) and f.ObservationSTime >= s.DateStart and (s.DateEnd is null or f.ObservationSTime <= s.DateEnd) where f.file_id in (select max(file_id) from files group by NetworkCode, StationCode, ObservationSTime) group by 1"""
)
def headers_corrected(spark, sf):
    f = rows(spark, sf, "files")
    one = f.groupBy(*KEY, "ObservationSTime").agg(F.max("file_id").alias("file_id"))
    f = f.join(one.select("file_id"), "file_id", "left_semi")
    return quality.corrected_headers(f, rows(spark, sf, "sessions"), ["ReceiverSerial"]).select("file_id", "ReceiverSerial")


@query(f"""{with_('files')} select NetworkCode, StationCode, ObservationYear as day, Interval, min(file_id) as first, max(file_id) as last, sum(ObservationDOY)::bigint epochs, count(*) n_parts from files group by 1, 2, 3, 4""")
def parts_merged(spark, sf):
    f = rows(spark, sf, "files").select(*KEY, F.col("ObservationYear").alias("day"), "Interval", F.col("file_id").alias("first"), F.col("file_id").alias("last"), F.col("ObservationDOY").alias("epochs"))
    return quality.merged(f)


@query(
    f"""{with_('stations')} select o_orderkey, l_orderkey * 10 + l_linenumber visit_file, NetworkCode, StationCode from lineitem left join orders on l_orderkey = o_orderkey left join stations on k = o_custkey where l_returnflag <> 'R'"""
)
def visits_pending(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("visit_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("visit_file"), (F.col("l_returnflag") == "R").alias("rinexed"))
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("visit_id"), F.col("o_orderkey"), F.col("o_custkey").alias("station_id"))
    return quality.pending_visits(f, v, rows(spark, sf, "stations")).select("o_orderkey", "visit_file", *KEY)


@query(f"select distinct o_orderdate::date::varchar as day, {WEEK[0].format(d='o_orderdate')} gps_week, {WEEK[1].format(d='o_orderdate')} gps_day from orders where o_orderdate::date not in (select l_shipdate::date from lineitem where l_quantity > 45)")
def orbits_missing(spark, sf):
    from driftline.functions import calendar

    day = F.to_date("l_shipdate")
    listing = table(spark, sf, "lineitem").filter("l_quantity > 45").select(calendar.gps_week(day).alias("gps_week"), calendar.gps_day(day).alias("gps_day"))
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return quality.missing_orbits(days, listing).withColumn("day", F.col("day").cast("string"))


@query("select p_partkey, round(p_retailprice / 20, 1) wide_lane, p_size / 2 narrow_lane, (p_size % 3)::integer n_fatal from part")
def run_summaries(spark, sf):
    p = table(spark, sf, "part")
    lines = F.concat(F.lit("Percent fixed WL : "), F.round(F.col("p_retailprice") / 20, 1).cast("string"), F.lit(" %\nPercent fixed NL: "), (F.col("p_size") / 2).cast("string"), F.lit("\n"), F.repeat(F.lit("FATAL x "), (F.col("p_size") % 3).cast("int")))
    return p.select("p_partkey", quality.ambiguity_rates(lines).alias("r")).select("p_partkey", "r.wide_lane", "r.narrow_lane", "r.n_fatal")


# geodesy and text

TWO = "with p as (select c_custkey id, cast((c_custkey * 37 % 1200) / 10.0 - 60 as double) lat, cast((c_custkey * 91 % 3599) / 10.0 - 179.9 as double) lon, c_nationkey n from customer), s as (select n_nationkey n, cast((n_nationkey * 53 % 1200) / 10.0 - 60 as double) lat, cast((n_nationkey * 71 % 3599) / 10.0 - 179.9 as double) lon from nation)"


def two(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    p = table(spark, sf, "customer").select(c.alias("id"), ((c * 37 % 1200) / 10.0 - 60).alias("lat"), ((c * 91 % 3599) / 10.0 - 179.9).alias("lon"), F.col("c_nationkey").alias("n"))
    n = F.col("n_nationkey")
    s = table(spark, sf, "nation").select(n.alias("n"), ((n * 53 % 1200) / 10.0 - 60).alias("lat2"), ((n * 71 % 3599) / 10.0 - 179.9).alias("lon2"))
    return p.join(s, "n")


@query(
    f"""{TWO}, b as (select id, degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360 b from p a join s b using (n))
select id, round(b - 360 * floor(b / 360), 5) bearing from b"""
)
def initial_bearing(spark, sf):
    return two(spark, sf).select("id", F.round(geodesy.bearing(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 5).alias("bearing"))


@query(f"""{TWO}, c as (select id, a.lat, a.lon, b.lat lat2, b.lon lon2, acos(greatest(least(sin(radians(b.lat)) * sin(radians(a.lat)) + cos(radians(b.lat)) * cos(radians(a.lat)) * cos(radians(a.lon - b.lon)), 1), -1)) c from p a join s b using (n))
select id, round(6371 * c / sin(c) * cos(radians(lat)) * sin(radians(lon - lon2)), 3) x, round(6371 * c / sin(c) * (cos(radians(lat2)) * sin(radians(lat)) - sin(radians(lat2)) * cos(radians(lat)) * cos(radians(lon - lon2))), 3) y from c""")
def azimuthal_map(spark, sf):
    d = two(spark, sf).withColumn("m", geodesy.azimuthal(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return d.select("id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query("""select p_partkey, round(6.04370855910554 - 0.102313555237178 * p_size + 0.0206316702864554 * p_size * p_size, 6) as minutes, round(sqrt(pow(2 + p_size / 10, 2) - pow(0.15, 2)) - 0.05, 6) height from part""")
def models_of_size(spark, sf):
    n = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.round(geodesy.subnet_minutes(n), 6).alias("minutes"), F.round(geodesy.vertical_height(2 + n / 10, F.lit(0.15), F.lit(0.05)), 6).alias("height"))


@query("select p_partkey, round(pow(10, -3.22 + 0.69 * m), 4) along_strike_km, round(pow(10, -1.01 + 0.32 * m), 4) down_dip_km from (select p_partkey, 4 + p_size / 12 m from part)")
def fault_dimensions(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", geodesy.fault_size(4 + F.col("p_size") / 12).alias("f"))
    return d.select("p_partkey", *[F.round(F.col(f"f.{a}_m") / 1000, 4).alias(f"{a}_km") for a in ("along_strike", "down_dip")])


@query("select c_custkey, case when y >= 100 then y when y < 80 then y + 2000 else y + 1900 end as year, '0123456789abcdefghijklmnopqrstuvwxABCDEFGHIJKLMNOPQRSTUVWX'[c_custkey % 58 + 1] letter, c_name[10:] part from (select *, c_custkey % 130 y from customer)")
def text_parts(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", text.full_year(k % 130).alias("year"), text.session_letter(k % 58 + 1).alias("letter"), text.between(F.concat("c_name", F.lit("|x")), "#", "|").alias("part"))


@query("select url, regexp_extract(url, '^https?://([^/:]+)', 1) host, (page_id % 9000)::integer port from pages")
def hosts_and_ports(spark, sf):
    name = F.concat(F.regexp_extract("url", "^https?://([^/:]+)", 1), F.lit(":"), (F.col("page_id") % 9000).cast("string"))
    return table(spark, sf, "pages").select("url", text.host(name).alias("h")).select("url", "h.host", "h.port")


# stacks and plates


@query(
    f"""{with_('solutions')}, k as (select NetworkCode, StationCode, Year, DOY from solutions), o as (select NetworkCode, StationCode, Year, DOY from solutions where price > 20000),
m as (select distinct Year, DOY from (select * from k except select * from o union select * from (select * from o except select * from k)))
select solution_id, 'stack' part from solutions where price > 20000 and (Year, DOY) not in (select (Year, DOY) from m) union all select solution_id, 'anew' from solutions where (Year, DOY) in (select (Year, DOY) from m)"""
)
def stack_parts(spark, sf):
    s = rows(spark, sf, "solutions")
    kept, anew = alignment.build_stack(s, s.filter("price > 20000"))
    return kept.select("solution_id", F.lit("stack").alias("part")).union(anew.select("solution_id", F.lit("anew")))


@query(f"{with_('solutions')} select NetworkCode, StationCode, round(avg(X), 6) X, round(avg(Y), 6) Y, round(avg(Z), 6) Z from solutions group by 1, 2")
def mean_of_days(spark, sf):
    return alignment.mean_positions(rows(spark, sf, "solutions")).select(*KEY, *[F.round(c, 6).alias(c) for c in "XYZ"])


@query(
    f"""{with_('solutions')}, s as (select *, Year + DOY / 366.0::double t from solutions), f as (select NetworkCode, StationCode, """
    + ", ".join(f"regr_slope({c}, t) s{c}, regr_intercept({c}, t) i{c}, avg({c}) m{c}" for c in "XYZ")
    + """ from s group by 1, 2 having count(distinct t) > 1) select solution_id, """
    + ", ".join(f"round(i{c} + s{c} * t, 2) {c}" for c in "XYZ")
    + " from s join f using (NetworkCode, StationCode)"
)
def motion_targets(spark, sf):
    """What a pass aligns the days to, for stations of two days and more."""
    s = rows(spark, sf, "solutions")
    several = s.groupBy(*KEY).agg(F.count_distinct("Year", "DOY").alias("n")).filter("n > 1")
    t = alignment.trend_targets(s.join(several, KEY, "left_semi"))
    return t.select("solution_id", *[F.round(c, 2).alias(c) for c in "XYZ"])


@query(
    f"""{with_('solutions')}, p as (select distinct Year, DOY, (DOY % 5)::double rx, (DOY % 3 - 1)::double ry, (Year % 4)::double rz, DOY / 1000.0::double tx, 0.5::double ty, (Year - 1995)::double tz, 2.0::double scale from solutions)
select solution_id, round(X * (1 + 2e-9) + (rz * Y - ry * Z) * 1e-9 + tx, 4) X, round(Y * (1 + 2e-9) + (rx * Z - rz * X) * 1e-9 + ty, 4) Y, round(Z * (1 + 2e-9) + (ry * X - rx * Y) * 1e-9 + tz, 4) Z from solutions join p using (Year, DOY)"""
)
def days_transformed(spark, sf):
    s = rows(spark, sf, "solutions")
    d, y = F.col("DOY"), F.col("Year")
    own = {"rx": d % 5, "ry": d % 3 - 1, "rz": y % 4, "tx": d / 1000.0, "ty": F.lit(0.5), "tz": y - 1995, "scale": F.lit(2.0)}
    p = s.select("Year", "DOY").distinct().withColumns({k: v.cast("double") for k, v in own.items()})
    return alignment.transformed(s, p).select("solution_id", *[F.round(c, 4).alias(c) for c in "XYZ"])


@query(f"""{with_('solutions')} select NetworkCode, StationCode, Year as period, DOY % 3 component, round(avg(price), 4) as value, count(*) n from solutions group by 1, 2, 3, 4""")
def constraints_of_periods(spark, sf):
    s = rows(spark, sf, "solutions").select(*KEY, F.col("Year").alias("period"), (F.col("DOY") % 3).cast("long").alias("component"), F.col("price").alias("value"))
    return alignment.periodic_constraints(s).withColumn("value", F.round("value", 4)).withColumn("component", F.col("component").cast("int"))


@query(
    f"""{with_('stations')}, v as (select *, (2e-9 * auto_z - 1e-9 * auto_y) vx, (1e-9 * auto_x - 3e-9 * auto_z) vy, (3e-9 * auto_y - 2e-9 * auto_x) vz from stations)
select round(3e-9 * 1e9, 4) wx, round(2e-9 * 1e9, 4) wy, round(1e-9 * 1e9, 4) wz, count(*)::bigint n from v"""
)
def plate_rotation(spark, sf):
    """Velocities made from a known rotation give it back."""
    x, y, z = (F.col(f"auto_{c}") for c in "xyz")
    w = (3e-9, 2e-9, 1e-9)
    v = {"vx": w[1] * z - w[2] * y, "vy": w[2] * x - w[0] * z, "vz": w[0] * y - w[1] * x}
    pole = alignment.euler_pole(rows(spark, sf, "stations").withColumns(v), radius=None)
    return spark.createDataFrame([(*[round(float(pole[k]) * 1e9, 4) for k in ("wx", "wy", "wz")], pole["n"])], "wx double, wy double, wz double, n long")


@query(
    f"""{with_('stations', 'files')}, f as (select NetworkCode, StationCode, min(ObservationYear + ObservationDOY / 366.0::double) a, max(ObservationYear + ObservationDOY / 366.0::double) b from files group by 1, 2)
select k from stations s join f using (NetworkCode, StationCode) where lat between -50 and 45 and lon between -170.5 and 120.5 and b - a >= 2.5 and not exists (select 1 from files x where x.status = 'P' and (x.NetworkCode, x.StationCode) = (s.NetworkCode, s.StationCode))"""
)
def plate_stations(spark, sf):
    f = rows(spark, sf, "files").withColumn("y", F.col("ObservationYear") + F.col("ObservationDOY") / 366.0)
    st = rows(spark, sf, "stations").join(archive.time_span(f, "y"), KEY)
    return alignment.plate_candidates(st, f.filter("status = 'P'"), (-50, 45), (-170.5, 120.5)).select("k")


@query(
    f"""{with_('solutions')} select solution_id, round(X - (2e-9 * Z - 1e-9 * Y) * (Year + DOY / 366.0::double - 2000), 4) X, round(Y - (1e-9 * X - 3e-9 * Z) * (Year + DOY / 366.0::double - 2000), 4) Y, round(Z - (3e-9 * Y - 2e-9 * X) * (Year + DOY / 366.0::double - 2000), 4) Z from solutions"""
)
def positions_on_plate(spark, sf):
    s = alignment.plate_fixed(rows(spark, sf, "solutions"), {"wx": 3e-9, "wy": 2e-9, "wz": 1e-9}, 2000.0)
    return s.select("solution_id", *[F.round(c, 4).alias(c) for c in "XYZ"])


# network


@query(
    f"""{with_('stations', 'files', 'solutions')} select distinct f.NetworkCode, f.StationCode, ObservationYear as Year, ObservationDOY DOY, k from files f join stations using (NetworkCode, StationCode)
where Completion >= 0.5 and Interval <= 120 and exists (select 1 from solutions s where s.status = 'F' and (s.Year, s.DOY) = (f.ObservationYear, f.ObservationDOY))"""
)
def stations_active(spark, sf):
    days = rows(spark, sf, "solutions").filter("status = 'F'")
    return network.active_stations(rows(spark, sf, "stations"), rows(spark, sf, "files"), days).select(*KEY, "Year", "DOY", "k")


@query(
    f"""{with_('solutions')}, a as (select distinct NetworkCode, StationCode, Year, DOY, date::date as day from solutions where status = 'F'), s as (select NetworkCode, StationCode, min(day) lo, max(day) hi from a group by 1, 2),
d as (select distinct Year, DOY, date::date as day from solutions)
select NetworkCode, StationCode, count(*) n, min(d.Year * 1000 + d.DOY) first_day, max(d.Year * 1000 + d.DOY) last_day from s join d on day between lo and hi where not exists (select 1 from a where (a.NetworkCode, a.StationCode, a.Year, a.DOY) = (s.NetworkCode, s.StationCode, d.Year, d.DOY)) group by 1, 2"""
)
def station_days_missing(spark, sf):
    s = rows(spark, sf, "solutions")
    day = F.col("Year") * 1000 + F.col("DOY")
    missing = network.missing_station_days(s.filter("status = 'F'"), s)
    return missing.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


PLAN = """now as (select distinct NetworkCode, StationCode, Year from solutions where status <> 'P'), saved as (select distinct NetworkCode, StationCode, Year, solution_id % 4 c from solutions where price > 60000 and Year <> 1995)"""


@query(
    f"""{with_('solutions')}, {PLAN}, m as (select distinct NetworkCode, StationCode, Year from saved), k as (select distinct Year from saved), added as (select * from now where Year in (select Year from k) except select * from m), gone as (select * from saved where (NetworkCode, StationCode, Year) not in (select (NetworkCode, StationCode, Year) from now)),
ch as (select Year from added union select Year from gone)
select 'added' part, count(*) n from added union all select 'fresh', count(*) from now where Year not in (select Year from k) union all select 'keep', count(*) from saved where Year not in (select Year from ch)
union all select 'invalid', count(*) from (select distinct Year, c from saved) where (Year, c) in (select (Year, c) from gone)"""
)
def sessions_planned(spark, sf):
    s = rows(spark, sf, "solutions").withColumn("DOY", F.lit(1))
    active = s.filter("status <> 'P'").select(*KEY, "Year", "DOY").distinct()
    saved = s.filter("price > 60000 and Year <> 1995").select(*KEY, "Year", "DOY", (F.col("solution_id") % 4).alias("cluster")).distinct()
    plan = network.plan_sessions(active, saved, saved.select("Year", "DOY", "cluster").distinct())
    parts = [plan[p].agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("added", "fresh", "keep", "invalid")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    f"""{with_('stations')}, m as (select 2000 as Year, 1 as DOY, k % 20 as cluster, NetworkCode, StationCode, auto_x, auto_y, auto_z from stations), c as (select Year, DOY, cluster, avg(auto_x) x, avg(auto_y) y, avg(auto_z) z from m group by 1, 2, 3)
select Year::integer as Year, DOY::integer DOY, cluster, arg_min(StationCode, (pow(auto_x - x, 2) + pow(auto_y - y, 2) + pow(auto_z - z, 2), NetworkCode, StationCode)) StationCode from m join c using (Year, DOY, cluster) group by 1, 2, 3"""
)
def centroids_snapped(spark, sf):
    st = rows(spark, sf, "stations")
    m = st.select(F.lit(2000).alias("Year"), F.lit(1).alias("DOY"), (F.col("k") % 20).alias("cluster"), *KEY)
    return network.snapped_centroids(m, st).select("Year", "DOY", "cluster", "StationCode")


@query(f"{with_('solutions')} select Year, 1::integer DOY, solution_id % 7 as cluster, count(*) n_stations, round(6.04370855910554 - 0.102313555237178 * count(*) + 0.0206316702864554 * count(*) * count(*), 6) as minutes from solutions group by 1, 2, 3")
def time_of_clusters(spark, sf):
    m = rows(spark, sf, "solutions").select("Year", F.lit(1).alias("DOY"), (F.col("solution_id") % 7).alias("cluster"))
    return network.cluster_times(m).withColumn("minutes", F.round("minutes", 6))


# trajectories


def series(spark: SparkSession, sf: str) -> DataFrame:
    """n, e, u of each solution, in metres about its station."""
    s = rows(spark, sf, "solutions")
    t = F.col("Year") + F.col("DOY") / 366.0
    off = lambda m: ((F.col("solution_id") % m - (m - 1) / 2) / 100).alias
    return s.select(*KEY, "solution_id", t.alias("t"), off(13)("n"), off(11)("e"), off(17)("u"))


SERIES = "ser as (select NetworkCode, StationCode, solution_id, Year + DOY / 366.0::double t, (solution_id % 13 - 6.0::double) / 100 n, (solution_id % 11 - 5.0::double) / 100 e, (solution_id % 17 - 8.0::double) / 100 u from solutions)"


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """A model for every station: constant, velocity, yearly terms, a step and a decay."""
    k = F.col("k").cast("double")
    three = lambda f: F.array(k / f, k / (2 * f), -k / f)
    st = rows(spark, sf, "stations")
    parts = [("poly", 1995.0, 0.0, 1e3), ("poly", 1995.0, 1.0, 1e5), ("sin", 365.25, 0.0, 1e4), ("cos", 365.25, 0.0, 2e4), ("step", 1996.5, 0.0, 1e4), ("decay", 1997.25, 0.5, 3e4)]
    one = lambda p: st.select(*KEY, F.lit(p[0]).alias("term"), F.lit(p[1]).alias("at"), F.lit(p[2]).alias("value"), three(p[3]).alias("params"), three(1e6).alias("sigmas"))
    out = one(parts[0])
    for p in parts[1:]:
        out = out.unionByName(one(p))
    return out


PHASE = "2 * pi() * t"
MODEL = f"k / 1e3 + k / 1e5 * (t - 1995) + k / 1e4 * sin({PHASE}) + k / 2e4 * cos({PHASE}) + case when t > 1996.5 then k / 1e4 else 0 end + case when t > 1997.25 then k / 3e4 * log10(1 + (t - 1997.25) / 0.5) else 0 end"


@query(f"{with_('stations', 'solutions')}, {SERIES}, d as (select distinct NetworkCode, StationCode, t from ser) select NetworkCode, StationCode, round(t, 6) t, round({MODEL}, 5) n, round(({MODEL}) / 2, 5) e, round(-({MODEL}), 5) u from d join stations using (NetworkCode, StationCode)")
def model_at_dates(spark, sf):
    d = series(spark, sf).select(*KEY, "t").distinct()
    return trajectory.evaluate(terms(spark, sf), d).select(*KEY, F.round("t", 6).alias("t"), *[F.round(c, 5).alias(c) for c in "neu"])


@query(f"{with_('stations')} select NetworkCode, StationCode, round(k / 1e5, 8) v_n, round(k / 2e5, 8) v_e, round(-k / 1e5, 8) v_u, round(k / 1e6, 9) s_n from stations")
def velocity_terms(spark, sf):
    return trajectory.velocity(terms(spark, sf)).select(*KEY, *[F.round(f"v_{c}", 8).alias(f"v_{c}") for c in "neu"], F.round("s_n", 9).alias("s_n"))


@query(f"{with_('stations')} select NetworkCode, StationCode, 365.25::double period_days, round(sqrt(pow(k / 1e4, 2) + pow(k / 2e4, 2)), 7) amp_n from stations")
def seasonal_amplitudes(spark, sf):
    return trajectory.seasonal(terms(spark, sf)).select(*KEY, "period_days", F.round("amp_n", 7).alias("amp_n"))


@query(f"{with_('stations', 'solutions')}, {SERIES} select solution_id, round(n - k / 1e5 * (t - 1995), 7) n, round(e - k / 2e5 * (t - 1995), 7) e, round(u + k / 1e5 * (t - 1995), 7) u from ser join stations using (NetworkCode, StationCode)")
def series_without_velocity(spark, sf):
    m = trajectory.velocity(terms(spark, sf)).withColumn("t_ref", F.lit(1995.0))
    return trajectory.without_velocity(series(spark, sf), m).select("solution_id", *[F.round(c, 7).alias(c) for c in "neu"])


JUMP = "round(year({d})::double + (dayofyear({d}) - 0.5::double) / case when year({d}) % 4 = 0 then 366 else 365 end, 6)"


@query(
    f"""{with_('sessions')}, s as (select *, lag(AntennaCode) over w la, lag(RadomeCode) over w lr, row_number() over w n from sessions window w as (partition by NetworkCode, StationCode order by DateStart))
select NetworkCode, StationCode, 'step' kind, {JUMP.format(d='DateStart')} as at from s where n > 1 and (la <> AntennaCode or lr <> RadomeCode) and StationCode < 's000900'"""
)
def jumps_of_equipment(spark, sf):
    s = rows(spark, sf, "sessions")
    round_year = s.select(*KEY).distinct().withColumn("largest_gap", F.when(F.col("StationCode") < "s000900", 0.1).otherwise(0.5))
    return trajectory.equipment_jumps(s, round_year).select(*KEY, "kind", "at")


@query(
    f"""{with_('solutions')}, f as (select NetworkCode, StationCode, ReferenceFrame, min(Year * 1000 + DOY) d from solutions group by 1, 2, 3), l as (select *, row_number() over (partition by NetworkCode, StationCode order by d) n from f)
select NetworkCode, StationCode, round(d // 1000 + (d % 1000 - 0.5::double) / case when d // 1000 % 4 = 0 then 366 else 365 end, 6) as at from l where n > 1"""
)
def jumps_of_frames(spark, sf):
    return trajectory.frame_jumps(rows(spark, sf, "solutions")).select(*KEY, "at")


@query(
    f"""{with_('solutions')}, {SERIES}, j as (select NetworkCode, StationCode, 1995 + solution_id % 4 as "at" from solutions), s as (select NetworkCode, StationCode, min(t) lo, max(t) hi from ser group by 1, 2)
select NetworkCode, StationCode, j.at::double as "at" from j join s using (NetworkCode, StationCode) where j.at - lo >= 0.5 and hi - j.at >= 1"""
)
def postseismic_stations(spark, sf):
    j = rows(spark, sf, "solutions").select(*KEY, F.lit("both").alias("kind"), (1995 + F.col("solution_id") % 4).cast("double").alias("at"))
    return trajectory.postseismic(series(spark, sf), j).select(*KEY, "at")


@query(
    f"""{with_('solutions')}, c as (select distinct NetworkCode, StationCode, 'ppp' soln, 'jump' as object, Year, DOY from solutions where status = 'F'), x as (select distinct NetworkCode, StationCode, 'ppp' soln, case when DOY % 5 = 0 then 'bad' else 'jump' end as object, Year, DOY, case when DOY % 2 = 0 then 'remove' else 'add' end act from solutions where price > 250000),
g as (select * from x where object = 'jump') select NetworkCode, StationCode, Year, DOY, 'old' origin from c where (NetworkCode, StationCode, Year, DOY) not in (select (NetworkCode, StationCode, Year, DOY) from g) union all select NetworkCode, StationCode, Year, DOY, 'new' from g where act = 'add'"""
)
def parameters_changed(spark, sf):
    s = rows(spark, sf, "solutions")
    keys = [*KEY, F.lit("ppp").alias("soln")]
    current = s.filter("status = 'F'").select(*keys, F.lit("jump").alias("object"), "Year", "DOY", F.lit("old").alias("origin")).distinct()
    d = F.col("DOY")
    changes = s.filter("price > 250000").select(*keys, F.when(d % 5 == 0, "bad").otherwise("jump").alias("object"), "Year", "DOY", F.lit("new").alias("origin"), F.when(d % 2 == 0, "remove").otherwise("add").alias("action")).distinct()
    return trajectory.change_parameters(current, changes).select(*KEY, "Year", "DOY", "origin")


# text outputs


@query(f"{with_('stations')}, n as (select *, row_number() over (order by NetworkCode, StationCode) r from stations) select ((r - 1) // 99)::integer file, format('{{:<24s}} {{:16.4f}}{{:16.4f}}{{:16.4f}}', NetworkCode || '_' || StationCode, auto_x, auto_y, auto_z) as value from n")
def loading_request_lines(spark, sf):
    return sinks.loading_requests(rows(spark, sf, "stations"))


@query(f"{with_('stations')} select format(' {{}}_GPS {{:15.4f}} {{:15.4f}} {{:15.4f}} {{:9.5f}} {{:9.5f}} {{:9.5f}} {{:9.4f}}', upper(StationCode), auto_x, auto_y, auto_z, 0.5::double, 0.25::double, -0.125::double, 2000.5::double) as value from stations")
def apriori_table(spark, sf):
    s = rows(spark, sf, "stations").withColumnsRenamed({f"auto_{c}": c.upper() for c in "xyz"})
    return sinks.apriori_lines(s.withColumns({"VX": F.lit(0.5), "VY": F.lit(0.25), "VZ": F.lit(-0.125), "epoch": F.lit(2000.5)}))


@query(f"{with_('stations')} select format('{{}} {{}}_GPS {{:8.3f}} {{:8.3f}} {{:8.3f}}', upper(StationCode), upper(StationCode), (k % 7)::double, 0.5::double, 0.25::double) as value from stations")
def sigma_table(spark, sf):
    s = rows(spark, sf, "stations").withColumns({"sigma_n": (F.col("k") % 7).cast("double"), "sigma_e": F.lit(0.5), "sigma_u": F.lit(0.25)})
    return sinks.sigma_lines(s)


@query(f"{with_('stations')} select format('{{}}.{{}} {{:12.7f}} {{:12.7f}} {{:9.5f}} {{:9.5f}}', NetworkCode, StationCode, lon, lat, 0.5::double, -0.25::double) as value from stations")
def motion_grid(spark, sf):
    return sinks.motion_lines(rows(spark, sf, "stations").withColumns({"v_e": F.lit(0.5), "v_n": F.lit(-0.25)}))


@query(f"{with_('files')} select lower(StationCode) file, ' ' || rpad(upper(StationCode)[1:4], 4, ' ') || ' ' || format('{{:02d}}:{{:03d}}:{{:05d}}', ObservationYear % 100, ObservationDOY, epoch(ObservationSTime)::bigint % 86400) || format('{{:9.1f}}{{:6.1f}}', (file_id % 300)::double, 4.0::double) as value from files")
def delay_table(spark, sf):
    d = rows(spark, sf, "files").withColumnRenamed("ObservationSTime", "Date").withColumns({"ZTD": (F.col("file_id") % 300) / 1000, "sigma": F.lit(0.004)})
    return sinks.delay_lines(d)
