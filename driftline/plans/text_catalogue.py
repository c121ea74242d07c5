"""Registered queries of the text formats and of the smaller column functions.

Each format is rendered from the driver's tables, a bounded number of rows a file, and read back by its parser; the oracle
states the values that went in, so that columns, marks, gaps and bad numbers of a format are all checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import arrays, calendar, geodesy, text
from driftline.operators import quality, selection
from driftline.operators.selection import KEY
from driftline.plans.catalogue import query
from driftline.plans.station_catalogue import rows, with_
from driftline.session import table
from driftline.sources import parsers, sinks


def files(lines: DataFrame, block: str, order: str, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """path and text of a file for each block of rows: their lines in order between head and tail."""
    own = F.array_sort(F.collect_list(F.struct(F.expr(order).alias("o"), line.alias("l"))))
    body = F.array_join(F.transform(own, lambda x: x["l"]), "\n")
    return lines.groupBy(F.concat(F.lit("f"), F.expr(block).cast("string")).alias("path")).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def minute(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


STAMP = "'%Y-%m-%d %H:%M:%S'"


# equipment


@query(
    f"""{with_('sessions')} select concat('id', session_id) StationName, concat('s', lpad(cast(session_id % 1000 as varchar), 3, '0')) StationCode, strftime(DateStart, {STAMP}) DateStart, strftime(DateEnd, {STAMP}) DateEnd,
session_id % 30000 / 10000.0::double AntennaHeight, (session_id % 21 - 10) / 10.0::double AntennaEast, ReceiverSerial, AntennaCode, RadomeCode from sessions"""
)
def equipment_lines_read(spark, sf):
    """Equipment records written as lines of 200 a file and read again."""
    own = rows(spark, sf, "sessions").withColumns(
        {
            "StationName": F.concat(F.lit("id"), "session_id"), "StationCode": F.expr("concat('s', lpad(cast(session_id % 1000 as string), 3, '0'))"), "AntennaHeight": F.expr("session_id % 30000 / 10000D"),
            "HeightCode": F.lit("DHARP"), "AntennaNorth": F.lit(0.0), "AntennaEast": F.expr("(session_id % 21 - 10) / 10D"), "ReceiverCode": F.lit("TRIMBLE NETR9"), "ReceiverVers": F.lit("4.60"),
            "ReceiverFirmware": F.lit("4.60"), "AntennaSerial": F.lit("77"),
        }
    )
    lines = parsers.record_line(own).withColumn("n", F.expr("cast(trim(substr(value, 10, 14)) as bigint)"))
    read = parsers.station_info(files(lines, "n div 200", "n", F.col("value"), "*SITE  Station Name\n"))
    return read.select("StationName", "StationCode", minute("DateStart").alias("DateStart"), minute("DateEnd").alias("DateEnd"), "AntennaHeight", "AntennaEast", "ReceiverSerial", "AntennaCode", "RadomeCode")


@query(
    f"""with c as (select c_custkey k, timestamp '2000-01-01' + to_days(cast(c_custkey % 700 as int)) d, timestamp '9999-12-31' far from customer),
r as (select k, 'r1' n, d s, d + to_days(500) e from c union all select k, 'r2', d + to_days(500), case when k % 2 = 0 then far else d + to_days(2000) end from c),
a as (select k, 'a1' n, d s, d + to_days(cast(300 + k % 400 as int)) e, 0.05::double h from c union all select k, 'a2', d + to_days(cast(300 + k % 400 as int)), far, (k % 50) / 1000.0::double from c),
s as (select k, s from r union select k, s from a), n as (select k, s, coalesce(lead(s) over (partition by k order by s), timestamp '9999-12-31') nxt from s)
select concat('f', n.k) path, r.n ReceiverSerial, a.n AntennaSerial, a.h AntennaHeight, strftime(n.s, {STAMP}) DateStart, strftime(nullif(least(nxt, r.e, a.e), timestamp '9999-12-31'), {STAMP}) DateEnd
from n join r on r.k = n.k and n.s >= r.s and n.s < r.e join a on a.k = n.k and n.s >= a.s and n.s < a.e"""
)
def site_logs_read(spark, sf):
    """Receiver and antenna blocks of a log for each station, cut at each other's dates."""
    c = table(spark, sf, "customer").selectExpr("c_custkey k", "date_add(date'2000-01-01', cast(c_custkey % 700 as int)) d")
    day = lambda e: F.date_format(F.expr(e), "yyyy-MM-dd'T00:00Z'")
    open_ = F.lit("CCYY-MM-DDThh:mmZ")
    change = "date_add(d, cast(300 + k % 400 as int))"
    parts = [
        F.lit("1. Site\n3.1  Receiver Type : T1\n     Serial Number : r1\n     Firmware Version : 1.0\n     Date Installed : "), day("d"), F.lit("\n     Date Removed : "), day("date_add(d, 500)"),
        F.lit("\n3.2  Receiver Type : T2\n     Serial Number : r2\n     Firmware Version : 2.0\n     Date Installed : "), day("date_add(d, 500)"), F.lit("\n     Date Removed : "),
        F.when(F.col("k") % 2 == 0, open_).otherwise(day("date_add(d, 2000)")), F.lit("\n3.x  Receiver Type : (A20)\n     Date Installed : CCYY-MM-DDThh:mmZ"),
        F.lit("\n4.1  Antenna Type : A1   NONE\n     Serial Number : a1\n     Marker->ARP Up Ecc. (m) : 0.0500\n     Antenna Radome Type : NONE\n     Date Installed : "), day("d"), F.lit("\n     Date Removed : "), day(change),
        F.lit("\n4.2  Antenna Type : A2   SCIS\n     Serial Number : a2\n     Marker->ARP Up Ecc. (m) : "), F.expr("format_string('%.4f', (k % 50) / 1000D)"),
        F.lit("\n     Antenna Radome Type : SCIS\n     Date Installed : "), day(change), F.lit("\n     Date Removed : "), open_, F.lit("\n5.1  Other\n"),
    ]
    read = parsers.site_log(c.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.concat(*parts).alias("text")))
    return read.select("path", "ReceiverSerial", "AntennaSerial", "AntennaHeight", minute("DateStart").alias("DateStart"), minute("DateEnd").alias("DateEnd"))


@query("select distinct concat('f', p_partkey // 100) path, concat('TRM', p_partkey % 70, '.00') AntennaCode from part")
def antennas_listed(spark, sf):
    """Antenna codes of calibration files, repeats and radomes left out."""
    line = F.concat(F.lit(" " * 60 + "START OF ANTENNA\nTRM"), F.expr("cast(p_partkey % 70 as string)"), F.lit(".00     NONE                                        TYPE / SERIAL NO\n" + " " * 60 + "END OF ANTENNA"))
    return parsers.antenna_names(files(table(spark, sf, "part"), "p_partkey div 100", "p_partkey", line, "     1.4            M                                       ANTEX VERSION / SYST\n"))


# solutions


def solution_files(spark: SparkSession, sf: str) -> DataFrame:
    """SINEX texts of 50 solutions, with a second point of each site and the covariance of its three coordinates."""
    # a file's solutions are brought together before they become lines, which are twenty times as long
    s = rows(spark, sf, "solutions").select("solution_id", "X", "Y", "Z").repartition(F.expr("solution_id div 50"))
    s = s.withColumns({"k": F.expr("solution_id % 50"), "site": F.concat(F.lit("s"), "solution_id")})

    def estimate(j: int, kind: str, axis: str, point: str, value: str) -> Column:
        return F.format_string(f"%6d {kind}{axis}   %s  {point}    1 20:180:43200 m    2 %21.14E %.5E", F.expr(f"6 * k + {j}"), "site", F.expr(f"cast({value} as double)"), F.expr(f"(solution_id % 97 + {j}) / 1000D"))

    matrix = lambda i: F.format_string("%6d %6d  %s", F.expr(f"3 * k + {i}"), F.expr("3 * k + 1"), F.array_join(F.array(*[F.expr(f"concat('0.', solution_id % 9 + 1, {i}, {j}, 'D-05')") for j in range(1, i + 1)]), "  "))
    parts = {
        0: [F.concat(F.lit(" "), "site", F.lit("  A 82397M"), F.lpad(F.expr("cast(k as string)"), 3, "0"), F.lit(" P , SOMEWHERE"))],
        1: [estimate(j, "STA", a, "A", a) for j, a in enumerate("XYZ", 1)] + [estimate(j, "VEL", a, "A", f"(solution_id % 41 - 20) * {j} / 1000D") for j, a in enumerate("XYZ", 4)] + [estimate(1, "STA", "X", "B", "1")],
        2: [matrix(i) for i in (1, 2, 3)],
    }
    # a solution's lines of each section are one string, and a file's strings are put in order
    cut = [F.concat_ws("\n", *cs).alias(f"p{n}") for n, cs in parts.items()]
    own = s.select("solution_id", "k", *cut).groupBy(F.expr("solution_id div 50").alias("file"))
    own = own.agg(F.array_sort(F.collect_list(F.struct("k", "p0", "p1", "p2"))).alias("all"), F.sum(F.expr("solution_id % 100")).alias("n"), F.count_distinct("k").alias("m"))
    part = lambda n: F.array_join(F.transform("all", lambda x: x[f"p{n}"]), "\n")
    pieces = [
        F.lit("%=SNX 1.00\n+SITE/ID\n*CODE PT __DOMES__ T\n"), part(0), F.lit("\n-SITE/ID\n+SOLUTION/STATISTICS\n VARIANCE FACTOR                    "), F.format_string("%.3f", F.expr("file % 1000 / 1000D")),
        F.lit("\n NUMBER OF OBSERVATIONS    "), F.col("n").cast("string"), F.lit("\n NUMBER OF UNKNOWNS    "), (F.col("m") * 3).cast("string"), F.lit("\n-SOLUTION/STATISTICS\n+SOLUTION/ESTIMATE\n*INDEX TYPE CODE\n"),
        part(1), F.lit("\n-SOLUTION/ESTIMATE\n+SOLUTION/MATRIX_ESTIMATE L COVA\n*PARA1 PARA2\n"), part(2), F.lit("\n-SOLUTION/MATRIX_ESTIMATE L COVA\n%ENDSNX\n"),
    ]
    return own.select(F.concat(F.lit("f"), F.col("file").cast("string")).alias("path"), F.concat(*pieces).alias("text"))


@query(
    f"""{with_('solutions')} select concat('f', solution_id // 50) path, concat('s', solution_id) site, X, Y, Z, (solution_id % 97 + 1) / 1000.0::double sX, (solution_id % 97 + 2) / 1000.0::double sY, (solution_id % 97 + 3) / 1000.0::double sZ,
(solution_id % 41 - 20) * 4 / 1000.0::double VX, (solution_id % 41 - 20) * 5 / 1000.0::double VY, (solution_id % 41 - 20) * 6 / 1000.0::double VZ, concat('82397M', lpad(cast(solution_id % 50 as varchar), 3, '0')) domes from solutions"""
)
def solution_sites_read(spark, sf):
    """Positions, sigmas and velocities of the sites' first points, with their DOMES numbers."""
    return parsers.sinex_sites(solution_files(spark, sf))


@query(
    f"""{with_('solutions')}, e(i, j) as (values (1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)) select concat('f', solution_id // 50) path, cast(3 * (solution_id % 50) + i as int) "row", cast(3 * (solution_id % 50) + j as int) "column",
cast(concat('0.', solution_id % 9 + 1, i, j, 'E-05') as double) "value" from solutions, e"""
)
def solution_covariances_read(spark, sf):
    """The lower triangle of each site's covariance, from lines of up to three entries."""
    return parsers.sinex(solution_files(spark, sf))["covariance"]


@query(f"""{with_('solutions')} select concat('f', solution_id // 50) path, (solution_id // 50) % 1000 / 1000.0::double variance_factor, sum(solution_id % 100)::bigint n_observations, 3 * count(*) n_unknowns from solutions group by solution_id // 50""")
def solution_statistics_read(spark, sf):
    """The statistics block."""
    return parsers.sinex(solution_files(spark, sf))["statistics"]


@query(
    f"""{with_('solutions')}, s as (select solution_id // 8 g, solution_id % 8 p, solution_id % 4 c from solutions), f as (select g, c, row_number() over (partition by g order by min(p)) - 1 level from s group by g, c)
select concat('m', g) site, concat('p', p) path, cast(level as int) level from s join f using (g, c)"""
)
def solution_sites_merged(spark, sf):
    """Sites of eight solutions; of one name those within a metre are one."""
    s = rows(spark, sf, "solutions").selectExpr("concat('m', solution_id div 8) site", "concat('p', solution_id % 8) path", "solution_id % 4 * 100D + solution_id % 3 / 10D X", "0D Y", "0D Z")
    return parsers.merge_sites(s).select("site", "path", "level")


@query(
    f"""{with_('solutions')} select concat('f', solution_id) path, case when solution_id % 11 <> 0 then X end X, Y, case when solution_id % 13 <> 0 then Z end Z, (solution_id % 90 + 1) / 10000.0::double sigmay, (solution_id % 2001 - 1000) / 8.0::double clock_phase,
solution_id % 2880 n_processed, solution_id % 77 n_rejected, solution_id % 11 <> 0 and solution_id % 13 <> 0 ok from solutions"""
)
def positioning_summaries_read(spark, sf):
    """Coordinates of NaN or stars are null and the file is not ok."""
    f = F.format_string
    sigma = F.expr("(solution_id % 90 + 1) / 10000D")
    axis = lambda a, bad, word: F.concat(F.lit(f" {a} (m)  0.0000  "), F.when(F.expr(bad), F.lit(word)).otherwise(f("%.4f", a)), F.lit("  "), f("%.4f", sigma), F.lit("\n"))
    parts = [
        axis("X", "solution_id % 11 = 0", "NaN"), axis("Y", "false", ""), axis("Z", "solution_id % 13 = 0", "**************"), f("Clock Phase (ns) : %.3f\n", F.expr("(solution_id % 2001 - 1000) / 8D")),
        f("Number of epochs processed : %d\n", F.expr("solution_id % 2880")), f("Number of epochs rejected  : %d\n", F.expr("solution_id % 77")),
    ]
    read = parsers.positioning_summary(rows(spark, sf, "solutions").select(F.concat(F.lit("f"), "solution_id").alias("path"), F.concat(*parts).alias("text")))
    return read.select("path", "X", "Y", "Z", "sigmay", "clock_phase", "n_processed", "n_rejected", "ok")


@query(
    """select concat('e', event_id) alias, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') "at", (event_id % 999) / 10000.0::double model, (event_id % 90 + 1) / 10000.0::double sigma, (20000 + event_id % 5000) / 10000.0::double ZTD from events"""
)
def zenith_lines_read(spark, sf):
    """Zenith delay knots among other lines."""
    f = F.format_string("ATM_ZEN X E%d 02 %s 12 %.4f +- %.4f %.4f\nATM_GRD N E%d", "event_id", F.date_format("ts", "yyyy MM dd HH mm"), F.expr("event_id % 999 / 10000D"), F.expr("(event_id % 90 + 1) / 10000D"), F.expr("(20000 + event_id % 5000) / 10000D"), "event_id")
    read = parsers.zenith_delays(files(table(spark, sf, "events"), "event_id div 500", "event_id", f, "Number of knots\n"))
    return read.select("alias", F.date_format("Date", "yyyy-MM-dd HH:mm").alias("at"), "model", "sigma", "ZTD")


@query(
    """select concat('p', o_orderkey) Project, cast(case when o_orderkey % 4 = 0 then 0 else o_orderkey % 100 end as int) subnet, cast(year(o_orderdate) as int) "Year", cast(dayofyear(o_orderdate) as int) DOY, case when o_orderkey % 7 <> 0 then concat('node', o_orderkey % 9) end node,
cast(o_orderkey % 3 + 1 as int) iterations, (o_orderkey % 50 + 10 * (o_orderkey % 3 + 1)) / 100.0::double nrms, cast(case when o_orderkey % 10 <> 0 then 60 + o_orderkey % 50 end as int) runtime from orders"""
)
def run_logs_read(spark, sf):
    """Logs of one to three passes; some without a sub-network, a node or an end."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.expr("cast(o_orderkey % 3 + 1 as int)")
    step = lambda i: F.concat(F.lit("run.sh ("), day, F.format_string(" 01:%02d:00): Iteration depth: %d\nPrefit nrms:  0.1E+01    Postfit nrms: %.2E\n", (i - 1) * 10, i, (F.expr("o_orderkey % 50") + 10 * i) / 100.0))
    subnet = F.when(F.expr("o_orderkey % 4 = 0"), F.lit("")).otherwise(F.format_string(".sub%02d", F.expr("o_orderkey % 100")))
    end = F.when(F.expr("o_orderkey % 10 = 0"), F.lit("")).otherwise(F.concat(F.lit("finish.sh ("), day, F.format_string(" %02d:%02d:00): Done processing h-files\n", F.expr("2 + (o_orderkey % 50) div 60"), F.expr("o_orderkey % 50 % 60"))))
    node = F.when(F.expr("o_orderkey % 7 = 0"), F.lit("")).otherwise(F.format_string("executing on node%d\n", F.expr("o_orderkey % 9")))
    head = F.concat(F.format_string("GamitTask initialized for p%d", "o_orderkey"), subnet, F.date_format("o_orderdate", "': 'yyyy D'\n'"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), n), step), "")
    read = parsers.run_logs(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.concat(head, node, body, end).alias("text")))
    return read.select("Project", "subnet", "Year", "DOY", "node", "iterations", "nrms", "runtime")


# models and lists


@query("select concat('s', s_suppkey) station, array_to_string(list_transform(range(1, 7), lambda i: printf('%.5f %.5f', (s_suppkey * i % 997) / 100000.0, -(s_suppkey * i % 89) / 100000.0)), ' ') coefficients from supplier")
def loading_blocks_read(spark, sf):
    """Stations and coefficients of ocean loading files, remarks between them left out."""
    row = lambda i: F.format_string("  %.5f  %.5f", F.expr("s_suppkey") * i % 997 / 100000.0, -(F.expr("s_suppkey") * i % 89) / 100000.0)
    block = F.concat(F.format_string("  S%d\n$$ a remark\n$$ another\n", "s_suppkey"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), row), "\n"))
    read = parsers.ocean_loading(files(table(spark, sf, "supplier"), "s_suppkey div 50", "s_suppkey", block, "$$ Ocean loading displacement\n", "\n"))
    return read.select("station", F.regexp_replace("coefficients", r"\s+", " ").alias("coefficients"))


@query("select concat('n1.s', c_custkey) station, case when c_custkey % 9 = 0 then 'NaN'::double else (c_custkey + 0.25)::double end x, (2000 + c_custkey % 30 + 0.5)::double epoch, (c_custkey % 50 + 3)::double / 1000.0::double vz_mm, (c_custkey % 100 + 7.5)::double / 1000.0::double n_sin_annual, (c_custkey % 100 + 18.5)::double / 1000.0::double u_cos_half from customer where c_custkey % 17 <> 0")
def constraint_lines_read(spark, sf):
    """Constraints of 20 columns; lines of other lengths and remarks are passed over."""
    value = {0: "case when c_custkey % 9 = 0 then 'NaN' else format_string('%.4f', c_custkey + 0.25D) end", 3: "format_string('%.4f', 2000.5D + c_custkey % 30)", 6: "format_string('%.4f', c_custkey % 50 + 3D)"}
    each = [F.expr(value.get(i, f"format_string('%.4f', c_custkey % 100 + {i}.5D)")) for i in range(19)]
    line = F.when(F.expr("c_custkey % 17 = 0"), F.format_string(" n1.s%d 1.0", "c_custkey")).otherwise(F.concat_ws(" ", F.format_string(" n1.s%d", "c_custkey"), *each))
    read = parsers.constraints(files(table(spark, sf, "customer"), "c_custkey div 100", "c_custkey", line, "* remarks\n"))
    return read.select("station", "x", "epoch", (F.col("vz") / 1000.0).alias("vz_mm"), "n_sin_annual", "u_cos_half")


@query(
    """select concat('s', lpad(cast(c_custkey as varchar), 6, '0')) station, period, component, round((c_custkey % 900 + add + 0.5) / 1000.0::double, 9) "sin", round((c_custkey % 700 + add + 0.25) / 1000.0::double, 9) "cos"
from customer, (values (365.25::double, 'n', 0), (365.25::double, 'e', 10), (182.625::double, 'n', 20), (182.625::double, 'e', 30)) t(period, component, add)"""
)
def periodic_files_read(spark, sf):
    """The mean of two files' sine and cosine of each station, period and component."""
    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    row = lambda name, add: F.format_string(f" s%06d A 123456789 1 {name}  %07.2f %07.2f %07.2f", "c_custkey", F.expr(f"c_custkey % 700 + {add}.25D + 2 * j - 1"), F.lit(0.1), F.expr(f"c_custkey % 900 + {add}.5D + 2 * j - 1"))
    lines = c.select("c_custkey", "j", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), row(n, a).alias("l")) for o, n, a in ((1, "N", 0), (1, "E", 10), (3, "N", 20), (3, "E", 30))])).alias("x")).select("c_custkey", "j", "x.o", "x.l")
    heads = lines.selectExpr("c_custkey div 100 * 100 c_custkey", "j", "explode(array(struct(0 o, 'Frequency 1 : 365.250' l), struct(2 o, 'Frequency 2 : 182.625' l))) x").distinct().select("c_custkey", "j", "x.o", "x.l")
    read = parsers.periodic_space(files(lines.union(heads), "concat(c_custkey div 100, '.', j)", "struct(o, c_custkey)", F.col("l")))
    return read.select("station", "period", "component", F.round("sin", 9).alias("sin"), F.round("cos", 9).alias("cos"))


@query(f"{with_('stations')} select concat(NetworkCode, '.', StationCode) station, case when k % 3 = 0 then '' else concat('a', k % 5, '|b', k % 7) end parameters from stations")
def station_lists_read(spark, sf):
    """Stations in capitals with further parameters, between remarks and empty lines."""
    line = F.concat(F.upper(text.station_key(F.col("NetworkCode"), F.col("StationCode"))), F.expr("case when k % 3 = 0 then '' else concat('  a', k % 5, ' b', k % 7) end"), F.expr("case when k % 4 = 0 then '\n\n  # a remark' else '' end"))
    read = parsers.station_list(files(rows(spark, sf, "stations"), "k div 100", "k", line, "# stations\n"))
    return read.select("station", F.array_join("parameters", "|").alias("parameters"))


@query(f"{with_('stations')} select concat(NetworkCode, '.', StationCode) name, lon, lat, height from stations")
def placemarks_read(spark, sf):
    """Stations written as placemarks, a folder without a point among them, and read again."""
    lines = sinks.placemark_lines(rows(spark, sf, "stations"), F.lit("a station")).withColumn("n", F.regexp_extract("value", r"\.s(\d+)<", 1).cast("long"))
    head, tail = '<?xml version="1.0"?><kml><Document>', "<Placemark><name>a line</name><LineString/></Placemark></Document></kml>"
    return parsers.placemarks(files(lines, "n div 100", "n", F.col("value"), head, tail)).select("name", "lon", "lat", "height")


@query(f"{with_('stations')} select NetworkCode, StationCode, k, lat, max_dist, alias from stations")
def packages_read(spark, sf):
    """Stations exported as JSON, a file each, and read again; nulls come back as nulls."""
    own = rows(spark, sf, "stations").select(*KEY, "k", "lat", "max_dist", "alias")
    exported = sinks.as_json(own, "text").withColumn("path", F.sha1("text"))
    return parsers.packages(exported, own.schema.simpleString()).select("station.*")


# dates


@query("select o_orderkey, case when o_orderkey % 6 < 4 then strftime(o_orderdate, '%Y-%m-%d') end parsed from orders")
def days_of_texts(spark, sf):
    """Days in four notations; other texts and a month 13 are null."""
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    d, year = F.col("d"), F.year("d")
    fraction = F.format_string("%.6f", year + (F.dayofyear("d") - 0.5) / calendar.days_in_year(year))
    notations = [F.date_format("d", "yyyy/M/d"), F.concat_ws("_", year, F.dayofyear("d")), F.concat_ws("-", F.lpad(calendar.gps_week(d).cast("string"), 4, "0"), calendar.gps_day(d).cast("string")), fraction, F.lit("no day"), F.date_format("d", "d.M.yyyy")]
    choice = F.element_at(F.array(*notations), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", F.date_format(calendar.parse_day(choice), "yyyy-MM-dd").alias("parsed"))


@query(
    """with s as (select c_custkey k, date '2020-01-01' + cast(c_custkey % 400 as int) a, date '2020-01-01' + cast(c_custkey % 400 + c_custkey % 61 as int) b from customer)
select k, strftime(x, '%Y-%m-%d') segment_start, strftime(least(x + to_days(14), b), '%Y-%m-%d') segment_end, strftime(x + to_seconds(86399), '%Y-%m-%d %H:%M:%S') last_second from (select k, b, unnest(generate_series(a::timestamp, b::timestamp, interval 14 day)) x from s)"""
)
def spans_in_segments(spark, sf):
    """Requests of at most 14 days, with the last second of their first day."""
    s = table(spark, sf, "customer").selectExpr("c_custkey k", "date_add(date'2020-01-01', cast(c_custkey % 400 as int)) a", "date_add(date'2020-01-01', cast(c_custkey % 400 + c_custkey % 61 as int)) b")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return calendar.segments(s, "a", "b").select("k", day("segment_start").alias("segment_start"), day("segment_end").alias("segment_end"), minute(calendar.day_bounds(F.col("segment_start"))[1]).alias("last_second"))


# columns


@query("select user_id, floor(value) * 10 kept from events where value is not null group by user_id, floor(value)")
def values_apart(spark, sf):
    """Values that lie less than five apart are one."""
    e = table(spark, sf, "events").filter("value is not null").selectExpr("user_id", "cast(floor(value) * 10 + event_id % 3 as double) v", "cast(floor(value) * 10 as double) w")
    both = e.select("user_id", "v").union(e.select("user_id", F.col("w").alias("v")))
    return selection.distinct_within(both, ["user_id"], "v", 5.0).withColumnRenamed("v", "kept")


@query("select o_orderkey, printf('%04d %03d', year(o_orderdate)::int, dayofyear(o_orderdate)::int) day_key, concat('pub/', year(o_orderdate), '/', printf('%03d', dayofyear(o_orderdate)::int), '/x', o_orderkey % 10, '.gz') path from orders where printf('%04d %03d', year(o_orderdate)::int, dayofyear(o_orderdate)::int) between '1995 030' and '1997 200'")
def paths_of_tags(spark, sf):
    """Paths from a template with tags, of files whose day lies in a range of texts."""
    d = F.col("o_orderdate")
    o = table(spark, sf, "orders").withColumn("day_key", text.year_key(F.year(d), F.dayofyear(d))).filter("day_key between '1995 030' and '1997 200'")
    tags = {"year": F.year(d), "doy": F.format_string("%03d", F.dayofyear(d)), "session": F.col("o_orderkey") % 10}
    return o.select("o_orderkey", "day_key", text.tagged_path(F.lit("pub/${year}/${doy}/x${session}.gz"), tags).alias("path"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else c_custkey % 4 end n, c_custkey % 4 >= 2 has_half from customer where c_custkey % 25 in (1, 2, 3, 4, 5, 6, 9, 22, 23, 24)")
def periods_counted(spark, sf):
    """Lengths of arrays (null for none), membership, and numbers chosen by a list of ranges."""
    c = table(spark, sf, "customer").withColumn("frequencies", F.expr("slice(array(1D, 0.5D, 0.25D), 1, cast(c_custkey % 4 as int))"))
    chosen = selection.integer_set("<3;3-6;9;>21", 24)
    return c.filter((F.col("c_custkey") % 25).isin(chosen)).select("c_custkey", arrays.array_length(F.col("frequencies")).cast("long").alias("n"), selection.member(F.lit(0.5), "frequencies").alias("has_half"))


@query("select distinct unnest([s_nationkey::bigint, s_suppkey % 7 + 100]) codes from supplier")
def entries_of_arrays(spark, sf):
    """The distinct entries of all rows' arrays."""
    return arrays.all_entries(table(spark, sf, "supplier").selectExpr("array(cast(s_nationkey as bigint), s_suppkey % 7 + 100) codes"), "codes")


@query(f"{with_('stations')} select k, round(lat, 8) lat, round(lon, 8) lon, round(lat, 6) map_lat, round(lon, 6) map_lon from stations")
def maps_and_back(spark, sf):
    """M6, M9: to the sphere and back, and to the map around a station's neighbourhood and back."""
    s = rows(spark, sf, "stations").withColumn("p", geodesy.on_sphere(F.col("lat"), F.col("lon"), 6371.0))
    own = geodesy.spherical(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    lat0, lon0 = F.col("lat") + 7.5, F.col("lon") - 11.0
    s = s.withColumn("s", own).withColumn("m", geodesy.azimuthal(F.col("lat"), F.col("lon"), lat0, lon0))
    back = geodesy.from_azimuthal(F.col("m.x"), F.col("m.y"), lat0, lon0)
    return s.withColumn("b", back).select("k", *[F.round(f"s.{c}", 8).alias(c) for c in ("lat", "lon")], *[F.round(f"b.{c}", 6).alias(f"map_{c}") for c in ("lat", "lon")])


@query("select o_orderkey, concat('A', o_orderkey % 40) AntennaCode from orders where concat('A', o_orderkey % 40) in (select concat('A', s_suppkey % 23) from supplier)")
def equipment_listed(spark, sf):
    """Records whose antenna is listed."""
    listed = table(spark, sf, "supplier").selectExpr("concat('A', s_suppkey % 23) code")
    return text.valid_equipment(table(spark, sf, "orders").selectExpr("o_orderkey", "concat('A', o_orderkey % 40) AntennaCode"), "AntennaCode", listed, "code")


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(concat('<script>a()</script>', chr(10), coalesce(text, ''), chr(10), 'ü'), '[^\x00-\x7F]+', '', 'g'), '(?im)^\s*<script.*?</script>\s*$', '', 'g')) digest from documents""")
def texts_plain(spark, sf):
    """Texts without characters beyond ASCII and lines of scripts."""
    own = F.concat(F.lit("<script>a()</script>\n"), F.coalesce("text", F.lit("")), F.lit("\nü"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.plain_event(own)).alias("digest"))


@query(
    f"""{with_('stations')}, there as (select s_suppkey * 37 % 1200 a, s_suppkey * 91 % 3599 b, concat('s', lpad(cast(s_suppkey * 3 as varchar), 6, '0')) code from supplier)
select NetworkCode, StationCode from stations where (k * 37 % 1200, k * 91 % 3599) not in (select (a, b) from there) and StationCode not in (select code from there)"""
)
def stations_not_elsewhere(spark, sf):
    """Q15: stations that another archive holds neither at their place nor by their code."""
    here = rows(spark, sf, "stations").select(*KEY, "lat", "lon")
    there = table(spark, sf, "supplier").selectExpr("'x' NetworkCode", "concat('s', lpad(cast(s_suppkey * 3 as string), 6, '0')) StationCode", "cast(s_suppkey * 37 % 1200 as double) / 10 - 60 lat", "cast(s_suppkey * 91 % 3599 as double) / 10 - 179.9 lon")
    return quality.missing_elsewhere(here, there).select(*KEY)
