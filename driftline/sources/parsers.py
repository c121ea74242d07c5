"""Text formats as DataFrames (S16 to S28): whole files (path, text) in, typed rows out, by built-in expressions.

read() keeps a file's lines together, so that sections can be told apart by a running count within the file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.calendar import date_of, session_instant

NUMBER = r"[-+]?\d*\.?\d+(?:[EeDd][-+]?\d+)?"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """path, number and line."""
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("number", "line"))


def number(text: Column, regex: str, group: int = 1) -> Column:
    """A number behind a pattern, null without one; Fortran exponents are understood."""
    return F.regexp_replace(F.regexp_extract(text, regex, group), "[Dd]", "E").try_cast("double")


def fields(line: Column, widths: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Fixed-width columns, trimmed; start (from 1) and width of each."""
    return {k: F.trim(F.substring(line, a, n)) for k, (a, n) in widths.items()}


# Columns of a station.info line.
STATION_INFO = {
    "StationCode": (2, 4), "StationName": (8, 16), "start": (26, 19), "end": (45, 19), "AntennaHeight": (64, 7), "HeightCode": (73, 5), "AntennaNorth": (80, 7), "AntennaEast": (89, 7),
    "ReceiverCode": (98, 20), "ReceiverVers": (120, 20), "ReceiverFirmware": (142, 5), "ReceiverSerial": (149, 20), "AntennaCode": (171, 15), "RadomeCode": (188, 5), "AntennaSerial": (195, 20),
}


def station_info(files: DataFrame) -> DataFrame:
    """Equipment records; an end of year 9999 is open (null)."""
    own = lines(files).filter(F.col("line").startswith(" ") & (F.length("line") >= 77))
    f = fields(F.col("line"), STATION_INFO)
    numbers = ("AntennaHeight", "AntennaNorth", "AntennaEast")
    typed = {k: v.try_cast("double") if k in numbers else v for k, v in f.items() if k not in ("start", "end", "StationCode")}
    return own.select("path", F.lower(f["StationCode"]).alias("StationCode"), *[v.alias(k) for k, v in typed.items()], session_instant(f["start"]).alias("DateStart"), session_instant(f["end"]).alias("DateEnd"))


def record_line(rows: DataFrame) -> DataFrame:
    """K7: equipment records as station.info lines."""

    def instant(c: str) -> Column:
        t = F.col(c)
        text = F.format_string("%04d %03d %02d %02d %02d  ", F.year(t), F.dayofyear(t), F.hour(t), F.minute(t), F.second(t).cast("int"))
        return F.when(t.isNull(), F.lit("9999 999 00 00 00  ")).otherwise(text)

    cut = lambda c, n: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")
    real = lambda c: F.format_string("%7.4f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    two = F.lit("  ")
    parts = [
        F.lit(" "), cut("StationCode", 4), two, cut("StationName", 16), two, instant("DateStart"), instant("DateEnd"), real("AntennaHeight"), two, cut("HeightCode", 5), two, real("AntennaNorth"), two,
        real("AntennaEast"), two, cut("ReceiverCode", 20), two, cut("ReceiverVers", 20), two, F.lpad(F.coalesce("ReceiverFirmware", F.lit("")), 5, " "), two, cut("ReceiverSerial", 20), two, cut("AntennaCode", 15), two,
        cut("RadomeCode", 5), two, cut("AntennaSerial", 20),
    ]
    return rows.select(F.concat(*parts).alias("value"))


def sections(files: DataFrame) -> DataFrame:
    """Lines of a SINEX file with the section they stand in; lines between sections are left out.

    A text is cut before its marks, so that each part knows its section by its own first line: no line leaves its file's row
    to learn it, and parts that nobody asks for are never cut into lines."""
    parts = F.explode(F.split("text", r"\r?\n(?=\+|-[A-Z]+/)")).alias("part")
    part = files.select("path", parts).filter(F.col("part").startswith("+")).withColumn("section", F.regexp_extract("part", r"^\+(\S+)", 1))
    return part.select("path", "section", F.explode(F.split("part", r"\r?\n")).alias("line")).filter("not line rlike '^[+*-][A-Z/* ]'")


SITE = r"^\s+(\w+)\s+(\w)\s+(\w+)"
ESTIMATE = rf"^\s*\d+\s+(?:STA|VEL)[XYZ]\s+\w+\s+\w\s+\S+\s+\d+:\d+:\d+\s+\S+\s+\d+\s+{NUMBER}\s+{NUMBER}"


def words(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+")


def estimate() -> dict[str, Column]:
    """What the words f of a line that is an ESTIMATE say; every word is a field of its own, so that the line is matched once."""
    f = lambda i: F.get("f", F.lit(i))
    values = {k: number(f(i), rf"^({NUMBER})") for k, i in (("value", 8), ("sigma", 9))}
    return {"index": f(0).cast("int"), "kind": F.substring(f(1), 1, 3), "axis": F.substring(f(1), 4, 1), "site": f(2), "point": f(3), "epoch": f(5), **values}


def sinex(files: DataFrame) -> dict[str, DataFrame]:
    """Sites, estimates (STA and VEL of point A, index, value, sigma), covariance entries and statistics."""
    s = sections(files)
    line = F.col("line")
    sites = s.filter("section = 'SITE/ID'").select("path", F.regexp_extract(line, SITE, 1).alias("site"), F.regexp_extract(line, SITE, 3).alias("domes"))
    estimates = s.filter(F.col("section").startswith("SOLUTION/ESTIMATE") & line.rlike(ESTIMATE)).withColumn("f", words(line)).select("path", *[v.alias(k) for k, v in estimate().items()])
    entries = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    matrix = s.filter(F.col("section").startswith("SOLUTION/MATRIX_ESTIMATE")).withColumn("e", entries)
    matrix = matrix.select("path", F.get("e", F.lit(0)).try_cast("int").alias("row"), F.get("e", F.lit(1)).try_cast("int").alias("first"), F.posexplode(F.slice("e", 3, 3)).alias("k", "v"))
    covariance = matrix.select("path", "row", (F.col("first") + F.col("k")).alias("column"), F.regexp_replace("v", "[Dd]", "E").try_cast("double").alias("value"))
    t = F.col("text")
    statistics = files.select("path", number(t, rf"VARIANCE FACTOR\s+({NUMBER})").alias("variance_factor"), number(t, r"NUMBER OF OBSERVATIONS\s+(\d+)").cast("long").alias("n_observations"), number(t, r"NUMBER OF UNKNOWNS\s+(\d+)").cast("long").alias("n_unknowns"))
    return {"sites": sites, "estimates": estimates.filter("point = 'A'"), "covariance": covariance, "statistics": statistics}


def sinex_sites(files: DataFrame) -> DataFrame:
    """sinex_positions of the sites listed, with their DOMES numbers; a site listed twice is two rows.

    Both sections are read in one pass over the texts and meet in one grouping by site."""
    s = sections(files).filter(F.col("section").startswith("SOLUTION/ESTIMATE") | (F.col("section") == "SITE/ID"))
    line, listed = F.col("line"), F.col("section") == "SITE/ID"
    s = s.filter(listed | line.rlike(ESTIMATE)).withColumn("f", F.when(~listed, words(line)))
    own = estimate()
    rows = s.select("path", F.when(listed, F.regexp_extract(line, SITE, 1)).otherwise(own.pop("site")).alias("site"), F.when(listed, F.regexp_extract(line, SITE, 3)).alias("domes"), *[v.alias(k) for k, v in own.items()])
    rows = rows.filter("domes is not null or point = 'A'")
    found = rows.groupBy("path", "site").agg(F.collect_list("domes").alias("d"), F.count("point").alias("n"), *positions())
    return found.filter("n > 0").select("path", "site", *[c for c in found.columns if c not in ("path", "site", "d", "n")], F.explode("d").alias("domes"))


def positions() -> list[Column]:
    pick = lambda kind, axis, v: F.max(F.when((F.col("kind") == kind) & (F.col("axis") == axis), F.col(v)))
    return [pick("STA", a, "value").alias(a) for a in "XYZ"] + [pick("STA", a, "sigma").alias(f"s{a}") for a in "XYZ"] + [pick("VEL", a, "value").alias(f"V{a}") for a in "XYZ"]


def sinex_positions(estimates: DataFrame) -> DataFrame:
    """One row a site with X, Y, Z, their sigmas, and velocities where given."""
    return estimates.groupBy("path", "site").agg(*positions())


def merge_sites(positions: DataFrame, metres: float = 1.0) -> DataFrame:
    """Sites of several solutions by name and place: `level` 0 for those within a metre of the first solution's site
    of that name, 1 for the next such group, and so on, in order of path."""
    schema = "path string, site string, X double, Y double, Z double, level int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, heads, least = None, [], metres * metres
        for rows in batches:
            level = []
            for own, x, y, z in zip(rows["site"].tolist(), rows["X"].tolist(), rows["Y"].tolist(), rows["Z"].tolist()):
                if own != site or not heads:
                    site, heads = own, []
                for i, (hx, hy, hz) in enumerate(heads):
                    if (hx - x) * (hx - x) + (hy - y) * (hy - y) + (hz - z) * (hz - z) <= least:
                        level.append(i)
                        break
                else:
                    level.append(len(heads))
                    heads.append((x, y, z))
            yield rows.assign(level=np.array(level, np.int32))

    # the sites of a task come one after the other, so that only one site's groups are held, and no site is a call of its own
    placed = positions.select("path", "site", *[F.col(c).cast("double").alias(c) for c in "XYZ"])
    return placed.repartition("site").sortWithinPartitions("site", "path").mapInPandas(run, schema)


def site_log(files: DataFrame) -> DataFrame:
    """Equipment sessions of site logs: receiver and antenna blocks, cut at each other's dates."""
    t = F.col("text")
    when = r"(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2})?)"

    def blocks(number_: int, kind: str, serial: str, extra: dict[str, str]) -> DataFrame:
        found = files.select("path", F.explode(F.regexp_extract_all(t, F.lit(rf"(?ms)^{number_}\.\d+\s.*?(?=^\d+\.[\dx]|\z)"), 0)).alias("b"))
        b = F.col("b")
        value = lambda k: F.trim(F.regexp_extract(b, rf"(?m)^\s*{k}\s*:\s*(.*)$", 1))
        date = lambda k: F.coalesce(F.try_to_timestamp(F.regexp_extract(b, rf"{k}\s*:\s*{when}", 1), F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(F.regexp_extract(b, rf"{k}\s*:\s*{when}", 1), F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")
        return found.select("path", value(kind).alias("code"), value(serial).alias("serial"), *[value(v).alias(k) for k, v in extra.items()], date("Date Installed").alias("s"), date("Date Removed").alias("e"))

    receivers = blocks(3, "Receiver Type", "Serial Number", {"firmware": "Firmware Version"}).filter("s is not null")
    antennas = blocks(4, "Antenna Type", "Serial Number", {"height": r"Marker->ARP Up Ecc\. \(m\)", "radome": "Antenna Radome Type"}).filter("s is not null")
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    starts = receivers.select("path", "s").union(antennas.select("path", "s")).distinct()
    r = receivers.select("path", F.col("code").alias("ReceiverCode"), F.col("serial").alias("ReceiverSerial"), F.col("firmware").alias("ReceiverFirmware"), F.col("s").alias("rs"), F.coalesce("e", far).alias("re"))
    a = antennas.select("path", F.col("code").alias("AntennaCode"), F.col("serial").alias("AntennaSerial"), F.col("radome").alias("RadomeCode"), F.col("height").try_cast("double").alias("AntennaHeight"), F.col("s").alias("as_"), F.coalesce("e", far).alias("ae"))
    j = starts.join(r, "path").filter("s >= rs and s < re").join(a, "path").filter("s >= as_ and s < ae")
    nxt = F.lead("s").over(Window.partitionBy("path").orderBy("s"))
    end = F.least(F.coalesce(nxt, far), F.col("re"), F.col("ae"))
    return j.withColumn("DateEnd", F.nullif(end, far)).withColumnRenamed("s", "DateStart").drop("rs", "re", "as_", "ae")


def positioning_summary(files: DataFrame) -> DataFrame:
    """Coordinate, sigmas, clock and observation counts; a coordinate of NaN or stars is null, `ok` false."""
    t = F.col("text")
    value = r"(-?\d+\.\d+|[nN]a[nN]|\*+)"
    axis = lambda a, i: F.regexp_extract(t, rf"{a}\s\(m\)\s+{value}\s+{value}(?:\s+{value})?", i)
    finite = lambda c: F.when(~F.isnan(c.try_cast("double")), c.try_cast("double"))
    out = files.select(
        "path", *[finite(axis(a, 2)).alias(a) for a in "XYZ"], *[finite(axis(a, 3)).alias(f"sigma{a.lower()}") for a in "XYZ"],
        number(t, rf"Clock Phase\s*\([nm]s\)\s*:\s*({NUMBER})").alias("clock_phase"), number(t, rf"Phase Drift\s*\([nm]s/day\)\s*:\s*({NUMBER})").alias("phase_drift"), number(t, rf"RMS residuals\s*\([nm]s\)\s*:\s*({NUMBER})").alias("clock_rms"),
        number(t, r"(?i)number of epochs processed\D+(\d+)").cast("long").alias("n_processed"), number(t, r"(?i)number of epochs rejected\D+(\d+)").cast("long").alias("n_rejected"),
    )
    return out.withColumn("ok", F.col("X").isNotNull() & F.col("Y").isNotNull() & F.col("Z").isNotNull())


def zenith_delays(files: DataFrame) -> DataFrame:
    """Station alias, minute, correction, sigma and delay of each knot line."""
    p = rf"ATM_ZEN X (\w+) .. (\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+\d*\s*({NUMBER})\s*[+-]*\s*({NUMBER})\s+({NUMBER})"
    own = lines(files).filter(F.col("line").rlike(p))
    i = lambda k: F.regexp_extract("line", p, k).cast("int")
    at = F.make_timestamp_ntz(i(2), i(3), i(4), i(5), i(6), F.lit(0))
    return own.select("path", F.lower(F.regexp_extract("line", p, 1)).alias("alias"), at.alias("Date"), number(F.col("line"), p, 7).alias("model"), number(F.col("line"), p, 8).alias("sigma"), number(F.col("line"), p, 9).alias("ZTD"))


def antenna_names(files: DataFrame) -> DataFrame:
    """The antenna codes of an ANTEX file; the radome is left out."""
    return files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"START OF ANTENNA\s+(\S+)"), 1)).alias("AntennaCode")).distinct()


def ocean_loading(files: DataFrame) -> DataFrame:
    """Station and its block of coefficient lines of a BLQ file (which begins with $$)."""
    own = files.filter(F.col("text").startswith("$$"))
    block = F.regexp_extract_all("text", F.lit(r"(?m)^  (\S.*)\n((?:^\$\$.*\n)*)((?:^\s+[-.\d].*\n?){6})"), 0)
    b = own.select("path", F.explode(block).alias("b"))
    return b.select("path", F.lower(F.trim(F.regexp_extract("b", r"^  (\S+)", 1))).alias("station"), F.regexp_replace(F.regexp_extract("b", r"(?s)((?:\s+[-.\d][^\n]*\n?){6})$", 1), r"^\s+|\s+$", "").alias("coefficients"))


CONSTRAINTS = [
    "x", "y", "z", "epoch", "vx", "vy", "vz", "n_sin_annual", "n_sin_half", "n_cos_annual", "n_cos_half", "e_sin_annual", "e_sin_half", "e_cos_annual", "e_cos_half",
    "u_sin_annual", "u_sin_half", "u_cos_annual", "u_cos_half",
]


def constraints(files: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Position, epoch, velocity and periodic terms (m; the file has mm) of each station; NaN stays NaN."""
    parts = F.split(F.trim("line"), r"\s+")
    own = lines(files).filter(F.col("line").startswith(" ")).withColumn("p", parts).filter(F.size("p") == len(CONSTRAINTS) + 1)
    value = lambda i: F.get("p", F.lit(i + 1)).try_cast("double") / (1000.0 if i >= 7 else 1.0)
    out = own.select("path", F.get("p", F.lit(0)).alias("station"), *[value(i).alias(k) for i, k in enumerate(CONSTRAINTS)])
    return out.filter(~F.col("station").isin(list(excluded))) if excluded else out


def periodic_space(files: DataFrame) -> DataFrame:
    """Mean sine and cosine (m) of each station, period and component of a periodic-terms file."""
    w = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    period = F.when(F.col("line").startswith("F"), number(F.col("line"), rf"Frequency\s+.\s*:\s*({NUMBER})"))
    own = lines(files).withColumn("period", F.last(period, ignorenulls=True).over(w)).filter(~F.col("line").startswith("F"))
    p = r"^\s(\w+)\s+\w\s.{9}\s*\d*\s(\w)\s+(.{7})\s+.{7}\s+(.{7})"
    rows = own.filter(F.col("line").rlike(p)).select(F.lower(F.regexp_extract("line", p, 1)).alias("station"), "period", F.lower(F.regexp_extract("line", p, 2)).alias("component"), number(F.col("line"), p, 4).alias("s"), number(F.col("line"), p, 3).alias("c"))
    return rows.groupBy("station", "period", "component").agg((F.avg("s") / 1000).alias("sin"), (F.avg("c") / 1000).alias("cos"))


def run_logs(files: DataFrame) -> DataFrame:
    """Project, subnet, day, node, times, iterations and postfit of each run log; null where a log lacks them."""
    t = F.col("text")
    head = r"initialized for (\w+)(?:\.\w*?(\d+))?: (\d+) (\d+)"
    stamp = r"\((\d+-\d+-\d+ \d+:\d+:\d+)\)"
    time = lambda r: F.try_to_timestamp(F.regexp_extract(t, r, 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    last = lambda r: F.element_at(F.regexp_extract_all(t, F.lit(r), 1), -1)
    depth = F.regexp_extract_all(t, F.lit(r"Iteration depth: (\d+)"), 1)
    nrms = F.regexp_extract_all(t, F.lit(rf"Postfit nrms:\s+({NUMBER})"), 1)
    start, end = time(rf"run\.sh {stamp}: Iteration depth: 1"), time(rf"finish\.sh {stamp}: Done processing")
    return files.select(
        "path", F.regexp_extract(t, head, 1).alias("Project"), F.coalesce(F.regexp_extract(t, head, 2).try_cast("int"), F.lit(0)).alias("subnet"),
        F.regexp_extract(t, head, 3).try_cast("int").alias("Year"), F.regexp_extract(t, head, 4).try_cast("int").alias("DOY"),
        F.nullif(F.regexp_extract(t, r"executing on (\w+)", 1), F.lit("")).alias("node"), start.alias("start"), end.alias("end"),
        F.when(F.size(depth) > 0, last(r"Iteration depth: (\d+)").try_cast("int")).alias("iterations"),
        F.when(F.size(nrms) > 0, F.regexp_replace(last(rf"Postfit nrms:\s+({NUMBER})"), "[Dd]", "E").try_cast("double")).otherwise(1.0).alias("nrms"),
        F.round((F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 60).cast("int").alias("runtime"),
    )


def station_list(files: DataFrame) -> DataFrame:
    """Station and further parameters of each line; lines that begin with # are remarks."""
    p = F.split(F.trim("line"), r"\s+")
    own = lines(files).filter(~F.col("line").rlike(r"^\s*(#|$)")).withColumn("p", p)
    return own.select("path", F.lower(F.get("p", F.lit(0))).alias("station"), F.slice("p", 2, 1000).alias("parameters"))


def placemarks(files: DataFrame) -> DataFrame:
    """Name, lon, lat and height of each point of a KML text."""
    p = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<Placemark.*?</Placemark>"), 0)).alias("b"))
    c = F.split(F.trim(F.regexp_extract("b", r"(?s)<Point>.*?<coordinates>(.*?)</coordinates>", 1)), ",")
    out = p.select("path", F.regexp_extract("b", r"(?s)<name>(.*?)</name>", 1).alias("name"), *[F.get(c, F.lit(i)).try_cast("double").alias(k) for i, k in enumerate(("lon", "lat", "height"))])
    return out.filter("lon is not null and lat is not null")


def packages(files: DataFrame, schema: str) -> DataFrame:
    """Exported station packages, one JSON object a file."""
    return files.select("path", F.from_json("text", schema).alias("station"))


def log_days(rows: DataFrame) -> DataFrame:
    """The date of each row's Year and DOY."""
    return rows.withColumn("date", date_of(F.col("Year"), F.col("DOY")))
