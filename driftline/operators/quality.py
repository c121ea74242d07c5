"""Quality control and ingest (Q1 to Q16) and epoch-table operators (O1 to O12), all as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators import joins, windows
from driftline.operators.selection import KEY, condition, without_days


def serial_mismatches(files: DataFrame, sessions: DataFrame, item: str = "Receiver") -> DataFrame:
    """Ranges of files whose serial number is not that of the equipment record valid at mid-session."""
    middle = (F.unix_seconds(F.col("ObservationSTime").cast("timestamp")) + F.unix_seconds(F.col("ObservationETime").cast("timestamp"))) / 2
    points = files.select(*KEY, F.timestamp_seconds(middle).cast("timestamp_ntz").alias("middle"), F.upper(F.trim(f"{item}Serial")).alias("file_serial"))
    valid = joins.valid_at(points, sessions.select(*KEY, "DateStart", "DateEnd", F.upper(F.trim(f"{item}Serial")).alias("record_serial")), KEY, "middle")
    marked = valid.withColumn("differs", ~F.col("file_serial").eqNullSafe(F.col("record_serial")))
    return windows.runs(marked, KEY, "middle", ["file_serial", "record_serial", "differs"]).filter("differs").drop("differs")


def equipment_faults(sessions: DataFrame, files: DataFrame, antennas: DataFrame) -> DataFrame:
    """Q3: one row for each fault of the equipment table: open records before the last, overlaps, gaps with files in
    them, antennas that are not listed, and files outside all records."""
    w = Window.partitionBy(*KEY).orderBy("DateStart")
    open_ = sessions.withColumn("next", F.lead("DateStart").over(w)).filter("DateEnd is null and next is not null")
    over = joins.overlaps(sessions, KEY)
    gap = windows.session_gaps(sessions, KEY).select(*KEY, F.col("DateEnd").alias("gap_start"), F.col("next_start").alias("gap_end"))
    gap = joins.files_in_gaps(gap, files, KEY).filter("n_files > 0")
    unknown = sessions.join(antennas.select("AntennaCode"), "AntennaCode", "left_anti")
    span = sessions.groupBy(*KEY).agg(F.min("DateStart").alias("lo"), F.max(F.coalesce("DateEnd", F.lit(joins.FAR).cast("timestamp_ntz"))).alias("hi"))
    outside = files.join(span, KEY, "left").filter(F.col("lo").isNull() | (F.col("ObservationSTime") < F.col("lo")) | (F.col("ObservationETime") > F.col("hi")))
    parts = [
        open_.select(*KEY, F.col("DateStart").alias("at"), F.lit("open record").alias("fault")),
        over.select(*KEY, F.col("DateStart_b").alias("at"), F.lit("overlap").alias("fault")),
        gap.select(*KEY, F.col("gap_start").alias("at"), F.lit("files in gap").alias("fault")),
        unknown.select(*KEY, F.col("DateStart").alias("at"), F.lit("unknown antenna").alias("fault")),
        outside.select(*KEY, F.col("ObservationSTime").alias("at"), F.lit("file without record").alias("fault")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Q4: catalogue rows whose path is not among the files found."""
    return files.join(found.select("path"), "path", "left_anti")


def excluded(solutions: DataFrame, exclusions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q6: the exclusion list with new keys added, and the solutions left."""
    keys = [*KEY, "Year", "DOY"]
    listed = exclusions.select(*keys).union(new.select(*keys)).distinct()
    return listed, without_days(solutions, listed, keys)


def low_completion(files: DataFrame, least: float, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Q6: files of a period to delete for their completion."""
    day = F.struct(F.col("ObservationYear").cast("int"), F.col("ObservationDOY").cast("int"))
    bound = lambda p: F.struct(F.lit(p[0]), F.lit(p[1]))
    return files.filter((F.col("Completion") < least) & (day >= bound(first)) & (day <= bound(last)))


def renamed(tables: dict[str, DataFrame], keys: dict[str, list[str]], old: tuple[str, str], new: tuple[str, str]) -> dict[str, DataFrame]:
    """Q7: every table with a station's rows under its new key; of rows whose key exists there, the existing ones stay."""
    out = {}
    for name, rows in tables.items():
        own = condition(NetworkCode=old[0], StationCode=old[1])
        moved = rows.filter(own).withColumns({"NetworkCode": F.lit(new[0]), "StationCode": F.lit(new[1])})
        rest = rows.filter(~own)
        there = rest.filter((F.col("NetworkCode") == new[0]) & (F.col("StationCode") == new[1]))
        out[name] = rest.unionByName(moved.join(there.select(*keys[name]), keys[name], "left_anti"))
    return out


def insert_sessions(current: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q8: current and new records merged, and new ones refused.

    A new record that overlaps a closed one is refused; the open last record is closed where a later one begins; a new
    record just like the first one but earlier extends it."""
    same = ["ReceiverCode", "ReceiverSerial", "AntennaCode", "AntennaSerial", "RadomeCode"]
    far = F.lit(joins.FAR).cast("timestamp_ntz")
    closed = current.filter(F.col("DateEnd").isNotNull()).select(*KEY, F.col("DateStart").alias("s"), F.col("DateEnd").alias("e"))
    hit = new.join(closed, KEY).filter((F.col("s") < F.coalesce("DateEnd", far)) & (F.col("e") > F.col("DateStart"))).select(*KEY, "DateStart").distinct()
    refused = new.join(hit, [*KEY, "DateStart"], "left_semi")
    good = new.join(hit, [*KEY, "DateStart"], "left_anti")
    every = current.unionByName(good)
    w = Window.partitionBy(*KEY).orderBy("DateStart")
    nxt = F.lead("DateStart").over(w)
    closed_at = F.when(F.col("DateEnd").isNull() & nxt.isNotNull(), nxt - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("DateEnd"))
    every = every.withColumn("DateEnd", closed_at)
    n = F.row_number().over(w)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    joined = equal & (n == 2)
    start = F.when(joined, F.lag("DateStart").over(w)).otherwise(F.col("DateStart"))
    marked = every.withColumns({"driftline_joined": joined, "driftline_start": start})
    absorbed = F.coalesce(F.lead("driftline_joined").over(w), F.lit(False))
    marked = marked.withColumn("driftline_gone", absorbed & (F.row_number().over(w) == 1)).filter("not driftline_gone")
    return marked.withColumn("DateStart", F.col("driftline_start")).select(*current.columns), refused


def remove_file(files: DataFrame, solutions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q9: the files left without those gone, and the solutions left without those whose day no longer has a file."""
    keys = [*KEY, "ObservationYear", "ObservationDOY", "Interval", "Completion"]
    left = files.join(gone.select(*keys), keys, "left_anti")
    days = left.select(*KEY, F.col("ObservationYear").alias("Year"), F.col("ObservationDOY").alias("DOY")).distinct()
    touched = gone.select(*KEY, F.col("ObservationYear").alias("Year"), F.col("ObservationDOY").alias("DOY")).distinct()
    dead = touched.join(days, [*KEY, "Year", "DOY"], "left_anti")
    return left, without_days(solutions, dead, [*KEY, "Year", "DOY"])


def ingest(arrived: DataFrame, files: DataFrame, table: DataFrame) -> DataFrame:
    """Q10, Q11: each arrived file with status and reason.

    arrived: path, station, name fields and inspection columns (reason, lat, lon, height, NetworkCode). reject: bad
    name or unreadable; locked: unknown station; duplicate: the catalogue has the day and interval at this
    completion; retry: no coordinate yet; insert: the rest."""
    day = [*KEY, "ObservationYear", "ObservationDOY", "Interval", "Completion"]
    a = arrived.join(table.select(*KEY, F.lit(True).alias("known")), KEY, "left").join(files.select(*day, F.lit(True).alias("held")).distinct(), day, "left")
    reason = (
        F.when(F.col("StationCode").isNull(), "file name is not valid").when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("lat").isNull(), "no coordinate").when((F.col("height") > 9000) | (F.col("height") < -400), "height out of range")
        .when(F.col("held"), "already archived").when(F.col("known").isNull(), "station is not known")
    )
    out = a.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNull(), "insert").when(F.col("reason") == "station is not known", "locked").when(F.col("reason") == "already archived", "duplicate")
        .when(F.col("reason") == "no coordinate", "retry").otherwise("reject")
    )
    return out.withColumn("status", status).drop("known", "held")


def by_day(epochs: DataFrame, time: str = "ts") -> DataFrame:
    """Q12: epochs with the day whose file they belong to."""
    return epochs.withColumn("day", F.to_date(time))


def file_days(files: DataFrame) -> DataFrame:
    """Q12: one row for each day that a file of several days covers."""
    days = F.sequence(F.to_date("ObservationSTime"), F.to_date("ObservationETime"), F.expr("INTERVAL 1 DAY"))
    return files.withColumn("day", F.explode(days))


def weekly_list(subnets: DataFrame, residual: DataFrame, limit: float) -> DataFrame:
    """For each station and day of a combination its alias, and `use`: within the limit, or the best of
    its station if none is."""
    from driftline.functions.arrays import zipped
    from driftline.operators.selection import reject_but_one

    names = zipped(subnets.select("Year", "DOY", "stations", "alias"), "stations", "alias").withColumnRenamed("stations", "station").distinct()
    r = residual.withColumn("station", F.concat_ws(".", *KEY))
    good = reject_but_one(r, ["station"], "residual", limit).select("station", "Year", "DOY", F.lit(True).alias("use"))
    return names.join(r.select("station", "Year", "DOY", "residual"), ["station", "Year", "DOY"]).join(good, ["station", "Year", "DOY"], "left").fillna(False, ["use"])


def missing_elsewhere(here: DataFrame, there: DataFrame, km: float = 0.1) -> DataFrame:
    """Q15: stations of one database without one at their place, or of their code, in the other."""
    near = joins.within_km(here, there, km).select(*KEY).distinct()
    return here.join(near, KEY, "left_anti").join(there.select("StationCode"), "StationCode", "left_anti")


def download_queue(table: DataFrame, days: DataFrame, files: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Station days without a good file but with equipment, and their sources in order.

    A station's equipment records are merged into stretches apart from each other; its days are then made, and those without a
    source day or with a good file taken out, as arrays inside its own row, no longer than the calendar. So what is moved between
    tasks is records and files, never station days, which the last step makes where the station is."""
    lo, hi = days.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return sources.limit(0).select(*KEY, F.lit(None).cast("date").alias("day"), "try_order", "server_id")
    start = F.greatest(F.to_date("DateStart"), F.lit(lo))
    stop = F.least(F.coalesce(F.to_date("DateEnd"), F.lit(hi)), F.lit(hi))
    own = sessions.filter(start <= stop).select(*KEY, start.alias("lo"), stop.alias("hi"))
    w = Window.partitionBy(*KEY).orderBy("lo", "hi")
    apart = F.col("lo") > F.date_add(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1)
    own = own.withColumn("stretch", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.groupBy(*KEY, "stretch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("stretches"))
    good = files.filter("Completion >= 0.5").select(*KEY, F.date_add(F.make_date("ObservationYear", F.lit(1), F.lit(1)), (F.col("ObservationDOY") - 1).cast("int")).alias("day"))
    good = good.groupBy(*KEY).agg(F.collect_set("day").alias("good"))
    every = F.flatten(F.transform("stretches", lambda x: windows.in_period(x["lo"], x["hi"])))
    left = F.array_except(every, F.coalesce("good", F.array().cast("array<date>")))
    merged = own.join(table.select(*KEY).hint(joins.SPREAD), KEY, "left_semi").join(good.hint(joins.SPREAD), KEY, "left")
    merged = merged.join(sources.select(*KEY, "try_order", "server_id").hint(joins.SPREAD), KEY).crossJoin(F.broadcast(windows.period(days, "day", "day")))
    return merged.select(*KEY, F.explode(left).alias("day"), "try_order", "server_id")


def next_source(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """Q16: of each station day the first source that has not failed."""
    keys = [*KEY, "day", "server_id"]
    left = queue.join(failed.select(*keys), keys, "left_anti")
    return left.groupBy(*KEY, "day").agg(F.min_by("server_id", "try_order").alias("server_id"))


# O: operators on a table of epochs (station key, ts, system, sat, ...)


def window_epochs(epochs: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """O1."""
    return epochs.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end)))


def decimate(epochs: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """O2: epochs at whole multiples of an interval."""
    return epochs.filter(F.unix_seconds(F.col(ts).cast("timestamp")) % seconds == 0)


def drop_systems(epochs: DataFrame, systems: list[str]) -> DataFrame:
    """O3."""
    return epochs.filter(~F.col("system").isin(systems))


def splice(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both, epochs of the first kept where both have one."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def corrected_headers(files: DataFrame, sessions: DataFrame, columns: list[str]) -> DataFrame:
    """File headers with the columns of the equipment record valid at their start; files without one keep theirs."""
    keys = [*KEY, "ObservationSTime"]
    record = joins.valid_at(files.select(*keys), sessions.select(*KEY, "DateStart", "DateEnd", *[F.col(c).alias(f"r_{c}") for c in columns]), KEY, "ObservationSTime")
    j = files.join(record.select(*keys, *[f"r_{c}" for c in columns]), keys, "left")
    return j.withColumns({c: F.coalesce(f"r_{c}", c) for c in columns}).select(*files.columns)


def short_name(station: Column, doy: Column, session: Column, year: Column, kind: str = "o") -> Column:
    """The version 2 name of a file."""
    return F.format_string("%s%03d%s.%02d" + kind, F.lower(station), doy.cast("int"), session, (year % 100).cast("int"))


def merged(parts: DataFrame) -> DataFrame:
    """Converted parts of one station, day and interval as one file row."""
    return parts.groupBy(*KEY, "day", "Interval").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("epochs").alias("epochs"), F.count("*").alias("n_parts"))


def pending_visits(visit_files: DataFrame, visits: DataFrame, table: DataFrame) -> DataFrame:
    """Files of visits that are not converted yet, with their station."""
    return visit_files.filter("not rinexed").join(visits, "visit_id", "left").join(table.select(*KEY, "station_id"), "station_id", "left")


def newest_remote(stations: DataFrame, listing: DataFrame) -> DataFrame:
    """The newest listed file of each station; names are parsed once, then it is an equality join."""
    from driftline.operators.archive import file_name

    parsed = listing.withColumn("f", file_name(F.col("path"))).filter("f is not null")
    best = parsed.groupBy(F.col("f.station").alias("station")).agg(F.max_by("path", F.struct("f.year", "f.doy", "f.session")).alias("path"))
    return stations.withColumn("station", F.lower("StationCode")).join(best, "station").drop("station")


def missing_orbits(days: DataFrame, listing: DataFrame) -> DataFrame:
    """Days whose GPS week and day no listed orbit has."""
    from driftline.functions.calendar import gps_day, gps_week

    d = days.select("day", gps_week(F.col("day")).alias("gps_week"), gps_day(F.col("day")).alias("gps_day"))
    return d.join(listing.select("gps_week", "gps_day").distinct(), ["gps_week", "gps_day"], "left_anti")


def ambiguity_rates(text: Column) -> Column:
    """Struct of the numbers of a run's summary text."""
    number = lambda r: F.regexp_extract(text, r, 1).try_cast("double")
    return F.struct(
        number(r"Percent fixed WL\D+([\d.]+)").alias("wide_lane"), number(r"Percent fixed NL\D+([\d.]+)").alias("narrow_lane"),
        number(r"Prefit nrms:\s*([\d.E+-]+)").alias("prefit"), number(r"Postfit nrms:\s*([\d.E+-]+)").alias("postfit"),
        F.size(F.regexp_extract_all(text, F.lit("FATAL"), 0)).alias("n_fatal"), F.size(F.regexp_extract_all(text, F.lit("MISSING"), 0)).alias("n_missing"),
    )
