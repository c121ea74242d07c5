"""The file archive: best file of a day, counts, samples, paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators.selection import KEY
from driftline.storage import written

FILE_DAY = [*KEY, "ObservationYear", "ObservationDOY"]


def best_files(files: DataFrame, day: list[str] = FILE_DAY, completion: str = "Completion", interval: str = "Interval") -> DataFrame:
    """Of each day the files of greatest completion, and of those the ones of least interval.

    One exchange by day serves both windows; no self join."""
    w = Window.partitionBy(*day)
    top = files.withColumn("driftline_rank", F.rank().over(w.orderBy(F.col(completion).desc_nulls_last()))).filter("driftline_rank = 1")
    return top.withColumn("driftline_least", F.min(interval).over(w)).filter(F.col(interval) == F.col("driftline_least")).drop("driftline_rank", "driftline_least")


def time_span(files: DataFrame, time: str = "ObservationFYear", keys: list[str] = KEY) -> DataFrame:
    """First and last epoch of each key."""
    return files.groupBy(*keys).agg(F.min(time).alias("DateStart"), F.max(time).alias("DateEnd"))


def completeness(files: DataFrame, solutions: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """A2: files, solutions and their percentage for each station. Both sides are counted before they meet."""
    f = files.groupBy(*keys).agg(F.count("*").alias("n_files"))
    s = solutions.groupBy(*keys).agg(F.count("*").alias("n_solutions"))
    joined = f.join(s, keys, "left").withColumn("n_solutions", F.coalesce("n_solutions", F.lit(0)))
    return joined.withColumn("percent", 100.0 * F.col("n_solutions") / F.col("n_files"))


def series_completion(solutions: DataFrame, files: DataFrame, day: list[str]) -> DataFrame:
    """A3: share of days with a file that have a solution, by J2."""
    missing = files.join(solutions.select(*day).distinct(), day, "left_anti").groupBy(*KEY).agg(F.count("*").alias("missing"))
    n = solutions.groupBy(*KEY).agg(F.count("*").alias("n")).join(missing, KEY, "left").fillna(0, ["missing"])
    return n.withColumn("completion", 100 - 100.0 * F.col("missing") / (F.col("missing") + F.col("n")))


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """A4: a value for each key that changes when its rows do; exact, as it sums whole units of the last digit."""
    scaled = sum((F.round(F.col(c) * 10**digits).cast("decimal(38,0)") for c in columns), F.lit(0).cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(F.sum(scaled).alias("total"), F.count("*").alias("n"))


def day_counts(first: DataFrame, second: DataFrame, day: list[str]) -> DataFrame:
    """Days on which two tables hold different numbers of rows."""
    a = first.groupBy(*day).agg(F.count("*").alias("n_first"))
    b = second.groupBy(*day).agg(F.count("*").alias("n_second"))
    both = a.join(b, day, "full_outer").fillna(0, ["n_first", "n_second"])
    return both.filter("n_first <> n_second")


def unknowns(solutions: DataFrame, delays: DataFrame, day: list[str]) -> DataFrame:
    """Unknowns of a combination, two a station and day and one a delay."""
    a = solutions.groupBy(*day).agg((2 * F.count("*")).alias("n")).agg(F.sum("n").alias("n_positions"))
    return a.crossJoin(F.broadcast(delays.agg(F.count("*").alias("n_delays")))).withColumn("n_unknowns", F.col("n_positions") + F.col("n_delays"))


def mean_knots(delays: DataFrame) -> DataFrame:
    """The mean delay of repeated (station, minute) knots."""
    return delays.groupBy(*KEY, "Date").agg(F.round(F.avg("ZTD"), 4).alias("ZTD"), F.round(F.avg("sigma"), 4).alias("sigma"))


def events_since(events: DataFrame, runs: DataFrame, script: str) -> DataFrame:
    """A10: event counts by type since the last run of a script."""
    last = runs.filter(F.col("script") == script).agg(F.max("exec_date").alias("since"))
    joined = events.join(F.broadcast(last), (F.col("EventDate") > F.col("since")) | F.col("since").isNull())
    return joined.groupBy("EventType").agg(F.count("*").alias("n"))


def residual_statistics(rows: DataFrame, keys: list[str], residual: str, sigma: str, bin_m: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Weighted RMS, spread between quartiles and count of each key, and the residuals' histogram."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    wrms = F.sqrt(F.sum(w * F.col(residual) ** 2) / F.sum(w))
    iqr = F.percentile(residual, F.lit(0.75)) - F.percentile(residual, F.lit(0.25))
    stats = rows.groupBy(*keys).agg(wrms.alias("wrms"), iqr.alias("iqr"), F.count("*").alias("n"))
    histogram = rows.groupBy(*keys, F.floor(F.col(residual) / bin_m).alias("bin")).agg(F.count("*").alias("n"))
    return stats, histogram


def residual_covariance(rows: DataFrame, keys: list[str], n: str = "n", e: str = "e", u: str = "u") -> DataFrame:
    """Correlations and covariances of three residual components, over rows that have all."""
    full = rows.dropna(subset=[n, e, u])
    pairs = [(n, e), (n, u), (e, u)]
    return full.groupBy(*keys).agg(*[F.corr(a, b).alias(f"corr_{a}{b}") for a, b in pairs], *[F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in [(n, n), (e, e), (u, u), *pairs]])


def even_sample(rows: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """About n evenly spaced rows of each key; keys of fewer rows give all."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("driftline_n", F.row_number().over(w.orderBy(*order))).withColumn("driftline_all", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("driftline_all") / n), F.lit(1))
    return numbered.filter(F.col("driftline_n") % step == 0).drop("driftline_n", "driftline_all")


def numbered(rows: DataFrame, order: list[str], column: str = "row") -> DataFrame:
    """Rows numbered from 1 in an order; rows equal in it follow by a hash of all their columns.

    Ranges of the order are sorted apart and written once, each row with its range and its place there, so that the counts
    of the ranges before and the rows are of one evaluation. The hash splits an order value that many rows share."""
    at, tie = "driftline_at", "driftline_tie"
    hashed = rows.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t]))
    ranged = hashed.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    placed = written(ranged.withColumn(at, F.monotonically_increasing_id()), "numbered")
    # the id holds the range in its upper 31 bits and the place there in the lower 33
    part = F.shiftright(at, 33)
    counts = placed.groupBy(part.alias("driftline_part")).agg(F.count("*").alias("driftline_n"))
    before = F.sum("driftline_n").over(Window.orderBy("driftline_part")) - F.col("driftline_n")
    offsets = F.broadcast(counts.select("driftline_part", before.alias("driftline_before")))
    number = F.col(at).bitwiseAND((1 << 33) - 1) + 1 + F.col("driftline_before")
    return placed.withColumn("driftline_part", part).join(offsets, "driftline_part").withColumn(column, number).drop(at, "driftline_part", "driftline_before")


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths, sizes and times of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", "modificationTime")


def file_name(path: Column) -> Column:
    """Struct of the parts of an observation file name, versions 2 and 3; null for anything else."""
    name = F.element_at(F.split(path, "/"), -1)
    two = r"^([A-Za-z0-9]{4})(\d{3})([0-9a-xA-X])\.(\d{2})([oOdD])(?:\.(?:Z|gz))?$"
    three = r"^([A-Z0-9]{4})(\d)(\d)([A-Z]{3})_([RSU])_(\d{4})(\d{3})(\d{4})_(\d{2}[MHDYU])_(\d{2}[CZSMHDU])_([A-Z]{2})\.(crx|rnx)(?:\.gz)?$"
    p2, p3 = (lambda i, r=r: F.regexp_extract(name, r, i) for r in (two, three))
    short_year = p2(4).try_cast("int")
    return (
        F.when(name.rlike(two), F.struct(F.lower(p2(1)).alias("station"), F.when(short_year < 80, short_year + 2000).otherwise(short_year + 1900).alias("year"), p2(2).try_cast("int").alias("doy"), p2(3).alias("session"), F.lower(p2(5)).alias("kind"), F.lit(2).alias("version")))
        .when(name.rlike(three), F.struct(F.lower(p3(1)).alias("station"), p3(6).try_cast("int").alias("year"), p3(7).try_cast("int").alias("doy"), p3(8).alias("session"), F.when(p3(12) == "crx", "d").otherwise("o").alias("kind"), F.lit(3).alias("version")))
    )


LEVEL_WIDTH = {"network": 3, "station": 4, "year": 4, "doy": 3, "month": 2, "day": 2, "gpsweek": 4}


def archive_path(levels: list[str], columns: dict[str, Column]) -> Column:
    """The folder of a file under a template of levels; numbers are padded with zeros."""
    return F.concat_ws("/", *[F.lpad(columns[k].cast("string"), LEVEL_WIDTH.get(k, 1), "0") if k in ("year", "doy", "month", "day", "gpsweek") else columns[k] for k in levels])


def path_keys(path: Column, levels: list[str]) -> Column:
    """Struct of the level values of a path; null unless count and widths of the levels fit."""
    parts = F.split(path, "/")
    n = len(levels) + 1
    value = lambda i: F.element_at(parts, i - n)
    fits = F.size(parts) >= n
    for i, k in enumerate(levels):
        fits = fits & (F.length(value(i)) == LEVEL_WIDTH.get(k, 1))
    return F.when(fits, F.struct(*[value(i).alias(k) for i, k in enumerate(levels)]))


def header_number(line: Column, start: int, width: int, default: float) -> Column:
    """A fixed-width number of a header line, a default where it is not one."""
    return F.coalesce(F.trim(F.substring(line, start, width)).try_cast("double"), F.lit(default))


INSPECTION = "file struct<sysobs:string>, site struct<position:array<double>>, antenna struct<height:double>, receiver string, data struct<epoch:struct<interval:double,number:long,number_extra:long,first:timestamp_ntz,last:timestamp_ntz>,satsys:string>"


def inspected(rows: DataFrame, column: str, least_s: int = 3600) -> DataFrame:
    """Inspection JSON as columns, with a reason for refusal (null: accepted) and the completion."""
    parsed = rows.withColumn("r", F.from_json(column, INSPECTION))
    e = F.col("r.data.epoch")
    seconds = F.unix_seconds(e["last"].cast("timestamp")) - F.unix_seconds(e["first"].cast("timestamp"))
    reason = (
        F.when(e.isNull() | e["interval"].isNull(), "unreadable").when(e["interval"] == 0, "interval is zero").when(e["interval"] > 120, "interval over 120 s")
        .when(seconds <= 0, "ends before it begins").when(seconds < least_s, "too short")
    )
    epochs = e["number"] - F.coalesce(e["number_extra"], F.lit(0))
    day = epochs * e["interval"] / 86400
    within = epochs * e["interval"] / (seconds + e["interval"])
    return parsed.withColumns({"interval": e["interval"], "first": e["first"], "last": e["last"], "reason": reason, "completion": F.round(day, 3), "relative_completion": F.round(within, 3)}).drop("r")


def orbit_choice(listing: DataFrame) -> DataFrame:
    """Of the products of a day the one of best precedence, then highest version, then largest interval."""
    order = Window.partitionBy("gps_week", "gps_day").orderBy("precedence", F.desc("version"), F.desc("interval"))
    return listing.withColumn("driftline_rank", F.row_number().over(order)).filter("driftline_rank = 1").drop("driftline_rank")


RAW_FILTERS = {"Interval", "Completion", "Filename", "ReceiverType", "AntennaType", "ReceiverSerial", "AntennaSerial"}


def records(files: DataFrame, **equal) -> DataFrame:
    """Catalogue rows of a filter: of all files if it names a property of files, else of each day's best file."""
    from driftline.operators.selection import matching

    return matching(files if RAW_FILTERS & equal.keys() else best_files(files), **equal)


def path_levels(structure: DataFrame, keys: DataFrame) -> list[str]:
    """The level names of the path template in order; both tables are small and fixed."""
    rows = structure.join(F.broadcast(keys), "KeyCode", "left").orderBy("Level").select(F.coalesce("rinex_col_in", "KeyCode")).collect()
    return [r[0] for r in rows]


def files_per_day(files: DataFrame) -> DataFrame:
    """How many files and stations each day has."""
    return files.groupBy("ObservationYear", "ObservationDOY").agg(F.count("*").alias("n_files"), F.count_distinct(*KEY).alias("n_stations"))
