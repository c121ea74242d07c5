"""Projection, filters and predicates (F1 to F22), and ordering, limits and sets over keys (T, U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import text

KEY = ["NetworkCode", "StationCode"]


class NothingFound(LookupError):
    """A lookup that must give a row gave none."""


def lookup(rows: DataFrame, limit: int | None = None, fields: list[str] | None = None, **equal) -> DataFrame:
    """Rows that equal all values (None: null); raises NothingFound if there are none."""
    out = matching(rows, **equal)
    out = out.select(*fields) if fields else out
    if out.limit(1).count() == 0:
        raise NothingFound(f"no row with {equal}")
    return out.limit(limit) if limit else out


def condition(**equal) -> Column:
    """A conjunction of equalities that is never null; None stands for null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in equal.items()], F.lit(True))


def matching(rows: DataFrame, **equal) -> DataFrame:
    """the rows of a conjunction of equalities."""
    return rows.filter(condition(**equal))


def stations(table: DataFrame, wanted: list[str]) -> DataFrame:
    """stations named by `all`, a country code, `net.all`, `net.stnm`, `stnm` or wildcards, less those after - or *.

    Every name is a predicate; the list is one pass over the table. Sorted by station."""

    def test(name: str) -> Column:
        net, stn = F.col("NetworkCode"), F.col("StationCode")
        if name == "all":
            return text.not_temporary(net)
        if "." in name:
            a, b = name.split(".", 1)
            own = F.lit(True) if b == "all" else text.similar_to(stn, b)
            return text.similar_to(net, a) & own
        if len(name) == 3 and name.isupper():
            return F.col("country_code") == name
        return text.similar_to(stn, name)

    plus = [test(w) for w in wanted if w[0] not in "-*"]
    minus = [test(w[1:]) for w in wanted if w[0] in "-*"]
    chosen = reduce(lambda a, b: a | b, plus, F.lit(False))
    for m in minus:
        chosen = chosen & ~F.coalesce(m, F.lit(False))
    return table.filter(chosen).dropDuplicates(KEY).orderBy("StationCode", "NetworkCode")


def day_range(rows: DataFrame, first: tuple[int, int], last: tuple[int, int], year: str = "Year", doy: str = "DOY") -> DataFrame:
    """(year, doy) between two pairs; the plain year bounds prune files first."""
    pair = F.struct(F.col(year).cast("int"), F.col(doy).cast("int"))
    bound = lambda p: F.struct(F.lit(p[0]), F.lit(p[1]))
    return rows.filter(F.col(year).between(first[0], last[0]) & (pair >= bound(first)) & (pair <= bound(last)))


def without_days(rows: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is not among days."""
    return rows.join(days.select(*keys).distinct(), keys, "left_anti")


def with_days(rows: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is among days."""
    return rows.join(days.select(*keys).distinct(), keys, "left_semi")


def member(value: Column | str, values: str) -> Column:
    """F8: value = ANY(array)."""
    return F.array_contains(F.col(values), value)


def in_box(rows: DataFrame, lat: tuple[float, float], lon: tuple[float, float], years: float) -> DataFrame:
    """stations of a box whose records span so many years."""
    return rows.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon) & (F.col("DateEnd") - F.col("DateStart") >= years))


def near_station(solutions: DataFrame, table: DataFrame, excluded: DataFrame | None = None, default_m: float = 20.0) -> DataFrame:
    """solutions with `distance_m` to their station and `blunder`; excluded days are gone.

    Blunders are marked, not dropped, so that they can be listed."""
    ref = table.select(*KEY, "auto_x", "auto_y", "auto_z", "max_dist")
    d = F.sqrt(F.pow(F.col("X") - F.col("auto_x"), 2) + F.pow(F.col("Y") - F.col("auto_y"), 2) + F.pow(F.col("Z") - F.col("auto_z"), 2))
    out = solutions.join(ref, KEY).withColumn("distance_m", d)
    out = out.withColumn("blunder", F.col("distance_m") > F.coalesce(F.col("max_dist"), F.lit(default_m)))
    if excluded is not None:
        out = without_days(out, excluded, [*KEY, "Year", "DOY"])
    return out.drop("auto_x", "auto_y", "auto_z", "max_dist")


def absolute_series(rows: DataFrame, limit_m: float = 6.3e3) -> DataFrame:
    """`absolute`, whether a station's first position (by MJD) is a position rather than a difference."""
    first = F.min_by(F.sqrt(F.col("X") ** 2 + F.col("Y") ** 2 + F.col("Z") ** 2), F.col("mjd"))
    return rows.join(rows.groupBy(*KEY).agg((first > limit_m).alias("absolute")), KEY)


def processable(files: DataFrame) -> DataFrame:
    """half a day of data at 120 s or denser."""
    return files.filter((F.col("Completion") >= 0.5) & (F.col("Interval") <= 120))


MOST_FRAMES = 1000


def frame_of_day(rows: DataFrame, frames: DataFrame, day: str = "date") -> DataFrame:
    """F16: the first frame whose span holds the day; rows of no frame keep null.

    frames is a short list by nature (its length is checked) and becomes one expression: no join, and equal rows stay."""
    listed = frames.select("frame", "start", "end").orderBy("start", "frame").limit(MOST_FRAMES + 1).collect()
    if len(listed) > MOST_FRAMES:
        raise ValueError(f"over {MOST_FRAMES} reference frames")
    d = F.col(day)
    hits = [F.when((d >= F.lit(r["start"])) & (F.lit(True) if r["end"] is None else d <= F.lit(r["end"])), F.lit(r["frame"])) for r in listed]
    return rows.withColumn("frame", F.coalesce(*hits, F.lit(None).cast("string")))


def integer_set(spec: str, most: int) -> list[int]:
    """the numbers of `1;3-6;<5;>9` up to most."""
    out: set[int] = set()
    for part in spec.split(";"):
        part = part.strip()
        if part.startswith("<"):
            out |= set(range(1, int(part[1:])))
        elif part.startswith(">"):
            out |= set(range(int(part[1:]) + 1, most + 1))
        elif "-" in part:
            a, b = map(int, part.split("-"))
            out |= set(range(a, b + 1))
        else:
            out.add(int(part))
    return sorted(x for x in out if x <= most)


def duplicate_codes(table: DataFrame) -> DataFrame:
    """stations without alias whose code several networks use."""
    plain = table.filter(F.col("alias").isNull() & text.not_temporary(F.col("NetworkCode")))
    several = plain.groupBy("StationCode").agg(F.count("*").alias("n")).filter("n > 1").select("StationCode")
    return plain.join(several, "StationCode", "left_semi")


def same_file(start_a: Column, end_a: Column, interval_a: Column, start_b: Column, end_b: Column, interval_b: Column, seconds: int = 240) -> Column:
    """equal interval, and both ends within some minutes."""
    apart = lambda x, y: F.abs(F.unix_seconds(x.cast("timestamp")) - F.unix_seconds(y.cast("timestamp")))
    return (apart(start_a, start_b) <= seconds) & (apart(end_a, end_b) <= seconds) & (interval_a == interval_b)


def height_reason(height: Column) -> Column:
    """why a height is refused, null if it is not."""
    return F.when((height > 9000) | (height < -400), F.lit("height out of range"))


def stale_solutions(solutions: DataFrame, sessions: DataFrame, tolerance: str = "INTERVAL 1 SECOND") -> DataFrame:
    """solutions whose hash is not that of the equipment of their day and their orbit.

    sessions: keys, DateStart, DateEnd (null: open) and `hash`; solutions: keys, `date`, `hash` and `orbit_hash`."""
    s = sessions.select(*KEY, "DateStart", "DateEnd", F.col("hash").alias("session_hash"))
    inside = (F.col("date") >= F.col("DateStart")) & (F.col("DateEnd").isNull() | (F.col("date") <= F.col("DateEnd")))
    joined = solutions.join(s, KEY).filter(inside)
    return joined.filter(F.col("hash") != F.col("session_hash") + F.coalesce(F.col("orbit_hash"), F.lit(0))).drop("DateStart", "DateEnd", "session_hash")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (DISTINCT ON)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("driftline_rank", rank).filter("driftline_rank = 1").drop("driftline_rank")


def smallest(rows: DataFrame, column: str, n: int) -> DataFrame:
    """T4: the n rows of least value."""
    return rows.orderBy(F.col(column).asc_nulls_last()).limit(n)


def reject_but_one(rows: DataFrame, keys: list[str], residual: str, limit: float) -> DataFrame:
    """Rows within the limit; where a key has none, its best row."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(residual).asc_nulls_last()))
    return rows.withColumn("driftline_rank", rank).filter((F.col(residual) <= limit) | (F.col("driftline_rank") == 1)).drop("driftline_rank")


def all_days(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of both."""
    return first.select(*keys).union(second.select(*keys)).distinct()


def missing_keys(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the first that the second lacks."""
    return first.select(*keys).subtract(second.select(*keys))


def missing_days(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """For each key the days between its first and last that it has no row for."""
    span = rows.groupBy(*keys).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    every = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(day))
    return every.join(rows.select(*keys, day).distinct(), [*keys, day], "left_anti")


def common_stations(first: DataFrame, second: DataFrame) -> DataFrame:
    """U4."""
    return first.select(*KEY).intersect(second.select(*KEY))


def distinct_within(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values of each key, dropping those within a tolerance of the last one kept, in order."""
    step = F.aggregate(
        F.sort_array(F.collect_list(value)),
        F.array().cast("array<double>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > tolerance), F.concat(kept, F.array(x.cast("double")))).otherwise(kept),
    )
    return rows.groupBy(*keys).agg(step.alias("kept")).select(*keys, F.explode("kept").alias(value))
