"""Interval, spatial and lookup joins.

Plain equality joins are left to Catalyst. Interval joins are equality joins on the station with a residual filter;
spatial joins pair grid cells, so that only neighbours meet."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import geodesy
from driftline.operators.selection import KEY
from driftline.storage import written

FAR = "9999-12-31 23:59:59"


def without_solution(files: DataFrame, solutions: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """Files without a solution; the condition on solutions applies before they are matched."""
    right = solutions if only is None else solutions.filter(only)
    return files.join(right.select(*keys).distinct(), keys, "left_anti")


def valid_at(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, tolerance_s: int = 0, start: str = "DateStart", end: str = "DateEnd") -> DataFrame:
    """Each point with the earliest interval that holds it; points of none are gone. A null end is open.

    By start, the first interval that holds a point is the first up to which the greatest end so far reaches the point: it is that end
    itself. So only intervals that raise the greatest end count, and a point's one is the next above it in the order of these ends: one
    sort of points and intervals together, no pairs of them."""
    other = [c for c in intervals.columns if c not in keys]
    lo, hi = (F.unix_seconds(x.cast("timestamp")) for x in (F.col(start), F.coalesce(F.col(end), F.lit(FAR).cast("timestamp_ntz"))))
    by_start = Window.partitionBy(*keys).orderBy("driftline_lo", start)
    raised = intervals.select(*keys, F.struct(*other).alias("driftline_found"), lo.alias("driftline_lo"), hi.alias("driftline_v"), F.col(start)).dropna(subset=[*keys, "driftline_lo"])
    raised = raised.withColumn("driftline_before", F.max("driftline_v").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    raised = raised.filter("driftline_before is null or driftline_v > driftline_before").select(*keys, "driftline_v", F.struct("driftline_lo", "driftline_found").alias("driftline_next"))
    own = points.select(*keys, F.struct(*points.columns).alias("driftline_point"), F.unix_seconds(F.col(at).cast("timestamp")).alias("driftline_t")).dropna(subset=[*keys, "driftline_t"])
    own = own.withColumn("driftline_v", F.col("driftline_t") - tolerance_s)
    down = Window.partitionBy(*keys).orderBy(F.desc("driftline_v"), F.col("driftline_point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(raised, allowMissingColumns=True).withColumn("driftline_next", F.last("driftline_next", ignorenulls=True).over(down))
    held = both.filter(F.col("driftline_point").isNotNull() & (F.col("driftline_next.driftline_lo") - tolerance_s <= F.col("driftline_t")))
    return held.select("driftline_point.*", "driftline_next.driftline_found.*")


def overlaps(intervals: DataFrame, keys: list[str], start: str = "DateStart", end: str = "DateEnd", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals of a key that share more than an instant, each once, and the shared seconds.

    Of both intervals come the start and the columns to carry, with _a and _b; a is the one that begins first.

    After sorting by start, only a later interval that begins before the greatest end so far can overlap an earlier one;
    intervals that overlap nothing leave before the join."""
    stop = F.coalesce(F.col(end), F.lit(FAR).cast(dict(intervals.dtypes)[end]))
    w = Window.partitionBy(*keys).orderBy(start, "driftline_stop")
    s = intervals.select(*keys, start, stop.alias("driftline_stop"), *carry)
    s = s.withColumn("n", F.row_number().over(w)).withColumn("before", F.max("driftline_stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("after", F.lead(start).over(w)).filter((F.col(start) < F.col("before")) | (F.col("after") < F.col("driftline_stop")))
    a, b = (s.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in (start, "driftline_stop", "n", *carry)]) for x in "ab")
    both = a.join(b, keys).filter(F.col("n_a") < F.col("n_b"))
    lo, hi = F.greatest(f"{start}_a", f"{start}_b"), F.least("driftline_stop_a", "driftline_stop_b")
    seconds = F.unix_seconds(hi.cast("timestamp")) - F.unix_seconds(lo.cast("timestamp"))
    return both.withColumn("shared_s", seconds).filter("shared_s > 0").select(*keys, *[f"{c}_{x}" for c in (start, *carry) for x in "ab"], "shared_s")


def files_in_gaps(gaps: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """For each equipment gap (gap_start, gap_end) the number of files that reach into it."""
    f = files.select(*keys, "ObservationSTime", "ObservationETime")
    hit = gaps.join(f, keys).filter((F.col("ObservationETime") > F.col("gap_start")) & (F.col("ObservationSTime") < F.col("gap_end")))
    return gaps.join(hit.groupBy(*keys, "gap_start").agg(F.count("*").alias("n_files")), [*keys, "gap_start"], "left").fillna(0, ["n_files"])


#: No degree of a great circle is shorter; lengths in degrees err to the long side.
DEGREE_KM = 111.0


def cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    """Row and column of the grid cell of a place; rows are size degrees high, columns widen with latitude."""
    row = F.floor(lat / size).cast("long")
    return row, F.floor(F.pmod(lon, F.lit(360.0)) / width(row, size)).cast("long")


def edge(row: Column, size: float) -> Column:
    """The latitude of a row's side towards the pole."""
    return F.least(F.greatest(F.abs(row), F.abs(row + 1)) * size, F.lit(90.0))


def width(row: Column, size: float) -> Column:
    """Degrees of longitude of the cells of a row, a whole part of the circle."""
    return 360.0 / F.greatest(F.floor(360.0 * F.cos(F.radians(edge(row, size))) / size), F.lit(1))


def reached(points: DataFrame, km: Column, size: float, lat: str, lon: str, row: str, column: str) -> DataFrame:
    """points once for each cell that may hold a place within km of them.

    The longitudes within km follow from the haversine formula at the point's latitude and the row's side towards the pole."""
    known = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    far, top = km / DEGREE_KM, int(90.0 / size)
    clipped = lambda x: F.least(F.greatest(F.floor(x / size), F.lit(-top - 1)), F.lit(top)).cast("long")
    out = known.withColumn(row, F.explode(F.sequence(clipped(F.col(lat) - far), clipped(F.col(lat) + far))))
    narrow = F.sqrt(F.cos(F.radians(lat)) * F.cos(F.radians(edge(F.col(row), size))))
    share = F.sin(F.radians(F.least(far, F.lit(180.0)) / 2)) / F.greatest(narrow, F.lit(1e-12))
    reach = F.when(share < 1, 2 * F.degrees(F.asin(F.least(share, F.lit(1.0)))) + 1e-9).otherwise(180.0)
    wide = width(F.col(row), size)
    count = F.round(360.0 / wide).cast("long")
    at = F.pmod(F.col(lon), F.lit(360.0))
    first = F.floor((at - reach) / wide).cast("long")
    last = F.least(F.floor((at + reach) / wide).cast("long"), first + count - 1)
    return out.withColumn(column, F.explode(F.transform(F.sequence(first, last), lambda x: F.pmod(x, count))))


ROW, COLUMN = "driftline_row", "driftline_column"


#: Joins of cells are sort-merge joins: the planner takes the rows of a small file for little, and would gather all of them, once for
#: each cell, in the driver and join them in the few tasks that read it.
SPREAD = "merge"
#: By how much a cosine of an angle may err, and more: places are single-precision, which halves what they add to a shuffle.
SLACK = 1e-6


def on_unit_sphere(rows: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """rows with the place's x, y and z, called name with an x, y or z behind."""
    p, q = F.radians(lat), F.radians(lon)
    return rows.withColumns({f"{name}{k}": v.cast("float") for k, v in (("x", F.cos(p) * F.cos(q)), ("y", F.cos(p) * F.sin(q)), ("z", F.sin(p)))})


def perhaps_within(cosine: Column, a: str, b: str) -> Column:
    """True for all places whose distance has the cosine, or less, and next to none beyond, by their x, y and z: products only,
    before the haversine formula."""
    x, y, z = (F.col(f"{a}{k}").cast("double") * F.col(f"{b}{k}").cast("double") for k in "xyz")
    return x + y + z >= cosine


def least_cosine(km: Column) -> Column:
    return F.cos(F.least(km / geodesy.RADIUS_KM, F.lit(math.pi))) - SLACK


def within_km(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", only: str | None = None) -> DataFrame:
    """All pairs of places at most km apart; left's columns, then right's with r_, then distance_km.

    Left places go to the cells that km around them touches, some three as cells are three times as wide, right ones to their own: an equality
    join, not a cross join.
    only: SQL text over left's columns and right's (with r_); it is tested before the distance."""
    size = min(3 * km / DEGREE_KM, 90.0)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).filter(F.col(f"r_{lat}").isNotNull() & F.col(f"r_{lon}").isNotNull())
    row, column = cell(F.col(f"r_{lat}"), F.col(f"r_{lon}"), size)
    r = on_unit_sphere(r.withColumn(ROW, row).withColumn(COLUMN, column), f"r_{lat}", f"r_{lon}", "driftline_b")
    joined = on_unit_sphere(reached(left, F.lit(km), size, lat, lon, ROW, COLUMN), lat, lon, "driftline_a").join(r.hint(SPREAD), [ROW, COLUMN])
    joined = joined if only is None else joined.filter(only)
    near = joined.filter(perhaps_within(least_cosine(F.lit(km)), "driftline_a", "driftline_b")).drop(ROW, COLUMN, *[f"driftline_{s}{k}" for s in "ab" for k in "xyz"])
    return near.withColumn("distance_km", apart_km(lat, lon)).filter(F.col("distance_km") <= km)


def apart_km(lat: str, lon: str) -> Column:
    return geodesy.haversine_km(F.col(lon), F.col(lat), F.col(f"r_{lon}"), F.col(f"r_{lat}"))


#: The largest radius of a growing search, in km; what is left then is searched over the whole globe.
FAR_KM = 3200.0
#: Degrees of the cells of that search, and of those within them.
GLOBE = (15.0, 3.0, 0.6)
WHOLE_KM = 20_100.0


def nearest(points: DataFrame, places: DataFrame, keys: list[str], start_km: float = 50.0, lat: str = "lat", lon: str = "lon", only: str | Callable | None = None, same: tuple[str, ...] = (), later: str | None = None) -> DataFrame:
    """Each point with its nearest place, of those that `only` permits; a point with none has no row.

    only: SQL text over the point's columns and the place's (with r_), or a function of two functions that give the column of
    a name, of the point and of the place. same: columns in which point and place must be equal, which then join them.
    later: a column of few values that must be greater at the place; places come once for each lesser value and join by it.

    The radius grows fourfold for points still without a place, then spans the globe. At each radius points first meet one
    place of each cell; the nearest of those permitted bounds the distance, and only cells that may hold a nearer place are opened.
    Where a cell's one place is refused, the cell stays open. Points or places without coordinates take no part."""
    if isinstance(only, Column):
        raise TypeError("`only` is SQL text or a function of (point, place): a column may be bound to one table")
    permitted = F.lit(True)
    if only is not None:
        permitted = F.expr(only) if isinstance(only, str) else only(F.col, lambda c: F.col(f"r_{c}"))
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    if later is not None:
        value = F.col(later).alias("driftline_before")
        copies = places.join(F.broadcast(points.select(value).distinct()), F.col("driftline_before") < F.col(later))
        best = nearest(points.select("*", value), copies, keys, start_km, lat, lon, only, (*same, "driftline_before"))
        return best.drop("driftline_before", "r_driftline_before")
    todo, q, found, km = points.filter(known), with_prefix(places.filter(known)), None, start_km
    if same:  # who has no place at all is not looked for all over the globe
        todo = todo.join(places.filter(known).select(*same).distinct().hint(SPREAD), list(same), "left_semi").select(*points.columns)
    while True:
        whole = km > FAR_KM
        best = written(closest(searched(todo, q, keys, WHOLE_KM if whole else km, GLOBE if whole else (km / 2 / DEGREE_KM,), lat, lon, permitted, same), keys), "nearest")
        found = best if found is None else found.unionByName(best)
        if whole:
            return found
        todo = written(todo.join(best.select(*keys).hint(SPREAD), keys, "left_anti").select(*todo.columns), "left")
        if todo.limit(1).count() == 0:
            return found
        km *= 4


def with_prefix(places: DataFrame) -> DataFrame:
    return places.select(*[F.col(c).alias(f"r_{c}") for c in places.columns])


def searched(points: DataFrame, places: DataFrame, keys: list[str], km: float, sizes: tuple[float, ...], lat: str, lon: str, permitted: Column, same: tuple[str, ...]) -> DataFrame:
    """The pairs of points and places (with r_) within km that may be nearest; sizes: of cells and of the cells within them."""
    names = [(f"{ROW}{i}", f"{COLUMN}{i}") for i in range(len(sizes))]
    for own, size in zip(names, sizes):
        places = places.withColumns(dict(zip(own, cell(F.col(f"r_{lat}"), F.col(f"r_{lon}"), size))))
    places = places.withColumns({s: F.col(f"r_{s}") for s in same})
    pairs, at, cells = reached(points, F.lit(km), sizes[0], lat, lon, *names[0]), [*same, *names[0]], list(names[0])
    for k, own in enumerate(names):
        met, at, cells = at, [*at, *own] if k else at, [*cells, *own] if k else cells
        pairs = opened(pairs.join(one_each(places, at, lat, lon).hint(SPREAD), met), keys, [*points.columns, *cells], km, lat, lon, permitted)
    at_end = pairs.join(places.hint(SPREAD), at).withColumn("distance_km", apart_km(lat, lon)).filter(F.col("distance_km") <= km).filter(permitted)
    return at_end.select(*points.columns, *[c for c in places.columns if c.startswith("r_")], "distance_km")


def one_each(places: DataFrame, at: list[str], lat: str, lon: str) -> DataFrame:
    """One place of each cell, whichever hashes least, and radius_km, within which the cell's others lie around it."""
    own = [c for c in places.columns if c.startswith("r_")]
    y, x = F.col(f"r_{lat}"), F.col(f"r_{lon}")
    box = [f(c).alias(f"{n}_{k}") for f, n in ((F.min, "least"), (F.max, "most")) for c, k in ((y, "y"), (x, "x"))]
    cells = places.groupBy(*at).agg(F.min_by(F.struct(*own), F.xxhash64(y, x)).alias("one"), *box)
    # no farther than the box's sides would lie apart at its latitude nearest the equator
    up = F.greatest(F.col("most_y") - F.col(f"one.r_{lat}"), F.col(f"one.r_{lat}") - F.col("least_y"))
    side = F.greatest(F.col("most_x") - F.col(f"one.r_{lon}"), F.col(f"one.r_{lon}") - F.col("least_x"))
    flat = F.when(F.signum("least_y") * F.signum("most_y") <= 0, 0.0).otherwise(F.least(F.abs("least_y"), F.abs("most_y")))
    half = F.pow(F.sin(F.radians(up) / 2), 2) + F.pow(F.cos(F.radians(flat)), 2) * F.pow(F.sin(F.radians(F.least(side, F.lit(180.0))) / 2), 2)
    radius = 2 * geodesy.RADIUS_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0)))) + 1e-6
    return cells.select(*at, "one.*", radius.alias("radius_km"))


def opened(pairs: DataFrame, keys: list[str], columns: list[str], km: float, lat: str, lon: str, permitted: Column) -> DataFrame:
    """The pairs of points and cells where a place nearer than the nearest permitted one seen may be."""
    d = pairs.withColumn("driftline_d", apart_km(lat, lon))
    sure = F.min(F.when(permitted, F.col("driftline_d"))).over(Window.partitionBy(*keys))
    near = F.col("driftline_d") - F.col("radius_km") <= F.least(F.col("driftline_sure"), F.lit(km))
    return d.withColumn("driftline_sure", sure).filter(near).select(*columns)


def closest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    best = pairs.groupBy(*keys).agg(F.min_by(F.struct(*pairs.columns), F.col("distance_km")).alias("x"))
    return best.select("x.*")


def match_stations(solutions: DataFrame, table: DataFrame, default_m: float = 20.0) -> DataFrame:
    """Q1: for each solution the stations within their own radius, and a verdict.

    matched: its own station alone or nearest; renamed: one other station; several; none."""
    radius = F.coalesce("max_dist", F.lit(default_m)) / 1000
    most = float(table.agg(F.coalesce(F.max(radius), F.lit(default_m / 1000))).first()[0])
    near = within_km(solutions, table.select(*KEY, "lat", "lon", "max_dist"), max(most, 0.05)).filter(F.col("distance_km") <= F.coalesce("r_max_dist", F.lit(default_m)) / 1000)
    own = (F.col("NetworkCode") == F.col("r_NetworkCode")) & (F.col("StationCode") == F.col("r_StationCode"))
    keys = [*KEY, "Year", "DOY"]
    seen = near.groupBy(*keys).agg(F.count("*").alias("n"), F.max(own).alias("has_own"), F.min_by(F.struct("r_NetworkCode", "r_StationCode"), "distance_km").alias("best"), F.min("distance_km").alias("distance_km"))
    out = solutions.join(seen, keys, "left")
    best_own = (F.col("best.r_NetworkCode") == F.col("NetworkCode")) & (F.col("best.r_StationCode") == F.col("StationCode"))
    verdict = F.when(F.col("n").isNull(), "none").when(F.col("has_own") & best_own, "matched").when(F.col("n") == 1, "renamed").otherwise("several")
    return out.withColumn("verdict", verdict).drop("has_own")


def with_override(defaults: DataFrame, own: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Own rows with the defaults of their key where a column is null, in order."""
    d = defaults.select(*keys, *[F.col(c).alias(f"default_{c}") for c in columns])
    out = own.join(d, keys, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"default_{c}")) for c in columns})
    return out.drop(*[f"default_{c}" for c in columns]).orderBy(*order)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on columns in which null equals null; right's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    test = F.lit(True)
    for c in keys:
        test = test & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(r, test, "left").drop(*[f"r_{c}" for c in keys])


def two_days(solutions: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Stations with a solution on both days, coordinates of the second with suffix 2."""
    day = lambda d: solutions.filter((F.col("Year") == d[0]) & (F.col("DOY") == d[1]))
    b = day(second).select(*KEY, *[F.col(c).alias(f"{c}2") for c in ("X", "Y", "Z")])
    return day(first).join(b, KEY)


def named(rows: DataFrame, aliases: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose short code is an alias or a station code, with the real key."""
    names = aliases.select(F.coalesce("alias", "StationCode").alias(code), *KEY)
    return rows.join(names, code, "left")
