"""Ordered-series operators: differences, islands, gaps, sessions, event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.storage import written


def period(days: DataFrame, day: str, value: str) -> DataFrame:
    """One row: the first and last of the days, and `places`, for each date between them the array of its values.

    It is no longer than the calendar. Rows of stations take their stretches of it by in_period, instead of a join by day."""
    own = days.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.collect_set(value).alias("values"))
    dates = own.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("INTERVAL 1 DAY"))).alias("day")).join(own, "day", "left")
    none = F.array().cast(own.schema["values"].dataType)
    places = F.array_sort(F.collect_list(F.struct("day", F.coalesce("values", none).alias("values"))))
    return dates.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.transform(places, lambda x: x["values"]).alias("places")).filter("first is not null")


def in_period(lo: Column, hi: Column) -> Column:
    """The values of the days from lo to hi, of a row that is joined with a period."""
    a, b = F.greatest(lo, "first"), F.least(hi, "last")
    return F.when(lo.isNotNull() & hi.isNotNull() & (a <= b), F.flatten(F.slice("places", F.datediff(a, "first") + 1, F.datediff(b, a) + 1)))


def lag_difference(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """`d_<value>` against the row before, and `d_<order>`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in [*values, order]})


def islands(rows: DataFrame, keys: list[str], order: str, step: float) -> DataFrame:
    """`island`, numbered from 0, beginning anew where the order jumps by more than step."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > step).cast("int")
    return rows.withColumn("island", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gaps(rows: DataFrame, keys: list[str], order: str, least: int = 1) -> DataFrame:
    """Gaps of at least so many missing days: last day before, first day after, and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    days = rows.select(*keys, order).distinct().withColumn("next", F.lead(order).over(w))
    return days.withColumn("gap_days", F.col("next") - F.col(order) - 1).filter(F.col("gap_days") >= least).withColumnRenamed(order, "last")


def session_gaps(sessions: DataFrame, keys: list[str], seconds: int = 1) -> DataFrame:
    """Equipment sessions with the next one's start, where more than a second lies between."""
    nxt = F.lead("DateStart").over(Window.partitionBy(*keys).orderBy("DateStart"))
    s = sessions.withColumn("next_start", nxt)
    apart = F.unix_seconds(F.col("next_start").cast("timestamp")) - F.unix_seconds(F.col("DateEnd").cast("timestamp"))
    return s.withColumn("gap_s", apart).filter(F.col("gap_s") > seconds)


def changes(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows of which some column differs from the row before; first rows are no changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("driftline_new", ~first & ~same).filter("driftline_new").drop("driftline_new")


def runs(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Runs of equal values as rows of first, last and count.

    Rows of equal order stand at one place: all changes among them come before each of them, so that none joins a run from before
    unless none of them changes. Among themselves they follow by their values."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = Window.partitionBy(*keys).orderBy(order, *columns)
    new = F.lit(False)
    for c in columns:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(before))
    marked = rows.withColumn("run", F.sum(new.cast("int")).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "run", *columns).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def header_sessions(files: DataFrame, keys: list[str], order: str, columns: list[str], ignore: int = 0) -> DataFrame:
    """Equipment sessions from file headers; changes of at most `ignore` files belong to the session before.

    Short runs are dropped and equal neighbours joined again: windows only, as each run is one row by then."""
    first = runs(files, keys, order, columns)
    w = Window.partitionBy(*keys).orderBy("first")
    kept = first.withColumn("place", F.row_number().over(w)).filter((F.col("n") > ignore) | (F.col("place") == 1))
    again = F.lit(False)
    for c in columns:
        again = again | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = kept.withColumn("session", F.sum(again.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "session", *columns).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("session")


def strongest_in_window(events: DataFrame, keys: list[str], day: str, magnitude: str, days: float = 15.0) -> DataFrame:
    """In each window of so many days, which begins at its first event, the strongest event; of equal ones the earliest.

    A window begins at the first event behind the window before, so that where windows begin is a chain from the key's first
    event (Spark's session windows are not the same, as they reach on with each event). Each event's successor comes from
    stretches of so many days, and pointers that double find the chain in log n joins: a key that holds all
    events is no single task's work."""
    key, at = "driftline_key", "driftline_at"
    known = events.filter(F.col(day).isNotNull()).withColumns({key: F.struct(*keys), at: F.col(day).cast("double")})
    places = written(known.select(key, at).distinct(), "places")
    starts = chained(places, written(successors(places, key, at, days), "successors"), key, at)
    window = at_or_before(known, starts, key, at, days, "driftline_start")
    rank = F.struct(F.col(magnitude), -F.col(at))
    best = window.groupBy(key, "driftline_start").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in events.columns]), rank).alias("x"))
    return best.select("x.*")


def successors(places: DataFrame, key: str, at: str, days: float) -> DataFrame:
    """key, at and next: of each place the first one of its key more than so many days on, null for the last ones."""
    stretch = F.floor(F.col("driftline_x") / days)
    marks = places.select(key, (F.col(at) + days).alias("driftline_x"), F.col(at).alias("of"))
    both = marks.unionByName(places.select(key, F.col(at).alias("driftline_x"), F.lit(None).cast("double").alias("of"))).withColumn("s", stretch)
    # behind a mark in its stretch: places at the mark itself do not count
    later = Window.partitionBy(key, "s").orderBy(F.desc("driftline_x"), F.col("of").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = both.withColumn("next", F.min(F.when(F.col("of").isNull(), F.col("driftline_x"))).over(later)).filter("of is not null")
    firsts = places.withColumn("s", F.floor(F.col(at) / days)).groupBy(key, "s").agg(F.min(at).alias("first"))
    grid = firsts.select(key, "s", "first", F.lit(True).alias("real")).unionByName(ahead.select(key, "s").distinct().withColumns({"first": F.lit(None).cast("double"), "real": F.lit(False)}))
    # stretches are as many as the time has windows
    beyond = F.min("first").over(Window.partitionBy(key).orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, -1))
    behind = grid.withColumn("beyond", beyond).groupBy(key, "s").agg(F.min("beyond").alias("beyond"))
    return ahead.join(behind, [key, "s"]).select(key, F.col("of").alias(at), F.coalesce("next", "beyond").alias("next"))


def chained(places: DataFrame, following: DataFrame, key: str, at: str) -> DataFrame:
    """The places that following leads to from the first of each key, by pointers that double."""
    found = places.groupBy(key).agg(F.min(at).alias(at))
    jump = following.filter("next is not null")
    while jump.limit(1).count():
        found = written(found.unionByName(found.join(jump, [key, at]).select(key, F.col("next").alias(at))).distinct(), "chain")
        jump = written(jump.join(jump.select(key, F.col(at).alias("next"), F.col("next").alias("over")), [key, "next"]).select(key, at, F.col("over").alias("next")), "jumps")
    return found


def at_or_before(rows: DataFrame, starts: DataFrame, key: str, at: str, days: float, name: str) -> DataFrame:
    """rows with the last of the starts of their key that is not behind them."""
    s = F.floor(F.col(at) / days)
    marked = rows.withColumns({"driftline_s": s, "driftline_mark": F.lit(None).cast("double")})
    marks = starts.select(key, at, s.alias("driftline_s"), F.col(at).alias("driftline_mark"))
    within = Window.partitionBy(key, "driftline_s").orderBy(at, F.col("driftline_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.unionByName(marks.withColumn("driftline_is_mark", F.lit(True)), allowMissingColumns=True).withColumn("driftline_here", F.max("driftline_mark").over(within)).filter("driftline_is_mark is null")
    last = marks.groupBy(key, "driftline_s").agg(F.max("driftline_mark").alias("last"))
    every = last.unionByName(own.select(key, "driftline_s").distinct(), allowMissingColumns=True).groupBy(key, "driftline_s").agg(F.max("last").alias("last"))
    before = F.max("last").over(Window.partitionBy(key).orderBy("driftline_s").rowsBetween(Window.unboundedPreceding, -1))
    found = own.join(every.withColumn("driftline_before", before).drop("last"), [key, "driftline_s"])
    return found.withColumn(name, F.coalesce("driftline_here", "driftline_before")).drop("driftline_s", "driftline_mark", "driftline_is_mark", "driftline_here", "driftline_before")


def days_to_next(jumps: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Days from each jump to the next, null for the last."""
    return jumps.withColumn("days_to_next", F.lead(day).over(Window.partitionBy(*keys).orderBy(day)) - F.col(day))


def points_between(jumps: DataFrame, series: DataFrame, keys: list[str], day: str) -> DataFrame:
    """The number of observations from each jump to the next.

    Jumps and observations are one ordered series: a running count of jumps numbers the stretches, no join by range."""
    marks = jumps.select(*keys, F.col(day).alias("at"), F.lit(1).alias("jump"))
    both = marks.union(series.select(*keys, F.col(day).alias("at"), F.lit(0).alias("jump")))
    w = Window.partitionBy(*keys).orderBy("at", F.desc("jump")).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("stretch", F.sum("jump").over(w)).filter("stretch > 0")
    return counted.groupBy(*keys, "stretch").agg(F.min(F.when(F.col("jump") == 1, F.col("at"))).alias(day), F.sum(1 - F.col("jump")).alias("n_points")).drop("stretch")


def largest_wrapped_gap(rows: DataFrame, keys: list[str], fyear: str) -> DataFrame:
    """The largest step between the distinct fractions of the year that a key has data at, the turn included."""
    part = rows.select(*keys, (F.col(fyear) - F.floor(fyear)).alias("part")).distinct()
    step = part.withColumn("step", F.col("part") - F.lag("part").over(Window.partitionBy(*keys).orderBy("part")))
    return step.groupBy(*keys).agg(F.greatest(F.coalesce(F.max("step"), F.lit(0.0)), 1 - F.max("part") + F.min("part")).alias("largest_gap"))


def expected_days(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First and last day, days with data and days missing of each key."""
    span = rows.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("n_days"))
    return span.withColumn("n_missing", F.datediff("last", "first") + 1 - F.col("n_days"))


def hash_of(*columns: Column) -> Column:
    """A change-set key of a row (E15): the signed CRC-32 of its values."""
    c = F.crc32(F.concat_ws("|", *[x.cast("string") for x in columns]))
    return F.when(c >= 2**31, c - 2**32).otherwise(c)
