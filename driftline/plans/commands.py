"""The archive's tasks as functions over a table store: what a user runs, composed from the operators.

Every function takes a Store and returns DataFrames; those that change tables say so. COMMANDS lists them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import calendar
from driftline.operators import alignment, archive, joins, network, quality, seismic, selection, trajectory, windows
from driftline.operators.selection import KEY
from driftline.sources import parsers, sinks
from driftline.sources.schema import KEYS, SCHEMAS
from driftline.sources.store import Store

COMMANDS = {}


def command(f):
    COMMANDS[f.__name__] = f
    return f


def positions(store: Store, stations: list[str] = ("all",)) -> DataFrame:
    """The point-position series of stations, days with t and mjd, exclusions and blunders out."""
    table = selection.stations(store.read("stations"), list(stations))
    p = store.read("ppp_soln").join(table.select(*KEY), KEY, "left_semi")
    day = calendar.date_of(F.col("Year"), F.col("DOY"))
    p = p.withColumns({"FYear": calendar.fractional_year(F.col("Year"), F.col("DOY")), "mjd": calendar.mjd(day), **{c: F.col(c).cast("double") for c in "XYZ"}})
    return trajectory.load(p, table, store.read("ppp_soln_excl"))


def fyear(day):
    year = F.year(day)
    return year + (F.dayofyear(day) - 0.5) / F.when(year % 4 == 0, 366).otherwise(365)


def station_jumps(store: Store) -> DataFrame:
    """Steps from equipment and frames, steps and decays from events, with user overrides."""
    sol = store.read("ppp_soln").withColumn("t", calendar.fractional_year(F.col("Year"), F.col("DOY")))
    gaps = windows.largest_wrapped_gap(sol, KEY, "t")
    user = store.read("etm_params").filter("object = 'jump'")
    at = calendar.fractional_year(F.col("Year"), F.col("DOY"))
    kind = F.when(F.col("jump_type") == 0, "step").otherwise("both")
    user = user.select(*KEY, at.alias("at"), "action", kind.alias("kind"), F.coalesce(F.get("relaxation", F.lit(0)), F.lit(0.5)).alias("relaxation"))
    steps = trajectory.equipment_jumps(store.read("stationinfo"), gaps, user).unionByName(trajectory.frame_jumps(store.read("ppp_soln")))
    quakes = store.read("earthquakes").withColumn("fyear", fyear(F.col("date")))
    hit = seismic.affected(store.read("stations").filter("lat is not null").select(*KEY, "lat", "lon"), quakes.select("id", "lat", "lon", "mag", "fyear"))
    strong = windows.strongest_in_window(seismic.jumps_from_events(hit).select(*KEY, (F.col("at") * 365.25).alias("day"), "mag", "kind", "at", "relaxation"), KEY, "day", "mag")
    return steps.unionByName(strong.select(*KEY, "kind", "at", "relaxation"))


@command
def fit(store: Store, stations: list[str] = ("all",)) -> DataFrame:
    """Trajectory terms of stations."""
    series = positions(store, stations)
    return trajectory.fit_trajectories(series, station_jumps(store).join(series.select(*KEY).distinct(), KEY, "left_semi"))


@command
def query_positions(store: Store, dates: DataFrame, stations: list[str] = ("all",)) -> dict[str, DataFrame]:
    """Positions at dates (station key and t), velocities and seasonal amplitudes."""
    series = positions(store, stations)
    terms = fit(store, stations)
    return {"positions": trajectory.position(series, terms, dates), "velocity": trajectory.velocity(terms), "seasonal": trajectory.seasonal(terms)}


@command
def repeatability(store: Store, project: str) -> DataFrame:
    """Day-to-day scatter of a project's network solutions, each day aligned to the one before."""
    days = store.read("gamit_soln").filter(F.col("Project") == project).select(*KEY, "Year", "DOY", "X", "Y", "Z")
    aligned = alignment.chain(days).withColumns({"FYear": calendar.fractional_year(F.col("Year"), F.col("DOY")), "mjd": calendar.mjd(calendar.date_of(F.col("Year"), F.col("DOY")))})
    return trajectory.repeatability(trajectory.load(aligned, store.read("stations").withColumn("max_dist", F.lit(1e7))))


@command
def stack(store: Store, project: str, name: str, passes: int = 4, cut=None) -> DataFrame:
    """The project's days aligned to the stations' motions; saved days whose stations did not change are kept."""
    columns = [*KEY, "Year", "DOY", "X", "Y", "Z"]
    days = store.read("gamit_soln").filter(F.col("Project") == project).select(*columns)
    saved = store.read("stacks").filter(F.col("name") == name).select(*columns)
    kept, redo = alignment.build_stack(days, saved)
    return kept.unionByName(alignment.align_stack(redo, passes, cut=cut))


@command
def plate(store: Store, project: str, lat: tuple[float, float], lon: tuple[float, float]) -> dict:
    """Euler pole from the stations of a box that no event has moved."""
    table = store.read("stations").withColumns({c: F.col(c).cast("double") for c in ("DateStart", "DateEnd")})
    hit = seismic.affected(table.filter("lat is not null").select(*KEY, "lat", "lon"), store.read("earthquakes").select("id", "lat", "lon", "mag"))
    own = alignment.plate_candidates(table, hit, lat, lon)
    days = store.read("gamit_soln").filter(F.col("Project") == project).withColumn("t", calendar.fractional_year(F.col("Year"), F.col("DOY")))
    v = days.join(own.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(*[F.regr_slope(c, "t").alias(f"v{c.lower()}") for c in "XYZ"])
    return alignment.euler_pole(v.join(own, KEY).dropna(subset=["vx", "vy", "vz"]))


@command
def plan(store: Store, first: tuple[int, int], last: tuple[int, int], method: str = "agglomerative") -> dict[str, DataFrame]:
    """Clusters of the active stations of each day of a period, and their expected times."""
    files = selection.day_range(archive.best_files(store.read("rinex")), first, last, "ObservationYear", "ObservationDOY")
    days = files.select(F.col("ObservationYear").alias("Year"), F.col("ObservationDOY").alias("DOY")).distinct()
    active = network.active_stations(store.read("stations").filter("auto_x is not null"), files, days)
    members = network.clusters(active, method)
    return {"members": members, "times": network.cluster_times(members), "missing": network.missing_station_days(active, days)}


@command
def integrity(store: Store, antennas: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reports on equipment, serial numbers, files per day, gaps, completeness and coherence of places."""
    files, sessions = store.read("rinex"), store.read("stationinfo")
    days = archive.best_files(files).withColumn("mjd", calendar.mjd(calendar.date_of(F.col("ObservationYear"), F.col("ObservationDOY"))))
    return {
        "equipment": quality.equipment_faults(sessions, files, antennas if antennas is not None else store.read("antennas")), "receivers": quality.serial_mismatches(files, sessions, "Receiver"),
        "antennas": quality.serial_mismatches(files, sessions, "Antenna"), "files_per_day": archive.files_per_day(files), "gaps": windows.gaps(days, KEY, "mjd"),
        "completeness": archive.completeness(days, store.read("ppp_soln").dropDuplicates([*KEY, "Year", "DOY"])), "duplicates": selection.duplicate_codes(store.read("stations")),
    }


@command
def affected_stations(store: Store, event: str) -> DataFrame:
    """Stations within the reach of one event, with scores."""
    quake = store.get("earthquakes", id=event).select("id", "lat", "lon", "mag", "depth")
    return seismic.affected(store.read("stations").filter("lat is not null").select(*KEY, "lat", "lon"), quake)


@command
def close_sessions(store: Store) -> DataFrame:
    """Open equipment records with the last file of their station as end."""
    last = store.read("rinex").groupBy(*KEY).agg(F.max("ObservationETime").alias("last"))
    return store.read("stationinfo").filter("DateEnd is null").join(last, KEY).withColumn("DateEnd", F.col("last")).drop("last")


@command
def pending_positions(store: Store) -> DataFrame:
    """Best files without a point position."""
    done = store.read("ppp_soln").select(*KEY, F.col("Year").alias("ObservationYear"), F.col("DOY").alias("ObservationDOY"))
    return joins.without_solution(archive.best_files(store.read("rinex")), done, archive.FILE_DAY)


@command
def downloads(store: Store, days: DataFrame) -> DataFrame:
    """Sources to try for station days without a good file."""
    servers = store.read("sources_servers")
    sources = joins.with_override(servers, store.read("sources_stations"), ["server_id"], ["path", "format"], ["try_order"])
    return quality.download_queue(store.read("stations"), days, store.read("rinex"), store.read("stationinfo"), sources)


@command
def extend_catalogue(store: Store, received: DataFrame) -> DataFrame:
    """Adds events whose id is new to the table, and returns them."""
    new = seismic.new_events(store.read("earthquakes"), received)
    store.insert("earthquakes", new, skip_known=True)
    return new


@command
def override_model(store: Store, changes: DataFrame) -> DataFrame:
    """Applies changes of model parameters to the table, and returns those refused."""
    store.replace("etm_params", trajectory.change_parameters(store.read("etm_params"), changes))
    return trajectory.refused_changes(changes)


@command
def time_spans(store: Store) -> None:
    """Sets each station's first and last epoch from its files."""
    span = archive.time_span(store.read("rinex"))
    s = store.read("stations").drop("DateStart", "DateEnd").join(span, KEY, "left")
    store.replace("stations", s)


@command
def delays(store: Store, project: str) -> DataFrame:
    """Zenith delays of a project as text lines, with the file each goes to."""
    return sinks.delay_lines(store.read("gamit_ztd").filter(F.col("Project") == project))


@command
def weekly_combination(store: Store, project: str, residuals: DataFrame, limit: float) -> DataFrame:
    """Which station days (key, Year, DOY, residual) a combination uses, under the names of the project's runs."""
    return quality.weekly_list(store.read("gamit_subnets").filter(F.col("Project") == project), residuals, limit)


@command
def run_statistics(store: Store, project: str) -> DataFrame:
    """Each day's runs, stations, mean misfit and ambiguity rates, and longest run."""
    runs = store.read("gamit_stats").filter(F.col("Project") == project)
    means = [F.avg(c).alias(c) for c in ("nrms", "WL", "NL")]
    return runs.groupBy("Year", "DOY", "system").agg(F.count("*").alias("runs"), F.sum("cluster_size").alias("stations"), *means, F.max("runtime").alias("longest"))


@command
def add_sessions(store: Store, new: DataFrame) -> DataFrame:
    """Merges equipment records into the table, and returns those refused."""
    current = store.read("stationinfo")
    kept, refused = quality.insert_sessions(current, store.conformed("stationinfo", new))
    store.replace("stationinfo", kept)
    return refused


@command
def exclude(store: Store, days: DataFrame) -> None:
    """Adds station days to the exclusions, and removes their solutions."""
    listed, left = quality.excluded(store.read("ppp_soln"), store.read("ppp_soln_excl"), days)
    store.replace_all({"ppp_soln_excl": listed, "ppp_soln": left})


@command
def drop_files(store: Store, gone: DataFrame) -> DataFrame:
    """Removes files, and the solutions of days that are left without one, which it returns."""
    solutions = store.read("ppp_soln")
    files, kept = quality.remove_file(store.read("rinex"), solutions, gone)
    store.replace_all({"rinex": files, "ppp_soln": kept})
    return solutions.join(kept.select(*KEY, "Year", "DOY").distinct(), [*KEY, "Year", "DOY"], "left_anti")


def holding(store: Store, key: tuple[str, str]) -> dict[str, DataFrame]:
    """The tables that hold rows of a station."""
    tables = {name: store.read(name) for name in SCHEMAS}
    own = {n: t for n, t in tables.items() if set(KEY) <= set(t.columns)}
    return {n: t for n, t in own.items() if not selection.matching(t, NetworkCode=key[0], StationCode=key[1]).isEmpty()}


@command
def rename_station(store: Store, old: tuple[str, str], new: tuple[str, str]) -> list[str]:
    """Moves a station's rows to another key in every table that holds any, all in one change; rows of that key stay as
    they are. Returns the tables' names."""
    moved = quality.renamed(holding(store, old), KEYS, old, new)
    store.replace_all(moved)
    return sorted(moved)


@command
def remove_station(store: Store, key: tuple[str, str]) -> list[str]:
    """Removes a station's rows from every table that holds any, all in one change; returns the tables' names."""
    gone = selection.condition(NetworkCode=key[0], StationCode=key[1])
    left = {n: t.filter(~F.coalesce(gone, F.lit(False))) for n, t in holding(store, key).items()}
    store.replace_all(left)
    return sorted(left)


@command
def compare(store: Store, other: Store, km: float = 0.1) -> DataFrame:
    """Stations that the other archive holds neither at their place nor by their code."""
    return quality.missing_elsewhere(store.read("stations"), other.read("stations").select(*KEY, "lat", "lon"), km)


@command
def station_map(store: Store, stations: list[str] = ("all",)) -> DataFrame:
    """A placemark of each station with a place: its files, the share of them that is solved, and its equipment's faults."""
    s = selection.stations(store.read("stations"), list(stations)).filter("lat is not null and lon is not null").fillna(0.0, ["height"])
    files = store.read("rinex")
    share = archive.completeness(files, store.read("ppp_soln"))
    faults = quality.equipment_faults(store.read("stationinfo"), files, store.read("antennas")).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("fault")), ", ").alias("faults"))
    s = s.join(share, KEY, "left").join(faults, KEY, "left").fillna(0, ["n_files"]).fillna(0.0, ["percent"]).fillna("none", ["faults"])
    return sinks.placemark_lines(s, F.format_string("%d files, %.1f %% solved; faults: %s", "n_files", "percent", "faults"))


@command
def orbits_wanted(store: Store, listing: DataFrame) -> DataFrame:
    """Days of the archive's files whose orbit (gps_week, gps_day) is not listed."""
    days = store.read("rinex").select(calendar.date_of(F.col("ObservationYear"), F.col("ObservationDOY")).alias("day")).distinct()
    return quality.missing_orbits(days, listing)


@command
def edit_session(store: Store, key: tuple[str, str], start, **values) -> None:
    """Sets columns of the equipment record that begins at start; an edit that would clash with another record raises."""
    current = store.read("stationinfo")
    own = F.coalesce(selection.condition(NetworkCode=key[0], StationCode=key[1], DateStart=start), F.lit(False))
    edited = current.filter(own).withColumns({c: F.lit(v).cast(current.schema[c].dataType) for c, v in values.items()})
    if edited.isEmpty():
        raise selection.NothingFound(f"no record of {'.'.join(key)} begins at {start}")
    far, others = F.lit(joins.FAR).cast("timestamp_ntz"), current.filter(~own)
    taken = others.select(*KEY, F.col("DateStart").alias("s"), F.coalesce("DateEnd", far).alias("e"))
    if not edited.join(taken, KEY).filter((F.col("s") < F.coalesce("DateEnd", far)) & (F.col("e") > F.col("DateStart")) | (F.col("s") == F.col("DateStart"))).isEmpty():
        raise ValueError(f"the record of {'.'.join(key)} at {start} would clash with another")
    store.replace("stationinfo", others.unionByName(edited))


PACKED = ("stations", "stationinfo")


@command
def export_stations(store: Store, stations: list[str] = ("all",)) -> DataFrame:
    """A JSON text of each station with its equipment records in order of their start."""
    s = selection.stations(store.read("stations"), list(stations))
    info = store.read("stationinfo")
    records = info.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("DateStart", *[c for c in info.columns if c not in (*KEY, "DateStart")]))).alias("records"))
    return sinks.as_json(s.join(records, KEY, "left"))


@command
def import_stations(store: Store, files: DataFrame) -> DataFrame:
    """Adds the stations of exported texts (path, text) that the archive lacks, and merges equipment records whose
    start it lacks, in one change; returns the records refused."""
    table, info = (store.spark.createDataFrame([], SCHEMAS[n]) for n in PACKED)
    record = info.drop(*KEY).schema.simpleString()
    found = parsers.packages(files, f"{table.schema.simpleString()[:-1]},records:array<{record}>>").select("station.*").filter("NetworkCode is not null and StationCode is not null")
    known = store.read("stations")
    new = store.conformed("stations", found).dropDuplicates(list(KEY)).join(known.select(*KEY), KEY, "left_anti")
    records = store.conformed("stationinfo", found.select(*KEY, F.explode("records").alias("r")).select(*KEY, "r.*")).distinct()
    current = store.read("stationinfo")
    kept, refused = quality.insert_sessions(current, records.join(current.select(*KEYS["stationinfo"]), KEYS["stationinfo"], "left_anti").select(*current.columns))
    store.replace_all({"stations": known.unionByName(new.select(*known.columns)), "stationinfo": kept})
    return refused


@command
def adopt_aliases(store: Store) -> DataFrame:
    """Gives stations of a repeated code that have no alias theirs, and returns these."""
    s = store.read("stations")
    given = network.aliases(s).join(s.filter("alias is null").select(*KEY), KEY, "left_semi")
    store.replace("stations", s.join(given.withColumnRenamed("alias", "given"), KEY, "left").withColumn("alias", F.coalesce("alias", "given")).select(*s.columns))
    return given
