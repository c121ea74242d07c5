import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import archive, joins, quality, selection, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


T = dt.datetime


@pytest.fixture(scope="module")
def files(spark):
    data = [("a", "one", 2020, 1, 30.0, 0.9), ("a", "one", 2020, 1, 15.0, 0.9), ("a", "one", 2020, 1, 15.0, 0.5), ("a", "one", 2020, 2, 30.0, 0.4), ("b", "two", 2020, 1, 200.0, 1.0)]
    return spark.createDataFrame(data, "NetworkCode string, StationCode string, ObservationYear int, ObservationDOY int, Interval double, Completion double")


def test_best_file_equals_the_anti_join(spark, files):
    r = random.Random(1)
    many = spark.createDataFrame([("n", f"s{r.randint(0, 5)}", 2020, r.randint(1, 9), float(r.choice([1, 15, 30])), r.choice([0.2, 0.5, 0.9, 1.0])) for _ in range(300)], files.schema).distinct()
    many.createOrReplaceTempView("rinex_files")
    want = spark.sql("""select a.* from rinex_files a left anti join rinex_files b on a.StationCode = b.StationCode and a.ObservationDOY = b.ObservationDOY and a.Completion < b.Completion""")
    want.createOrReplaceTempView("rinex_top")
    want = spark.sql("select NetworkCode, StationCode, ObservationYear, ObservationDOY, Interval, Completion from (select *, min(Interval) over (partition by StationCode, ObservationDOY) m from rinex_top) where Interval = m")
    assert rows(archive.best_files(many)) == rows(want)
    assert rows(selection.processable(files)) == rows(files.filter("Completion >= 0.5 and Interval <= 120"))
    plan = archive.best_files(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0


@pytest.fixture(scope="module")
def stations(spark):
    data = [("ars", "igm1", "ARG", -34.5, -58.4, None), ("ars", "lpgs", "ARG", -34.9, -57.9, 20.0), ("chi", "igm1", "CHL", -33.4, -70.6, None), ("?tm", "tmp1", "CHL", -33.4, -70.7, None), ("chi", "null", "CHL", None, None, None)]
    return spark.createDataFrame(data, "NetworkCode string, StationCode string, country_code string, lat double, lon double, max_dist double").withColumn("alias", F.lit(None).cast("string")).withColumn("DateStart", F.lit(2000.0))


def test_station_lists(stations):
    names = lambda *w: [".".join(r[:2]) for r in selection.stations(stations, list(w)).select("NetworkCode", "StationCode").collect()]
    assert sorted(names("all")) == ["ars.igm1", "ars.lpgs", "chi.igm1", "chi.null"]
    assert sorted(names("ARG")) == ["ars.igm1", "ars.lpgs"] and names("chi.all", "-chi.igm1") == ["chi.null"]
    assert sorted(names("igm_")) == ["ars.igm1", "chi.igm1"] and names("ARG", "*lp%") == ["ars.igm1"]
    with pytest.raises(selection.NothingFound):
        selection.lookup(stations, StationCode="none")
    assert selection.lookup(stations, NetworkCode="chi", lat=None).count() == 1
    assert selection.duplicate_codes(stations).count() == 2
    assert selection.integer_set("1;3-5;<3", 9) == [1, 2, 3, 4, 5]


def test_spatial_joins_equal_all_pairs(spark):
    r = random.Random(2)
    p = [(i, r.uniform(-89.9, 89.9), r.uniform(-180, 180)) for i in range(250)] + [(900, 10.0, 179.99), (901, 10.0, -179.99), (902, 89.95, 0.0), (903, 89.95, 180.0)]
    df = spark.createDataFrame(p, "id int, lat double, lon double")

    def km(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    for radius in (30.0, 900.0):
        want = sorted((a[0], b[0]) for a in p for b in p if km(a, b) <= radius)
        got = sorted((x["id"], x["r_id"]) for x in joins.within_km(df, df, radius).collect())
        assert got == want
    few = df.filter("id % 25 = 0")
    got = {x["id"]: x["distance_km"] for x in joins.nearest(df, few, ["id"]).collect()}
    targets = [x for x in p if x[0] % 25 == 0]
    assert len(got) == len(p) and all(got[a[0]] == pytest.approx(min(km(a, b) for b in targets), abs=1e-6) for a in p)


@pytest.fixture(scope="module")
def sessions(spark):
    data = [
        ("a", "one", T(2010, 1, 1), T(2012, 1, 1), "r1", "s1", "ant1", "x1", "none"), ("a", "one", T(2012, 1, 1, 0, 0, 2), T(2013, 6, 1), "r1", "s2", "ant1", "x1", "none"),
        ("a", "one", T(2013, 1, 1), None, "r2", "s3", "ant2", "x2", "none"), ("b", "two", T(2010, 1, 1), None, "r1", "s9", "zzz", "x1", "none"),
    ]
    return spark.createDataFrame(data, "NetworkCode string, StationCode string, DateStart timestamp_ntz, DateEnd timestamp_ntz, ReceiverCode string, ReceiverSerial string, AntennaCode string, AntennaSerial string, RadomeCode string")


def test_intervals(spark, sessions):
    at = spark.createDataFrame([("a", "one", T(2011, 5, 5)), ("a", "one", T(2013, 3, 1)), ("a", "one", T(2020, 1, 1)), ("a", "one", T(2012, 1, 1, 0, 0, 1)), ("a", "one", T(2001, 1, 1))], "NetworkCode string, StationCode string, t timestamp_ntz")
    got = {r["t"]: r["ReceiverSerial"] for r in joins.valid_at(at, sessions, selection.KEY, "t").collect()}
    assert got == {T(2011, 5, 5): "s1", T(2013, 3, 1): "s2", T(2020, 1, 1): "s3"}
    assert len(joins.valid_at(at, sessions, selection.KEY, "t", tolerance_s=1).collect()) == 4
    over = joins.overlaps(sessions, selection.KEY).collect()
    assert [(r["DateStart_a"], r["DateStart_b"]) for r in over] == [(T(2012, 1, 1, 0, 0, 2), T(2013, 1, 1))]
    assert windows.session_gaps(sessions, selection.KEY).collect()[0]["gap_s"] == 2
    change = windows.changes(sessions, selection.KEY, "DateStart", ["AntennaCode", "RadomeCode"]).collect()
    assert [r["AntennaCode"] for r in change] == ["ant2"]


def test_quality_reports(spark, sessions, files):
    f = spark.createDataFrame([("a", "one", T(2011, 1, 1, 0), T(2011, 1, 1, 23), "S1"), ("a", "one", T(2011, 1, 2, 0), T(2011, 1, 2, 23), "wrong"), ("a", "one", T(2011, 1, 3, 0), T(2011, 1, 3, 23), "wrong"), ("a", "one", T(2009, 1, 3, 0), T(2009, 1, 3, 23), "s1")], "NetworkCode string, StationCode string, ObservationSTime timestamp_ntz, ObservationETime timestamp_ntz, ReceiverSerial string")
    bad = quality.serial_mismatches(f, sessions).collect()
    assert len(bad) == 1 and bad[0]["n"] == 2 and bad[0]["first"].day == 2
    faults = quality.equipment_faults(sessions, f, spark.createDataFrame([("ant1",), ("ant2",)], "AntennaCode string"))
    assert rows(faults.groupBy("fault").count()) == [("file without record", 1), ("overlap", 1), ("unknown antenna", 1)]
    new = spark.createDataFrame([("b", "two", T(2015, 1, 1), None, "r5", "s5", "ant1", "x1", "none"), ("a", "one", T(2011, 1, 1), T(2011, 2, 1), "r5", "s5", "ant1", "x1", "none"), ("b", "two", T(2009, 1, 1), T(2009, 5, 1), "r1", "s9", "zzz", "x1", "none")], sessions.schema)
    merged, refused = quality.insert_sessions(sessions, new)
    assert [r["DateStart"] for r in refused.collect()] == [T(2011, 1, 1)]
    b = sorted((r["DateStart"], r["DateEnd"]) for r in merged.filter("StationCode = 'two'").collect() if r["DateEnd"])
    assert b == [(T(2009, 1, 1), T(2014, 12, 31, 23, 59, 59))]
    gone = files.limit(0).unionByName(files.filter("ObservationDOY = 2"))
    soln = spark.createDataFrame([("a", "one", 2020, 1), ("a", "one", 2020, 2)], "NetworkCode string, StationCode string, Year int, DOY int")
    left, alive = quality.remove_file(files, soln, gone)
    assert left.count() == 4 and rows(alive) == [("a", "one", 2020, 1)]
    out = quality.renamed({"s": soln}, {"s": ["NetworkCode", "StationCode", "Year", "DOY"]}, ("a", "one"), ("c", "three"))["s"]
    assert rows(out) == [("c", "three", 2020, 1), ("c", "three", 2020, 2)]


def test_queue(spark, sessions):
    day = lambda d: dt.date(2020, 1, d)
    table = spark.createDataFrame([("a", "one"), ("b", "two")], "NetworkCode string, StationCode string")
    days = spark.createDataFrame([(day(1),), (day(2),)], "day date")
    have = spark.createDataFrame([("a", "one", 2020, 1, 0.9), ("a", "one", 2020, 2, 0.1)], "NetworkCode string, StationCode string, ObservationYear int, ObservationDOY int, Completion double")
    src = spark.createDataFrame([("a", "one", 1, 10), ("a", "one", 2, 20)], "NetworkCode string, StationCode string, try_order int, server_id int")
    q = quality.download_queue(table, days, have, sessions, src)
    assert rows(q.select("day", "server_id")) == [(day(2), 10), (day(2), 20)]
    failed = spark.createDataFrame([("a", "one", day(2), 10)], "NetworkCode string, StationCode string, day date, server_id int")
    assert quality.next_source(q, failed).collect()[0]["server_id"] == 20


def test_series_windows(spark):
    d = spark.createDataFrame([("a", x, v) for x, v in [(1, 1.0), (2, 1.0), (3, 1.0), (70, 2.0), (71, 3.0), (140, 3.0)]], "k string, mjd int, v double")
    i = windows.islands(d, ["k"], "mjd", 60)
    assert [r["island"] for r in i.orderBy("mjd").collect()] == [0, 0, 0, 1, 1, 2]
    assert [(r["last"], r["gap_days"]) for r in windows.gaps(d, ["k"], "mjd").orderBy("last").collect()] == [(3, 66), (71, 68)]
    e = spark.createDataFrame([("a", float(x), m) for x, m in [(0, 6.0), (10, 7.0), (16, 6.5), (20, 6.1), (40, 5.0)]], "k string, t double, m double")
    assert [r["t"] for r in windows.strongest_in_window(e, ["k"], "t", "m").orderBy("t").collect()] == [10.0, 16.0, 40.0]
    s = spark.createDataFrame([("a", x, c) for x, c in enumerate("xxxyxxzzz")], "k string, t int, c string")
    assert [(r["first"], r["c"]) for r in windows.header_sessions(s, ["k"], "t", ["c"], ignore=1).orderBy("first").collect()] == [(0, "x"), (6, "z")]
    p = windows.points_between(e.filter("t in (10, 20)"), e, ["k"], "t").orderBy("t").collect()
    assert [(r["t"], r["n_points"]) for r in p] == [(10.0, 2), (20.0, 2)]
    kept = selection.distinct_within(e, ["k"], "t", 8.0).orderBy("t").collect()
    assert [r["t"] for r in kept] == [0.0, 10.0, 20.0, 40.0]


def test_names_and_paths(spark):
    names = ["/x/igm10010.20d.Z", "/x/igm10010.98o", "/x/IGM100ARG_R_20200010000_01D_30S_MO.crx.gz", "/x/igm1001.20d", "readme.txt"]
    got = [r["f"] for r in spark.createDataFrame([(n,) for n in names], "p string").select(archive.file_name(F.col("p")).alias("f")).collect()]
    assert [(f["station"], f["year"], f["doy"], f["kind"], f["version"]) if f else None for f in got] == [("igm1", 2020, 1, "d", 2), ("igm1", 1998, 1, "o", 2), ("igm1", 2020, 1, "d", 3), None, None]
    df = spark.createDataFrame([("ars", "igm1", 2020, 5)], "network string, station string, year int, doy int")
    levels = ["network", "station", "year", "doy"]
    path = df.select(F.concat(archive.archive_path(levels, {k: F.col(k) for k in levels}), F.lit("/f.Z")).alias("p"))
    assert path.first()["p"] == "ars/igm1/2020/005/f.Z"
    assert tuple(path.select(archive.path_keys(F.col("p"), levels).alias("k")).first()["k"]) == ("ars", "igm1", "2020", "005")
    assert spark.createDataFrame([("a/igm12/2020/005/f.Z",)], "p string").select(archive.path_keys(F.col("p"), levels).alias("k")).first()["k"] is None


def test_inspection(spark):
    j = lambda i, n, a, b: f'{{"data":{{"epoch":{{"interval":{i},"number":{n},"number_extra":0,"first":"{a}","last":"{b}"}}}}}}'
    data = [j(30, 2880, "2020-01-01T00:00:00", "2020-01-01T23:59:30"), j(0, 9, "2020-01-01T00:00:00", "2020-01-01T10:00:00"), j(300, 9, "2020-01-01T00:00:00", "2020-01-01T10:00:00"), j(30, 9, "2020-01-01T10:00:00", "2020-01-01T00:00:00"), j(30, 9, "2020-01-01T00:00:00", "2020-01-01T00:10:00"), "not json", None]
    got = archive.inspected(spark.createDataFrame([(x,) for x in data], "v string"), "v").collect()
    assert [r["reason"] for r in got] == [None, "interval is zero", "interval over 120 s", "ends before it begins", "too short", "unreadable", "unreadable"]
    assert got[0]["completion"] == 1.0 and got[0]["relative_completion"] == 1.0


def test_epoch_operators(spark):
    e = spark.createDataFrame([("a", "one", T(2020, 1, 1, 0, 0, s), c) for s in range(0, 60, 5) for c in "GR"], "NetworkCode string, StationCode string, ts timestamp_ntz, system string")
    assert quality.decimate(e, 30).count() == 4 and quality.drop_systems(e, ["R"]).count() == 12
    assert quality.window_epochs(e, T(2020, 1, 1, 0, 0, 10), T(2020, 1, 1, 0, 0, 20)).count() == 6
    assert quality.splice(e.filter("system = 'G'"), e, ["ts", "system"]).count() == 24
    r = spark.range(1).select(quality.short_name(F.lit("IGM1"), F.lit(5), F.lit("0"), F.lit(2020)).alias("n")).first()
    assert r["n"] == "igm10050.20o"
    listing = spark.createDataFrame([("/r/igm10010.20d.Z",), ("/r/igm10090.20d.Z",), ("/r/other.txt",)], "path string")
    assert quality.newest_remote(spark.createDataFrame([("ars", "IGM1")], "NetworkCode string, StationCode string"), listing).first()["path"].endswith("0090.20d.Z")


def test_ingest_decisions(spark, files):
    table = spark.createDataFrame([("a", "one")], "NetworkCode string, StationCode string")
    cols = "path string, NetworkCode string, StationCode string, ObservationYear int, ObservationDOY int, Interval double, Completion double, reason string, lat double, height double"
    data = [("1", "a", "one", 2020, 9, 30.0, 1.0, None, 1.0, 5.0), ("2", "a", "one", 2020, 1, 30.0, 0.9, None, 1.0, 5.0), ("3", "x", "new", 2020, 9, 30.0, 1.0, None, 1.0, 5.0), ("4", None, None, None, None, None, None, None, None, None), ("5", "a", "one", 2020, 9, 30.0, 1.0, "too short", 1.0, 5.0), ("6", "a", "one", 2020, 9, 30.0, 1.0, None, None, None), ("7", "a", "one", 2020, 9, 30.0, 1.0, None, 1.0, 9900.0)]
    got = {r["path"]: r["status"] for r in quality.ingest(spark.createDataFrame(data, cols), files, table).collect()}
    assert got == {"1": "insert", "2": "duplicate", "3": "locked", "4": "reject", "5": "reject", "6": "retry", "7": "reject"}


def test_coherence(spark, stations):
    sol = spark.createDataFrame([("ars", "igm1", 2020, 1, -34.5, -58.4), ("ars", "igm1", 2020, 2, -34.9, -57.9), ("ars", "igm1", 2020, 3, 5.0, 5.0)], "NetworkCode string, StationCode string, Year int, DOY int, lat double, lon double")
    assert {r["DOY"]: r["verdict"] for r in joins.match_stations(sol, stations).collect()} == {1: "matched", 2: "renamed", 3: "none"}
    other = stations.filter("StationCode <> 'lpgs'")
    assert [r["StationCode"] for r in quality.missing_elsewhere(stations.filter("lat is not null"), other).collect()] == ["lpgs"]
