import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import archive, seismic
from driftline.plans import commands
from driftline.sources.store import Store

KEY = "NetworkCode string, StationCode string"


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    st = Store(spark, str(tmp_path_factory.mktemp("db")))
    r = np.random.default_rng(1)
    x = r.normal(size=(6, 3))
    x = 6371e3 * x / np.linalg.norm(x, axis=1)[:, None]
    names = [f"s{i:03d}" for i in range(6)]
    st.insert("stations", spark.createDataFrame([("n", k, *map(float, p), float(i), float(i) * 10, 5.0) for i, (k, p) in enumerate(zip(names, x))], f"{KEY}, auto_x double, auto_y double, auto_z double, lat double, lon double, height double"))
    t = [(2018 + i // 365, 1 + i % 365) for i in range(0, 1095)]
    v = np.cross(np.array([-1.2e-9, 0.5e-9, 2.1e-9]), x)
    sol = [("n", k, y, d, "igs", *map(float, x[i] + v[i] * (y - 2018 + d / 365.25) + r.normal(0, 0.002, 3))) for y, d in t for i, k in enumerate(names)]
    cols = f"{KEY}, Year int, DOY int, ReferenceFrame string, X double, Y double, Z double"
    df = spark.createDataFrame(sol, cols)
    st.insert("ppp_soln", df)
    st.insert("gamit_soln", df.withColumn("Project", F.lit("p")))
    files = [("n", k, y, d, 30.0, 1.0, dt.datetime(y, 1, 1) + dt.timedelta(d - 1), dt.datetime(y, 1, 1) + dt.timedelta(d - 1, 86370), float(y)) for y, d in t[:40] for k in names]
    st.insert("rinex", spark.createDataFrame(files, f"{KEY}, ObservationYear int, ObservationDOY int, Interval double, Completion double, ObservationSTime timestamp_ntz, ObservationETime timestamp_ntz, ObservationFYear double"))
    info = [("n", k, dt.datetime(2017, 1, 1), dt.datetime(2019, 1, 1), "a1") for k in names] + [("n", "s000", dt.datetime(2019, 1, 1, 0, 0, 1), None, "a2")]
    st.insert("stationinfo", spark.createDataFrame(info, f"{KEY}, DateStart timestamp_ntz, DateEnd timestamp_ntz, AntennaCode string"))
    st.insert("antennas", spark.createDataFrame([("a1",)], "AntennaCode string"))
    st.insert("earthquakes", spark.createDataFrame([("q1", dt.datetime(2019, 6, 1), 2.0, 20.0, 7.5, 10.0)], "id string, date timestamp_ntz, lat double, lon double, mag double, depth double"))
    return st


def test_fits_and_queries(spark, filled):
    jumps = commands.station_jumps(filled).collect()
    assert {(j["StationCode"], j["kind"]) for j in jumps} >= {("s000", "step"), ("s002", "both")}
    dates = spark.createDataFrame([("n", "s005", 2030.0)], f"{KEY}, t double")
    out = commands.query_positions(filled, dates)
    assert out["velocity"].count() == 6 and out["positions"].first()["source"] == "modelled"


def test_networks(filled):
    d = commands.repeatability(filled, "p").collect()
    assert len(d) == 18 and all(r["wrms"] < 0.01 for r in d)
    assert commands.stack(filled, "p", "none", passes=1).count() == 6 * 1095
    pole = commands.plate(filled, "p", (-90, 90), (-180, 360)) if filled.read("stations").filter("DateEnd is not null").count() else None
    assert pole is None
    plan = commands.plan(filled, (2018, 1), (2018, 3))
    assert plan["times"].count() == 3 and plan["missing"].count() == 0


def test_plate(filled):
    commands.time_spans(filled)
    table = filled.read("stations")
    filled.replace("stations", table.withColumns({"DateStart": F.lit(2010), "DateEnd": F.lit(2020)}))
    pole = commands.plate(filled, "p", (-90, 90), (-180, 360))
    assert pole["n"] < 6 and pole["wz"] == pytest.approx(2.1e-9, rel=0.05)


def test_reports(spark, filled):
    r = commands.integrity(filled)
    assert {x["fault"] for x in r["equipment"].collect()} == {"unknown antenna"} and r["gaps"].count() == 0
    assert r["files_per_day"].count() == 40 and r["completeness"].first()["percent"] > 100
    assert commands.pending_positions(filled).count() == 0 and commands.close_sessions(filled).count() == 1
    assert "s002" in {x["StationCode"] for x in commands.affected_stations(filled, "q1").collect()}
    got = spark.createDataFrame([("q1", 1.0), ("q2", 6.0)], "id string, mag double").withColumns({"date": F.lit("2020-01-01").cast("timestamp_ntz"), "lat": F.lit(0.0), "lon": F.col("mag")})
    assert [x["id"] for x in commands.extend_catalogue(filled, got).collect()] in (["q2"], [])
    assert filled.read("earthquakes").count() == 2
    c = spark.createDataFrame([("n", "s001", "jump", 2019, 5, "+"), ("n", "s001", "jump", None, None, "+"), ("n", "s001", "magic", 2019, 5, "+")], f"{KEY}, object string, Year int, DOY int, action string")
    full = filled.conformed("etm_params", c)
    assert commands.override_model(filled, full).count() == 2 and filled.read("etm_params").count() == 1


def test_small_additions(spark, filled):
    files = filled.read("rinex")
    assert archive.records(files, StationCode="s001").count() == 40 and archive.records(files, Interval=15.0).count() == 0
    k = spark.createDataFrame([("NET", "network"), ("STN", "station")], "KeyCode string, rinex_col_in string")
    assert archive.path_levels(spark.createDataFrame([(2, "STN"), (1, "NET")], "Level int, KeyCode string"), k) == ["network", "station"]
    p = spark.createDataFrame([(1, 0.0, 0.5)], "id int, lat double, lon double")
    v = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 3.0)], "lat double, lon double, v double")
    assert seismic.interpolated(p, v, ["id"], ["v"]).first()["v"] == pytest.approx(2.0)
    assert set(commands.COMMANDS) >= {"fit", "stack", "plan", "integrity", "downloads"}


def test_changes_of_stations_days_and_files(spark, tmp_path):
    st = Store(spark, str(tmp_path / "db"))
    day = f"{KEY}, Year int, DOY int"
    st.insert("ppp_soln", spark.createDataFrame([("n", k, 2020, d, "igs") for k in ("a", "b") for d in (1, 2, 3)], f"{day}, ReferenceFrame string"))
    files = f"{KEY}, ObservationYear int, ObservationDOY int, Interval double, Completion double"
    st.insert("rinex", spark.createDataFrame([("n", k, 2020, d, 30.0, 1.0) for k in ("a", "b") for d in (1, 2)], files))
    commands.exclude(st, spark.createDataFrame([("n", "a", 2020, 3)], day))
    assert st.read("ppp_soln").count() == 5 and st.read("ppp_soln_excl").count() == 1
    gone = commands.drop_files(st, spark.createDataFrame([("n", "a", 2020, 1, 30.0, 1.0)], files))
    left = {(r["StationCode"], r["DOY"]) for r in st.read("ppp_soln").collect()}
    assert st.read("rinex").count() == 3 and ("a", 1) not in left and ("a", 2) in left
    assert ("a", 1) in {(r["StationCode"], r["DOY"]) for r in gone.collect()}
    commands.rename_station(st, ("n", "a"), ("m", "a"))
    for name in ("ppp_soln", "rinex", "ppp_soln_excl"):
        assert {r["NetworkCode"] for r in st.read(name).filter("StationCode = 'a'").collect()} == {"m"}, name
    info = f"{KEY}, DateStart timestamp_ntz, DateEnd timestamp_ntz, AntennaCode string"
    first, clash = ("n", "b", dt.datetime(2017, 1, 1), dt.datetime(2019, 1, 1), "a1"), ("n", "b", dt.datetime(2018, 1, 1), None, "a2")
    assert commands.add_sessions(st, spark.createDataFrame([first], info)).count() == 0
    assert commands.add_sessions(st, spark.createDataFrame([clash], info)).count() == 1 and st.read("stationinfo").count() == 1


def test_texts_and_statistics_of_a_project(spark, tmp_path):
    st = Store(spark, str(tmp_path / "db"))
    runs = "Project string, subnet int, Year int, DOY int, system string, cluster_size int, nrms double, WL double, NL double, runtime int"
    st.insert("gamit_stats", spark.createDataFrame([("p", i, 2020, 1, "G", 20 + i, 0.2, 90.0 + i, 80.0, 10 * i) for i in (1, 2)], runs))
    r = commands.run_statistics(st, "p").first()
    assert (r["runs"], r["stations"], r["WL"], r["longest"]) == (2, 43, 91.5, 20)
    st.insert("gamit_ztd", spark.createDataFrame([("n", "abcd", dt.datetime(2020, 1, 1), "p", 2020, 1, 0.001, 2.3)], f"{KEY}, Date timestamp_ntz, Project string, Year int, DOY int, sigma double, ZTD double"))
    assert commands.delays(st, "p").first()["file"] == "abcd" and commands.delays(st, "q").count() == 0
    st.insert("gamit_subnets", spark.createDataFrame([("p", 0, 2020, 1, ["n.abcd"], ["x001"])], "Project string, subnet int, Year int, DOY int, stations array<string>, alias array<string>"))
    residuals = spark.createDataFrame([("n", "abcd", 2020, 1, 0.01)], f"{KEY}, Year int, DOY int, residual double")
    assert [x["use"] for x in commands.weekly_combination(st, "p", residuals, 0.05).collect()] == [True]


def test_stations_are_packed_mapped_compared_edited_and_removed(spark, tmp_path):
    from driftline.operators.selection import NothingFound

    one, two = (Store(spark, str(tmp_path / k)) for k in ("one", "two"))
    place = f"{KEY}, lat double, lon double, height double"
    one.insert("stations", spark.createDataFrame([("n", "a", 1.0, 2.0, 5.0), ("m", "a", 10.0, 20.0, None), ("n", "c", None, None, None)], place))
    info = f"{KEY}, DateStart timestamp_ntz, DateEnd timestamp_ntz, AntennaCode string"
    one.insert("stationinfo", spark.createDataFrame([("n", "a", dt.datetime(2017, 1, 1), dt.datetime(2018, 1, 1), "a1"), ("n", "a", dt.datetime(2019, 1, 1), None, "a9")], info))
    one.insert("antennas", spark.createDataFrame([("a1",)], "AntennaCode string"))
    files = f"{KEY}, ObservationYear int, ObservationDOY int, Interval double, Completion double, ObservationSTime timestamp_ntz, ObservationETime timestamp_ntz"
    one.insert("rinex", spark.createDataFrame([("n", "a", 2017, d, 30.0, 1.0, dt.datetime(2017, 1, d), dt.datetime(2017, 1, d, 23)) for d in (1, 2)], files))
    one.insert("ppp_soln", spark.createDataFrame([("n", "a", 2017, 1, "igs")], f"{KEY}, Year int, DOY int, ReferenceFrame string"))

    marks = {r["value"].split("<name>")[1].split("<")[0]: r["value"] for r in commands.station_map(one).collect()}
    assert set(marks) == {"n.a", "m.a"} and "2 files, 50.0 % solved; faults: unknown antenna" in marks["n.a"] and "0 files, 0.0 % solved; faults: none" in marks["m.a"]
    listed = spark.createDataFrame([(1930, 0)], "gps_week int, gps_day int")
    assert [str(r["day"]) for r in commands.orbits_wanted(one, listed).collect()] == ["2017-01-02"]

    texts = commands.export_stations(one).select(F.sha1("value").alias("path"), F.col("value").alias("text"))
    two.insert("stations", spark.createDataFrame([("x", "a", 50.0, 50.0, 0.0)], place))
    assert {(r["NetworkCode"], r["StationCode"]) for r in commands.compare(one, two).collect()} == {("n", "c")}
    for _ in range(2):
        commands.import_stations(two, texts.union(spark.createDataFrame([("bad", "no json")], texts.schema)))
        assert two.read("stations").count() == 4
        assert sorted(map(repr, two.read("stationinfo").collect())) == sorted(map(repr, one.read("stationinfo").collect()))
    assert {r["NetworkCode"] for r in commands.adopt_aliases(two).collect()} == {"n", "x"}
    assert two.read("stations").filter("alias is not null").count() == 2 and commands.adopt_aliases(two).count() == 0

    commands.edit_session(one, ("n", "a"), dt.datetime(2019, 1, 1), AntennaCode="a1")
    assert {r["AntennaCode"] for r in one.read("stationinfo").collect()} == {"a1"}
    with pytest.raises(ValueError):
        commands.edit_session(one, ("n", "a"), dt.datetime(2017, 1, 1), DateEnd=dt.datetime(2019, 6, 1), AntennaCode="a2")
    with pytest.raises(NothingFound):
        commands.edit_session(one, ("n", "a"), dt.datetime(2016, 1, 1), AntennaCode="a1")
    assert one.read("stationinfo").count() == 2
    assert commands.remove_station(one, ("n", "a")) == ["ppp_soln", "rinex", "stationinfo", "stations"]
    assert one.read("rinex").count() == 0 and one.read("stations").count() == 2


def test_a_change_of_several_tables_is_whole_or_nothing(spark, tmp_path):
    st = Store(spark, str(tmp_path / "db"))
    st.insert("networks", spark.createDataFrame([("a", "A")], "NetworkCode string, NetworkName string"))
    st.insert("antennas", spark.createDataFrame([("a1",)], "AntennaCode string"))
    bad = st.read("antennas").withColumn("AntennaCode", F.expr("raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        st.replace_all({"networks": st.read("networks").limit(0), "antennas": bad})
    assert st.read("networks").count() == 1 and st.read("antennas").count() == 1
    st.replace_all({"networks": st.read("networks").limit(0), "antennas": st.read("antennas").limit(0)})
    assert st.read("networks").count() == 0 and st.read("antennas").count() == 0
