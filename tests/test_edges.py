"""Nulls, repeated rows, wide rows and bounds of the network operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import alignment, archive, joins, selection, trajectory
from driftline.sources.store import Store

KEY = selection.KEY


def test_numbers_of_wide_rows_are_gapless(spark):
    """Wide rows in many ranges of uneven size, with adaptive execution on, and a value that a third of all rows share."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 300_000
        k = F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 100_000)
        wide = spark.range(n).select("id", k.alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("payload"))
        got = archive.numbered(wide, ["k"]).select("row", "k", "payload").agg(F.count("*"), F.min("row"), F.max("row"), F.count_distinct("row"), F.sum(F.length("payload"))).first()
        assert tuple(got) == (n, 1, n, n, n * 256)
        w = archive.numbered(wide, ["k"]).select("row", "k").toPandas().sort_values("row")
        assert (np.diff(w["k"].to_numpy()) >= 0).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_of_nothing(spark):
    assert archive.numbered(spark.createDataFrame([], "a int, row_ string"), ["a"]).count() == 0


def test_periods_need_data_in_every_quarter():
    """A yearly term takes gaps of up to a quarter of a year, a half-yearly one of up to an eighth."""
    def series(gap):
        return 2000 + np.concatenate([np.arange(0, 0.3, 0.01), np.arange(0.29 + gap, 1, 0.01)])

    for gap, allowed in ((0.24, 1), (0.26, 0), (0.12, 2), (0.13, 1)):
        assert len(trajectory.periods_allowed(series(gap))) == allowed, gap


def test_places_without_coordinates_are_near_nothing(spark):
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 20.0), (3, 10.0, None), (4, -80.0, 170.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([(1, 10.5, 20.0), (2, None, None), (3, 11.0, 21.0), (4, 75.0, -30.0)], "p int, lat double, lon double")
    got = {r["id"]: (r["r_p"], round(r["distance_km"])) for r in joins.nearest(points, places, ["id"]).collect()}
    assert set(got) == {1, 4} and got[1][0] == 1
    distance = {r["p"]: r["d"] for r in places.filter("lat is not null").withColumn("d", joins.geodesy.haversine_km(F.lit(170.0), F.lit(-80.0), F.col("lon"), F.col("lat"))).collect()}
    assert got[4] == (min(distance, key=distance.get), round(min(distance.values())))


def test_nearest_beyond_the_largest_radius(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(r.uniform(-89, -60)), float(r.uniform(-180, 180))) for i in range(40)]
    far = [(i, float(r.uniform(20, 89)), float(r.uniform(-180, 180))) for i in range(60)]
    points, places = (spark.createDataFrame(x, f"{c} int, lat double, lon double") for x, c in ((rows, "id"), (far, "p")))
    got = {x["id"]: x["distance_km"] for x in joins.nearest(points, places, ["id"]).collect()}

    def km(a, b):
        p, q = np.radians(a[1]), np.radians(b[1])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(h))

    assert len(got) == 40
    for a in rows:
        assert abs(got[a[0]] - min(km(a, b) for b in far)) < 1e-6


def test_equal_points_and_equal_days_stay(spark):
    t = datetime.datetime(2000, 1, 5)
    points = spark.createDataFrame([("n", "s", t)] * 3 + [("n", "s", datetime.datetime(1990, 1, 1))], "NetworkCode string, StationCode string, t timestamp_ntz")
    sessions = spark.createDataFrame([("n", "s", datetime.datetime(2000, 1, 1), None, 1), ("n", "s", datetime.datetime(2000, 1, 3), None, 2)], "NetworkCode string, StationCode string, DateStart timestamp_ntz, DateEnd timestamp_ntz, x int")
    assert [r["x"] for r in joins.valid_at(points, sessions, KEY, "t").collect()] == [1, 1, 1]
    frames = spark.createDataFrame([("A", datetime.date(1999, 1, 1), datetime.date(2000, 1, 1)), ("B", datetime.date(2000, 1, 1), None)], "frame string, start date, end date")
    days = spark.createDataFrame([(datetime.date(2000, 1, 1),)] * 2 + [(datetime.date(2001, 1, 1),), (datetime.date(1980, 1, 1),)], "date date")
    assert sorted((str(r["date"]), r["frame"] or "") for r in selection.frame_of_day(days, frames).collect()) == [("1980-01-01", ""), ("2000-01-01", "A"), ("2000-01-01", "A"), ("2001-01-01", "B")]


def test_overlaps_of_one_start_and_different_ends(spark):
    d = lambda n: datetime.datetime(2000, 1, n)
    rows = [("k", d(1), d(5), "a"), ("k", d(1), d(9), "b"), ("k", d(4), d(6), "c"), ("k", d(9), d(12), "d"), ("j", d(1), d(2), "e")]
    s = spark.createDataFrame(rows, "k string, DateStart timestamp_ntz, DateEnd timestamp_ntz, id string")
    got = {(r["id_a"], r["id_b"]): r["shared_s"] // 86400 for r in joins.overlaps(s, ["k"], carry=("id",)).collect()}
    assert got == {("a", "b"): 4, ("a", "c"): 1, ("b", "c"): 2}


def test_chain_is_the_running_product_of_all_stretches(spark, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 2)
    r = np.random.default_rng(3)
    x = r.normal(size=(8, 3))
    x = 6371e3 * x / np.linalg.norm(x, axis=1)[:, None]
    days = [(2019, 365), (2020, 1), (2020, 3), (2020, 4), (2020, 9), (2021, 2), (2021, 3)]
    rows = [("n", f"s{i}", y, d, *map(float, p)) for y, d in days for i, p in enumerate(x + r.normal(0, 1, 3)) if (y, d) != (2020, 9)]
    rows += [("n", "alone", 2020, 9, *map(float, x[0]))]  # a day without a station in common
    df = spark.createDataFrame(rows, "NetworkCode string, StationCode string, Year int, DOY int, X double, Y double, Z double")
    got = {(a["StationCode"], a["Year"], a["DOY"]): (a["X"], a["Y"], a["Z"]) for a in alignment.chain(df).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        for day in days[1:4]:  # aligned to the first day
            assert got[f"s{i}", *day] == pytest.approx(got[f"s{i}", 2019, 365], abs=0.02)
        assert got[f"s{i}", 2021, 2] == pytest.approx(got[f"s{i}", 2021, 3], abs=0.02)
    # day by day, in one loop
    target = spark.createDataFrame([(*a[:2], *b, *a[4:]) for a in rows for z, b in zip(days, days[1:]) if a[2:4] == z], df.schema)
    steps = {(h["Year"], h["DOY"]): h for h in alignment.helmert(df, target).collect()}
    turn, shift = np.eye(3), np.zeros(3)
    for day in days:
        if h := steps.get(day):
            a, b, c = (h[k] * 1e-9 for k in ("rx", "ry", "rz"))
            turn, shift = turn @ np.array([[1, c, -b], [-c, 1, a], [b, -a, 1]]), turn @ np.array([h["tx"], h["ty"], h["tz"]]) + shift
        for row in rows:
            if row[2:4] == day:
                assert got[row[1], *day] == pytest.approx(tuple(turn @ np.array(row[4:]) + shift), abs=1e-4)


def test_store_rows_with_null_keys_and_readers_of_one_version(spark, tmp_path):
    st = Store(spark, str(tmp_path / "db"))
    st.insert("networks", spark.createDataFrame([("a", "A"), (None, "B")], "NetworkCode string, NetworkName string"))
    before = st.read("networks")
    st.insert("networks", spark.createDataFrame([("c", "C")], "NetworkCode string, NetworkName string"))
    assert before.count() == 2 and st.read("networks").count() == 3
    st.delete("networks", NetworkName="B")
    assert sorted(a["NetworkCode"] for a in st.read("networks").collect()) == ["a", "c"]
    st.delete("networks", NetworkCode=None)
    assert st.read("networks").count() == 2
