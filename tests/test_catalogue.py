"""Each registered relational query against its oracle at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftline.functions.lsq import robust_fit
from driftline.plans import catalogue, fit_catalogue, station_catalogue, stream_catalogue, text_catalogue  # noqa: F401 (these register their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (float, np.floating)) and float(x).is_integer():
        return str(int(x))
    return str(x)


def rows(df):
    columns = sorted(df.columns)
    return sorted("|".join(normal(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_trend(spark):
    got = catalogue.QUERIES["gap_trend_flagship"](spark, SF).toPandas().set_index("user_id")
    d = catalogue.daily(spark, SF).toPandas().sort_values("t")
    for user, own in list(d.groupby("user_id"))[:20]:
        if own["t"].nunique() >= 3:
            f = robust_fit(np.column_stack([np.ones(len(own)), own["t"]]), own["v"].to_numpy(dtype=float))
            assert got.loc[user, "slope"] == pytest.approx(f.coefficients[1], abs=1e-9)


def test_signed_crc(spark):
    import zlib

    r = catalogue.QUERIES["crc_signed"](spark, SF).join(spark.read.parquet(f"{SF}/customer.parquet"), "c_custkey").collect()
    for x in r:
        c = zlib.crc32(x["c_name"].encode())
        assert x["crc"] == (c - 2**32 if c >= 2**31 else c)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def great_circle(lat, lon, other_lat, other_lon):
    a, o, b, q = (np.radians(x) for x in (lat, lon, other_lat, other_lon))
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((q - o) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def test_whole_tables_in_spatial_roles(spark, duck):
    stations = duck.sql("select c_custkey k, (c_custkey * 37 % 1200) / 10.0 - 60 lat, (c_custkey * 91 % 3599) / 10.0 - 179.9 lon from customer").fetchall()
    sites = duck.sql("select s_suppkey k, (s_suppkey * 53 % 1200) / 10.0 - 60 lat, (s_suppkey * 71 % 3599) / 10.0 - 179.9 lon from supplier").fetchall()
    d = {(i, j): float(great_circle(float(a), float(o), float(b), float(q))) for i, a, o in stations for j, b, q in sites}
    near = {r["id"]: r["distance_km"] for r in catalogue.QUERIES["nearest_site"](spark, SF).collect()}
    assert near == pytest.approx({i: min(d[i, j] for j, *_ in sites) for i, *_ in stations}, abs=2e-4)
    scores = {(i, j): 0.5261 * (5 + j % 40 / 10.0) - np.log10(max(x, 1e-3)) - 1.1478 for (i, j), x in d.items()}
    got = {(r["id"], r["event_id"]): r["score"] for r in catalogue.QUERIES["site_score"](spark, SF).collect()}
    assert got == pytest.approx({k: s for k, s in scores.items() if s + np.log10(1.5) > 0.00001}, abs=2e-5)


def test_nearest_other_place_beyond_5000_km(spark):
    from driftline.operators import joins

    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 100.0)], "id long, lat double, lon double")
    far = joins.nearest(p, p, ["id"], only=lambda point, place: point("id") != place("id")).collect()
    assert {r["id"]: r["r_id"] for r in far} == {1: 2, 2: 1} and far[0]["distance_km"] > 11000


def test_nearest_permitted_place_lies_behind_refused_ones(spark):
    from driftline.operators import joins

    point = spark.createDataFrame([(1, 0.0, 0.0, "n1")], "id long, lat double, lon double, net string")
    places = spark.createDataFrame([(2, 0.0, 50.0, "n2"), (3, 0.0, 120.0, "n1"), (4, 0.0, 0.1, "n2"), (5, 0.1, -170.0, "n1")], "id long, lat double, lon double, net string")
    for how in ({"only": "net = r_net"}, {"same": ("net",)}):
        (row,) = joins.nearest(point, places, ["id"], **how).collect()
        assert row["r_id"] == 3 and row["distance_km"] == pytest.approx(np.radians(120) * 6371)
    assert joins.nearest(point, places, ["id"], only="r_net = 'n3'").count() == 0
    with pytest.raises(TypeError):
        joins.nearest(point, places, ["id"], only=point["net"] == catalogue.F.col("r_net"))


def test_nearest_and_within_on_the_whole_globe(spark):
    """Poles, the date line and refused places, against all pairs."""
    from driftline.operators import joins

    r = np.random.default_rng(6)
    at = lambda n: [(i, float(lat), float(lon), int(r.integers(3))) for i, (lat, lon) in enumerate(zip(np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)))]
    points, places = at(150) + [(500, 90.0, 0.0, 0), (501, -90.0, 77.0, 1), (502, 88.3, 179.9, 0), (503, 0.0, -180.0, 1)], at(200) + [(700, 88.25, -120.0, 1), (701, 89.0, 10.0, 1), (702, 0.0, 180.0, 2)]
    schema = "id long, lat double, lon double, kind int"
    p, q = spark.createDataFrame(points, schema), spark.createDataFrame(places, schema)
    d = np.array([[great_circle(a[1], a[2], b[1], b[2]) for b in places] for a in points])
    refused = np.array([[a[3] >= b[3] for b in places] for a in points])
    want = {a[0]: row.min() for a, row in zip(points, np.where(refused, np.inf, d)) if np.isfinite(row.min())}
    got = {x["id"]: x["distance_km"] for x in joins.nearest(p, q, ["id"], only="kind < r_kind").collect()}
    assert got == pytest.approx(want, abs=1e-5)
    for km in (210.0, 1500.0, 9000.0):
        pairs = {(x["id"], x["r_id"]) for x in joins.within_km(p, q, km).collect()}
        assert pairs == {(a[0], b[0]) for a, row in zip(points, d) for b, x in zip(places, row) if x <= km}
