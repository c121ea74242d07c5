import datetime as dt
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import arrays, calendar, geodesy, lsq, text


def one(spark, **columns):
    r = spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()
    return r.asDict()


def test_calendar(spark):
    days = ["2020-12-31", "2021-01-01", "2000-02-29", "1999-12-31", "1980-01-06", "2024-03-10"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "day date")
    for r in calendar.calendar_columns(df, "day").collect():
        d = r["day"]
        n = (d - dt.date(1980, 1, 6)).days
        assert (r["year"], r["doy"]) == (d.year, d.timetuple().tm_yday)
        assert (r["gps_week"], r["gps_day"]) == (n // 7, n % 7)
        assert r["mjd"] == (d - dt.date(1858, 11, 17)).days
        assert r["fyear"] == pytest.approx(d.year + (r["doy"] - 0.5) / (366 if d.year % 4 == 0 else 365), abs=1e-6)
    back = df.select(calendar.date_of(F.year("day"), F.dayofyear("day")).alias("b"), calendar.from_mjd(calendar.mjd(F.col("day"))).alias("m"), "day").collect()
    assert all(r["b"] == r["day"] == r["m"] for r in back)


def test_calendar_texts(spark):
    r = one(
        spark, a=calendar.parse_day(F.lit("2020/3/1")), b=calendar.parse_day(F.lit("2020_061")), c=calendar.parse_day(F.lit("0001-2")), d=calendar.parse_day(F.lit("2020.5")),
        e=calendar.parse_day(F.lit("nonsense")), f=calendar.session_instant(F.lit("2010 032 25 00 00")), g=calendar.session_instant(F.lit("9999 999 00 00 00")), h=calendar.from_fractional_year(F.lit(2021.5)),
    )
    assert r["a"] == r["b"] == dt.date(2020, 3, 1) and r["c"] == dt.date(1980, 1, 15) and r["d"] == dt.date(2020, 7, 2) and r["e"] is None
    assert r["f"] == dt.datetime(2010, 2, 1, 23, 59, 59) and r["g"] is None and r["h"] == dt.datetime(2021, 7, 2, 12)
    seg = calendar.segments(spark.sql("select date '2020-01-01' a, date '2020-02-01' b"), "a", "b").collect()
    assert len(seg) == 3 and seg[-1]["segment_end"] == dt.date(2020, 2, 1)


def test_geodesy(spark):
    x = [F.lit(v) for v in (2297292.91, 1016894.94, -5843939.62)]
    g = one(spark, g=geodesy.geodetic(*x))["g"]
    assert (g["lat"], g["lon"], g["height"]) == pytest.approx((-66.8765400174, 23.876539914, 999.998386689), abs=1e-6)
    back = one(spark, c=geodesy.earth_centred(*[F.lit(g[k]) for k in ("lat", "lon", "height")]))["c"]
    assert (back["x"], back["y"], back["z"]) == pytest.approx((2297292.91, 1016894.94, -5843939.62), abs=1e-3)
    v = one(spark, n=geodesy.to_neu(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(-30.0), F.lit(70.0)))["n"]
    w = one(spark, n=geodesy.from_neu(*[F.lit(v[k]) for k in "neu"], F.lit(-30.0), F.lit(70.0)))["n"]
    assert tuple(w) == pytest.approx((1, 2, 3)) and math.hypot(*v) == pytest.approx(14**0.5)
    r = one(
        spark, d=geodesy.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)), b=geodesy.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)),
        p=geodesy.azimuthal(F.lit(-33.0), F.lit(-70.0), F.lit(-30.0), F.lit(-72.0)), s=geodesy.spherical(F.lit(0.0), F.lit(2.0), F.lit(2.0)), h=geodesy.vertical_height(F.lit(5.0), F.lit(3.0), F.lit(1.0)),
        q=geodesy.event_score(F.lit(8.8), F.lit(50.0)), f=geodesy.fault_size(F.lit(7.0)),
    )
    assert r["d"] == pytest.approx(6371 * math.pi / 2) and r["b"] == pytest.approx(270) and tuple(r["s"]) == pytest.approx((45, 90, 8**0.5)) and r["h"] == 3
    q = one(spark, q=geodesy.from_azimuthal(F.lit(r["p"]["x"]), F.lit(r["p"]["y"]), F.lit(-30.0), F.lit(-72.0)))["q"]
    assert tuple(q) == pytest.approx((-33, -70)) and r["q"] > 0 and r["f"]["along_strike_m"] == pytest.approx(10 ** (-3.22 + 0.69 * 7) * 1000)


def test_text(spark):
    for value in ("abc", "net.stnm", "x" * 99):
        c = zlib.crc32(value.encode())
        assert one(spark, c=text.signed_crc32(F.lit(value)))["c"] == c - ((c & 0x80000000) << 1)
    assert one(spark, a=text.similar_to(F.lit("igm1"), "ig%"), b=text.similar_to(F.lit("igm1"), "i_m[12]"), c=text.similar_to(F.lit("xigm1"), "ig%"), d=text.similar_to(F.lit("lpgs"), "(ab|lp)%"), e=text.similar_to(F.lit("a.b"), "a.b"), f=text.similar_to(F.lit("axb"), "a.b")) == dict(a=True, b=True, c=False, d=True, e=True, f=False)
    r = one(spark, w=text.wrapped(F.lit("aa bb cccc d"), 5), s=text.session_letter(F.lit(11)), h=text.host(F.lit("a.b:22")), y=text.full_year(F.lit(80)), z=text.full_year(F.lit(79)), t=text.tagged_path(F.lit("/${year}/${doy}"), {"year": F.lit(2020), "doy": F.lit("003")}), b=text.between(F.lit("x[mid]y"), "[", "]"), k=text.year_key(F.lit(2020), F.lit(7)))
    assert r["w"] == ["aa bb", "cccc", "d"] and r["s"] == "a" and tuple(r["h"]) == ("a.b", 22) and (r["y"], r["z"]) == (1980, 2079) and r["t"] == "/2020/003" and r["b"] == "mid" and r["k"] == "2020 007"


def test_arrays(spark):
    r = one(spark, t=arrays.term(F.array(*map(F.lit, range(6))), 1, 2, 3), c=arrays.by_component(F.array(*map(F.lit, range(6))), 3), n=arrays.array_length(F.array()), m=arrays.array_length(F.array(F.lit(1))))
    assert r == {"t": 5, "c": [[0, 1, 2], [3, 4, 5]], "n": None, "m": 1}
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "k int, s array<string>, a array<string>")
    assert sorted(map(tuple, arrays.zipped(df, "s", "a").collect())) == [(1, "a", "x"), (1, "b", "y")]


def test_chi_square_quantiles():
    assert lsq.chi2_quantile(0.975, 10) == pytest.approx(20.483177, abs=1e-5)
    assert lsq.chi2_quantile(0.025, 10) == pytest.approx(3.246973, abs=1e-5)
    assert lsq.chi2_quantile(0.975, 1) == pytest.approx(5.0238862, abs=1e-5)


def test_robust_fit_leaves_outliers_aside():
    r = np.random.default_rng(1)
    x = np.linspace(0, 1, 400)
    y = 3 + 2 * x + r.normal(0, 0.002, 400)
    y[::50] += 0.5
    f = lsq.robust_fit(np.column_stack([np.ones(400), x]), y)
    assert f.coefficients == pytest.approx([3, 2], abs=2e-3) and not f.used[::50].any() and f.used.sum() > 370


def test_small_matrices():
    m = lsq.nearest_positive(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.linalg.eigvalsh(m).min() > 0
    c = lsq.rotate_covariance(np.diag([1.0, 2.0, 3.0]), 10.0, 20.0)
    assert np.trace(c) == pytest.approx(6) and np.linalg.eigvalsh(c) == pytest.approx([1, 2, 3])
    x = np.column_stack([np.linspace(0, 0.01, 60), np.r_[np.zeros(30), np.ones(30)]])
    assert len(set(lsq.density_clusters(x, 0.0028, 5))) == 2
