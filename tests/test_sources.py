import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftline.operators.selection import NothingFound
from driftline.sources import parsers, schema, sinks, store

T = dt.datetime


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_station_info_round_trip(spark, tmp_path):
    records = [
        ("igm1", "Instituto", T(2010, 2, 1), T(2012, 1, 1, 23, 59, 30), 0.1, "DHARP", 0.0, 0.0, "TRIMBLE NETR9", "4.60", "4.60", "5001", "TRM55971.00", "NONE", "77"),
        ("igm1", "Instituto", T(2012, 1, 2), None, 1.2345, "DHARP", 0.0, -0.5, "TRIMBLE NETR9", "4.60", "4.60", "5001", "TRM55971.00", "SCIT", "78"),
    ]
    names = ["StationCode", "StationName", "DateStart", "DateEnd", "AntennaHeight", "HeightCode", "AntennaNorth", "AntennaEast", "ReceiverCode", "ReceiverVers", "ReceiverFirmware", "ReceiverSerial", "AntennaCode", "RadomeCode", "AntennaSerial"]
    df = spark.createDataFrame(records, "StationCode string, StationName string, DateStart timestamp_ntz, DateEnd timestamp_ntz, AntennaHeight double, HeightCode string, AntennaNorth double, AntennaEast double, ReceiverCode string, ReceiverVers string, ReceiverFirmware string, ReceiverSerial string, AntennaCode string, RadomeCode string, AntennaSerial string")
    text = "*SITE header\n" + "\n".join(r["value"] for r in parsers.record_line(df).collect()) + "\n short\n"
    got = parsers.station_info(parsers.read(spark, put(tmp_path, "station.info", text)))
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(records)


SINEX = """%=SNX 1.00
+SITE/ID
*CODE PT __DOMES__ T
 TROM  A 82397M001 P , USA                   18 56 18.0  69 39 45.9   135.4
-SITE/ID
+SOLUTION/STATISTICS
 VARIANCE FACTOR                    0.048618461936712
 NUMBER OF OBSERVATIONS                     1200
 NUMBER OF UNKNOWNS                           33
-SOLUTION/STATISTICS
+SOLUTION/ESTIMATE
     1 STAX   TROM  A    1 05:180:43200 m    2 .210294051E+7 .2511266E-2
     2 STAY   TROM  A    1 05:180:43200 m    2 .721569384E+6 .2511266E-2
     3 STAZ   TROM  A    1 05:180:43200 m    2 .595819204E+7 .3511266E-2
     4 VELX   TROM  A    1 05:180:43200 m/y  2 -.15E-01 0.13E-03
     5 STAX   TROM  B    1 05:180:43200 m    2 .1E+7 .2E-2
-SOLUTION/ESTIMATE
+SOLUTION/MATRIX_ESTIMATE L COVA
*PARA1 PARA2
     1     1  0.1D-05
     2     1  0.2D-06  0.3D-05
-SOLUTION/MATRIX_ESTIMATE L COVA
"""


def test_sinex(spark, tmp_path):
    s = parsers.sinex(parsers.read(spark, put(tmp_path, "a.snx", SINEX)))
    assert [(r["site"], r["domes"]) for r in s["sites"].collect()] == [("TROM", "82397M001")]
    p = parsers.sinex_positions(s["estimates"]).first()
    assert (p["X"], p["Y"], p["Z"], p["sZ"], p["VX"]) == pytest.approx((2102940.51, 721569.384, 5958192.04, 0.003511266, -0.015))
    assert s["estimates"].count() == 4
    assert sorted((r["row"], r["column"], r["value"]) for r in s["covariance"].collect()) == [(1, 1, 1e-6), (2, 1, 2e-7), (2, 2, 3e-6)]
    assert tuple(s["statistics"].first())[1:] == (pytest.approx(0.048618461936712), 1200, 33)
    moved = spark.createDataFrame([("a", "X1", 0.0, 0.0, 0.0), ("b", "X1", 0.5, 0.0, 0.0), ("c", "X1", 50.0, 0.0, 0.0)], "path string, site string, X double, Y double, Z double")
    assert {r["path"]: r["level"] for r in parsers.merge_sites(moved).collect()} == {"a": 0, "b": 0, "c": 1}


LOG = """1. Site
3.1  Receiver Type            : TRIMBLE 4000
     Serial Number            : r1
     Firmware Version         : 1.0
     Date Installed           : 2000-01-01T00:00Z
     Date Removed             : 2005-01-01T00:00Z
3.2  Receiver Type            : TRIMBLE NETRS
     Serial Number            : r2
     Firmware Version         : 2.0
     Date Installed           : 2005-01-01T00:00Z
     Date Removed             : CCYY-MM-DDThh:mmZ
4.1  Antenna Type             : TRM29659.00     NONE
     Serial Number            : a1
     Marker->ARP Up Ecc. (m)  : 0.0500
     Antenna Radome Type      : NONE
     Date Installed           : 2000-01-01T00:00Z
     Date Removed             : 2003-06-01T00:00Z
4.2  Antenna Type             : ASH701945
     Serial Number            : a2
     Marker->ARP Up Ecc. (m)  : 0.0600
     Antenna Radome Type      : SCIS
     Date Installed           : 2003-06-01T00:00Z
     Date Removed             : CCYY-MM-DDThh:mmZ
5.1  Other
"""


def test_site_log_sessions(spark, tmp_path):
    got = parsers.site_log(parsers.read(spark, put(tmp_path, "x.log", LOG))).orderBy("DateStart").collect()
    assert [(r["ReceiverSerial"], r["AntennaSerial"], r["DateStart"], r["DateEnd"]) for r in got] == [
        ("r1", "a1", T(2000, 1, 1), T(2003, 6, 1)), ("r1", "a2", T(2003, 6, 1), T(2005, 1, 1)), ("r2", "a2", T(2005, 1, 1), None),
    ]
    assert got[1]["AntennaHeight"] == 0.06


def test_other_texts(spark, tmp_path):
    ppp = "X (m)  1.0  2297292.9100  0.0020\nY (m)  1.0  1016894.9400 0.0010\nZ (m)  1.0 -5843939.6200 0.0030\nNumber of epochs processed : 2870\n"
    bad = ppp.replace("1016894.9400", "**********").replace("-5843939.6200", "NaN")
    put(tmp_path, "a.sum", ppp)
    put(tmp_path, "b.sum", bad)
    got = {r["path"][-5:]: r for r in parsers.positioning_summary(parsers.read(spark, str(tmp_path / "*.sum"))).collect()}
    assert got["a.sum"]["ok"] and got["a.sum"]["Z"] == -5843939.62 and got["a.sum"]["n_processed"] == 2870
    assert not got["b.sum"]["ok"] and got["b.sum"]["X"] == 2297292.91 and got["b.sum"]["Y"] is None
    z = "head\nATM_ZEN X IGM1 02 2020 01 05 06 30 12 0.1234 +- 0.0056 2.3456\n"
    r = parsers.zenith_delays(parsers.read(spark, put(tmp_path, "z.znd", z))).first()
    assert (r["alias"], r["Date"], r["model"], r["sigma"], r["ZTD"]) == ("igm1", T(2020, 1, 5, 6, 30), 0.1234, 0.0056, 2.3456)
    a = parsers.antenna_names(parsers.read(spark, put(tmp_path, "a.atx", "                    START OF ANTENNA\nx START OF ANTENNA  TRM1.00 NONE\ny START OF ANTENNA ASH2 SCIS\n")))
    assert {x["AntennaCode"] for x in a.collect()} >= {"TRM1.00", "ASH2"}
    values = [1.0, 2.0, 3.0, 2010.5, 0.01, 0.02, 0.03, *[float(i) for i in range(12)]]
    c = parsers.constraints(parsers.read(spark, put(tmp_path, "c.txt", " ars.igm1 " + " ".join(f"{v:.4f}" for v in values) + "\n chi.aaaa " + " ".join(["NaN"] * 19) + "\n ars.bbbb 1.0\n")))
    rows = {r["station"]: r for r in c.collect()}
    assert set(rows) == {"ars.igm1", "chi.aaaa"} and rows["ars.igm1"]["u_cos_half"] == pytest.approx(0.011) and rows["chi.aaaa"]["x"] != rows["chi.aaaa"]["x"]
    log = "GamitTask initialized for proj.sub07: 2020 005\nexecuting on node3\nrun.sh (2020-01-05 01:00:00): Iteration depth: 1\nrun.sh (2020-01-05 01:30:00): Iteration depth: 2\nPrefit nrms:  0.1E+01    Postfit nrms: 0.2E+00\nfinish.sh (2020-01-05 02:00:00): Done processing h-files\n"
    r = parsers.run_logs(parsers.read(spark, put(tmp_path, "m.log", log))).first()
    assert (r["Project"], r["Year"], r["DOY"], r["node"], r["iterations"], r["nrms"], r["runtime"]) == ("proj", 2020, 5, "node3", 2, 0.2, 60)
    k = "<kml><Placemark><name>p1</name><Point><coordinates>-58.1,-34.2,10</coordinates></Point></Placemark><Placemark><name>line</name></Placemark></kml>"
    assert [(r["name"], r["lon"], r["lat"]) for r in parsers.placemarks(parsers.read(spark, put(tmp_path, "k.kml", k))).collect()] == [("p1", -58.1, -34.2)]
    s = parsers.station_list(parsers.read(spark, put(tmp_path, "s.txt", "# x\nARS.IGM1 1 2\n\nchi.aaaa\n")))
    assert [(r["station"], r["parameters"]) for r in s.collect()] == [("ars.igm1", ["1", "2"]), ("chi.aaaa", [])]


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "db"))
    assert st.read("networks").count() == 0
    df = spark.createDataFrame([("ars", "Argentina", 1), ("chi", "Chile", 2)], "NetworkCode string, NetworkName string, unknown int")
    st.insert("networks", df)
    with pytest.raises(store.DuplicateKey):
        st.insert("networks", df.limit(1))
    st.insert("networks", df.union(spark.createDataFrame([("uru", "Uruguay", 3)], df.schema)), skip_known=True)
    assert st.read("networks").count() == 3 and st.columns("networks") == ["NetworkCode", "NetworkName"]
    st.update("networks", {"NetworkName": "AR"}, NetworkCode="ars")
    assert st.get("networks", NetworkCode="ars").first()["NetworkName"] == "AR"
    st.delete("networks", NetworkCode="chi")
    with pytest.raises(NothingFound):
        st.get("networks", NetworkCode="chi")
    with pytest.raises(ValueError):
        st.delete("networks")
    assert st.sql("select count(*) n from networks", "networks").first()["n"] == 2
    assert schema.repeated_keys(df.union(df), "networks").count() == 2
    s = spark.createDataFrame([("xxx", "one")], "NetworkCode string, StationCode string")
    assert schema.dangling(s, "stations", {"networks": st.read("networks")})["networks"].count() == 1


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("ars", "igm1", 1.0, 2.0, 3.0, -58.1, -34.2, 10.0)], "NetworkCode string, StationCode string, auto_x double, auto_y double, auto_z double, lon double, lat double, height double")
    many = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(200)))).withColumn("StationCode", F.lpad(F.col("i").cast("string"), 4, "0"))
    assert [r["count"] for r in sinks.loading_requests(many).groupBy("file").count().orderBy("file").collect()] == [99, 99, 2]
    sinks.kml(sinks.placemark_lines(s, F.lit("x")), str(tmp_path / "k"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "k"), wholetext=True).collect())
    assert text.count("<Placemark>") == 1 and "-58.1,-34.2,10.0" in text
    d = spark.createDataFrame([("ars", "igm1", T(2020, 1, 5, 6, 30), 2.3456, 0.0056)], "NetworkCode string, StationCode string, Date timestamp_ntz, ZTD double, sigma double")
    assert sinks.delay_lines(d).first()["value"] == " IGM1 20:005:23400   2345.6   5.6"
    assert json.loads(sinks.as_json(s).first()["value"])["lat"] == -34.2
    lines = spark.createDataFrame([(x,) for x in SINEX.split("\n")], "line string")
    out = [r["line"] for r in sinks.edited_sinex(lines, 77, {"trom": "10302M003"}).collect()]
    assert any(x.startswith(" NUMBER OF UNKNOWNS") and x.endswith("77") for x in out) and any("10302M003" in x for x in out)
