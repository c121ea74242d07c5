"""What makes queries fit large tables: what moves between tasks, and what the driver has to hold."""

import datetime
import math

from pyspark.sql import functions as F

from driftline.operators import joins, network, quality, seismic
from driftline.plans import text_catalogue
from driftline.sources import parsers
from driftline.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def moved_after(df, made, key):
    """Whether rows with a key that a step makes are dealt out by it: the step stands deeper in the plan than an exchange."""
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    steps = [deep(line) for line in plan(df) if made in line and key in line.split(made)[1]]
    dealt = [deep(line) for line in plan(df) if f"hashpartitioning({key}" in line]
    assert steps and dealt
    return any(m > e for m in steps for e in dealt)


def test_download_queue_moves_no_station_days(spark):
    day, at = datetime.date, datetime.datetime
    key = "NetworkCode string, StationCode string"
    table = spark.createDataFrame([("n", "a"), ("n", "b")], key)
    days = spark.createDataFrame([(day(2020, 1, d),) for d in (1, 2, 3, 5, 9)] + [(None,)], "day date")
    files = spark.createDataFrame([("n", "a", 2020, 2, 0.9), ("n", "a", 2020, 3, 0.1)], f"{key}, ObservationYear int, ObservationDOY int, Completion double")
    records = [("n", "a", at(2020, 1, 1, 5), at(2020, 1, 3)), ("n", "a", at(2020, 1, 2), at(2020, 1, 5, 7)), ("n", "b", at(2020, 1, 6), None), ("n", "c", at(2020, 1, 1), None)]
    sessions = spark.createDataFrame(records, f"{key}, DateStart timestamp_ntz, DateEnd timestamp_ntz")
    sources = spark.createDataFrame([("n", s, k, 10 + k) for s in "ab" for k in (1, 2)], f"{key}, try_order int, server_id int")
    queue = quality.download_queue(table, days, files, sessions, sources)
    got = {(r["StationCode"], r["day"].day, r["try_order"]) for r in queue.collect()}
    assert got == {(s, d, k) for s, d in (("a", 1), ("a", 3), ("a", 5), ("b", 9)) for k in (1, 2)}
    assert not moved_after(queue, "Generate explode", "NetworkCode")


def test_missing_days_move_no_station_days(spark):
    key = "NetworkCode string, StationCode string, Year int, DOY int"
    active = spark.createDataFrame([("n", "a", 2019, 364), ("n", "a", 2020, 3), ("n", "b", 2020, 2), ("n", "c", None, 1)], key)
    days = spark.createDataFrame([(2019, 365), (2020, 1), (2020, 1), (2020, 3), (2020, 4), (2019, 1), (None, 2), (2019, 366)], "Year int, DOY int")
    found = network.missing_station_days(active, days)
    assert found.schema.simpleString() == "struct<NetworkCode:string,StationCode:string,Year:int,DOY:int>"
    # day 366 of 2019 is the first of 2020, and a day of its own
    assert {(r["StationCode"], r["Year"], r["DOY"]) for r in found.collect()} == {("a", 2019, 365), ("a", 2020, 1), ("a", 2019, 366)}
    assert not moved_after(found, "Generate explode", "NetworkCode")


def spots(spark, n, name="id"):
    return spark.range(n).selectExpr(f"id as {name}", "id * 37 % 120 - 60D as lat", "id * 91 % 359 - 179D as lon", "cast(id % 4 as string) as kind")


def test_cells_are_never_gathered_in_the_driver(spark):
    """Tables far under the size that the planner broadcasts, whose rows at scale are not small."""
    p = spots(spark, 50)
    near = joins.within_km(p, p, 2000.0, only="id < r_id")
    events = spots(spark, 20, "event_id").withColumn("mag", F.lit(7.0))
    for found in (near, seismic.affected(p, events), joins.searched(p, joins.with_prefix(p), ["id"], 500.0, (3.0,), "lat", "lon", F.lit(True), ())):
        assert not any("Broadcast" in line for line in plan(found))
    every = {(a["id"], b["id"]) for a in p.collect() for b in p.collect() if a["id"] < b["id"] and apart(a, b) <= 2000}
    assert {(r["id"], r["r_id"]) for r in near.collect()} == every and every


def shuffled(spark, df):
    """Bytes that df writes for its shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def globe(spark, n, name="id"):
    return spark.range(n).selectExpr(f"id as {name}", "id * 37 % 1200 / 10D - 60 as lat", "id * 91 % 3599 / 10D - 179.9 as lon")


def test_places_within_km_come_to_few_cells(spark):
    p = globe(spark, 20_000)
    bytes_ = shuffled(spark, joins.within_km(p, p, 420.05, only="id < r_id"))
    assert bytes_ < 220 * 20_000


def test_events_come_to_few_cells(spark):
    p = globe(spark, 5_000)
    events = globe(spark, 2_000, "event_id").withColumn("mag", 5 + F.col("event_id") % 40 / 10)
    bytes_ = shuffled(spark, seismic.affected(p, events))
    assert bytes_ < 800 * 2_000


def apart(a, b):
    p, q, d = math.radians(a["lat"]), math.radians(b["lat"]), math.radians(b["lon"] - a["lon"])
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2)))


def test_places_of_a_later_kind(spark):
    """Points of the last kind have no place: they are not looked for over the globe."""
    p = spots(spark, 60)
    rows = p.collect()
    want = {a["id"]: min(apart(a, b) for b in rows if b["kind"] > a["kind"]) for a in rows if a["kind"] < "3"}
    found = joins.nearest(p, p, ["id"], start_km=5000.0, later="kind")
    assert {c for c in found.columns} == {*p.columns, *[f"r_{c}" for c in p.columns], "distance_km"}
    got = {r["id"]: r["distance_km"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_lines_of_solutions_are_not_shuffled(spark):
    """Solutions are dealt out by file before they become lines; a line knows its section without its file's other lines."""
    s = text_catalogue.solution_files(spark, SF)
    for read in (parsers.sinex(s)["covariance"], parsers.sinex(s)["statistics"]):
        assert sum("Exchange hashpartitioning" in line for line in plan(read)) == 1


def test_sections_of_odd_texts(spark):
    text = "%=SNX\n s0\n+A/B\n*CODE\n one\r\n- 2\n two\n-A/B\n lost\n+ X\n three\n+C\n-C\n four\n-D/\n five"
    got = [(r["section"], r["line"]) for r in parsers.sections(spark.createDataFrame([("f", text), ("g", "+Q\n"), ("h", None), ("i", "")], "path string, text string")).filter("path = 'f'").collect()]
    assert got == [("A/B", " one"), ("A/B", " two"), ("", " three"), ("C", " four")]


def test_sites_are_merged_without_a_call_for_each(spark):
    rows = [(f"p{i}", f"m{k}", float(x), 0.0, 0.0) for k in range(40) for i, x in enumerate((0, 0.5, 100, 1.4, 100.2, 50))] + [("p9", None, None, 0.0, 0.0), ("p8", None, 1.0, 0.0, 0.0)]
    found = parsers.merge_sites(spark.createDataFrame(rows, "path string, site string, X double, Y double, Z double"))
    assert any("MapInPandas" in line for line in plan(found))
    got = {(r["site"], r["path"]): r["level"] for r in found.collect()}
    assert len(got) == 242 and all([got[f"m{k}", f"p{i}"] for i in range(6)] == [0, 0, 1, 2, 1, 3] for k in range(40))
    assert (got[None, "p8"], got[None, "p9"]) == (0, 1)


def test_stations_share_states_of_gaps(spark, tmp_path):
    """A state and a call for each of many stations would cost more than their days."""
    stream = spark.readStream.schema("NetworkCode string, StationCode string, mjd long").json(str(tmp_path))
    assert "['bucket]" in ingest.gap_changes(stream)._jdf.queryExecution().logical().toString()


def test_sites_of_solutions_come_from_one_pass(spark):
    """Texts are made and read once; a site listed twice, one without estimates and one that is not listed are as in a join."""
    read = text_catalogue.solution_sites_read(spark, SF)
    assert sum("Scan parquet" in line for line in plan(read)) == 1
    estimate = "     1 STAX   {}  {}    1 20:180:43200 m    2  1.5D+03 2.0E-01 x"
    lines = ["+SITE/ID", " s1  A 1M1 P , X", " s1  B 1M2 P , X", " s2  A 2M1 P , X", "-SITE/ID", "+SOLUTION/ESTIMATE", "\t" + estimate.format("s1", "A"), estimate.format("s1", "B"), estimate.format("s2", "B"), estimate.format("s3", "A"), "-SOLUTION/ESTIMATE"]
    files = spark.createDataFrame([("f", "\n".join(lines))], "path string, text string")
    parts = parsers.sinex(files)
    want = parsers.sinex_positions(parts["estimates"]).join(parts["sites"], ["path", "site"])
    got = parsers.sinex_sites(files)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted((r["site"], r["domes"], r["X"], r["sX"], r["Y"]) for r in got.collect()) == [("s1", "1M1", 1500.0, 0.2, None), ("s1", "1M2", 1500.0, 0.2, None)]
