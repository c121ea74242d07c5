import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.streaming import ingest


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def record(interval=30, first="2020-01-01T00:00:00", last="2020-01-01T23:59:30"):
    return {"data": {"epoch": {"interval": interval, "number": 2880, "number_extra": 0, "first": first, "last": last}}}


def test_arrivals_are_inserted_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    lines(folder / "1.json", [record(), record(interval=0)])
    for turn in range(2):
        stream = ingest.arrivals(spark, str(folder)).filter("reason is null").select("first", "interval")
        q = stream.writeStream.foreachBatch(ingest.insert_new(out, ["first", "interval"])).option("checkpointLocation", str(tmp_path / f"c{turn}")).trigger(availableNow=True).start()
        q.awaitTermination()
        lines(folder / "2.json", [record(), record(first="2020-01-02T00:00:00", last="2020-01-02T23:59:30")])
    assert spark.read.parquet(out).count() == 2


def test_gaps_in_flight_equal_the_batch(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    schema = "NetworkCode string, StationCode string, mjd long"
    lines(folder / "1.json", [{"NetworkCode": "a", "StationCode": "one", "mjd": d} for d in (1, 2, 5)])
    stream = spark.readStream.schema(schema).json(str(folder))
    q = ingest.gaps_in_flight(stream).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["last_mjd"], r["next_mjd"], r["gap_days"]) for r in spark.table("gaps").collect()]
    assert got == [(2, 5, 2)]


def test_gap_changes_in_any_order_equal_the_batch(spark, tmp_path):
    """Five orders of arrival, with repeats, nulls and a station of one day."""
    r = np.random.default_rng(4)
    days = {f"s{k}": sorted({int(d) for d in r.integers(0, 60, 25)}) for k in range(4)} | {"lone": [7]}
    rows = [{"NetworkCode": "a", "StationCode": s, "mjd": d} for s, own in days.items() for d in own]
    rows += rows[::3] + [{"NetworkCode": "a", "StationCode": "s0", "mjd": None}]
    schema = "NetworkCode string, StationCode string, mjd long"
    for least in (1, 3):
        want = {(s, a, b, b - a - 1) for s, own in days.items() for a, b in zip(own, own[1:]) if b - a - 1 >= least}
        for turn in range(5 if least == 1 else 1):
            folder = tmp_path / f"in{least}{turn}"
            folder.mkdir()
            order = r.permutation(len(rows))
            for n, part in enumerate(np.array_split(order, 4)):
                lines(folder / f"{n}.json", [rows[i] for i in part])
            name = f"changes{least}{turn}"
            stream = ingest.gap_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), least)
            stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
            got = {(x["StationCode"], x["last_mjd"], x["next_mjd"], x["gap_days"]) for x in ingest.standing_gaps(spark.table(name)).collect()}
            assert got == want
            assert spark.table(name).filter("change < 0").count() > 0


def test_runs_with_further_days():
    none = np.empty(0, np.int64)
    first, last = ingest.runs_with(none, none, np.array([5, 1, 2, 5]))
    assert (first.tolist(), last.tolist()) == ([1, 5], [2, 5])
    first, last = ingest.runs_with(first, last, np.array([3, 4, 9]))
    assert (first.tolist(), last.tolist()) == ([1, 9], [5, 9])


def test_insert_reads_the_parts_of_its_batch_only(spark, tmp_path):
    path = str(tmp_path / "parted")
    df = spark.createDataFrame([(1, 2020), (2, 2021), (3, None)], "id long, y int")
    put = ingest.insert_new(path, ["id", "y"], by="y")
    put(df, 0)
    put(df, 0)
    assert spark.read.parquet(path).count() == 3
    put(df.filter("y = 2021").union(spark.createDataFrame([(4, 2021)], df.schema)), 1)
    assert sorted((r["id"], r["y"]) for r in spark.read.parquet(path).filter("y is not null").collect()) == [(1, 2020), (2, 2021), (4, 2021)]
    plan = ingest.touched(spark.read.parquet(path), df.filter("y = 2021"), "y")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2021" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ingest.touched(spark.read.parquet(path), df.filter("y is null"), "y").count() == 1
    with pytest.raises(ValueError):
        ingest.insert_new(path, ["id"], by="y")


def test_late_file_refreshes_its_day_only(spark):
    cols = "NetworkCode string, StationCode string, ObservationYear int, ObservationDOY int, Interval double, Completion double"
    files = spark.createDataFrame([("a", "one", 2020, 1, 30.0, 0.5), ("a", "one", 2020, 1, 30.0, 0.9), ("a", "one", 2020, 2, 30.0, 0.5)], cols)
    got = ingest.refreshed_days(files, files.filter("Completion = 0.9")).collect()
    assert [(r["ObservationDOY"], r["Completion"]) for r in got] == [(1, 0.9)]


def test_watermarked_counts_plan(spark, tmp_path):
    (tmp_path / "w").mkdir()
    stream = spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "w"))
    assert ingest.counts(stream, "ts", ["k"]).isStreaming and ingest.distinct_arrivals(stream, "ts", ["k"]).isStreaming
    assert F.col("k") is not None
