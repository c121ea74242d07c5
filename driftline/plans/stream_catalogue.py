"""Registered queries of the streaming operators: each streams files of the driver's tables in several batches to its end,
so that days come late, and reads what it has written; the oracle is the batch result over all rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.plans.catalogue import query
from driftline.plans.station_catalogue import rows, with_
from driftline.session import table
from driftline.storage import shared_folder, written
from driftline.streaming import ingest

#: Each stream arrives in files of this many groups, one group a batch.
ARRIVALS = 4


def arriving(spark: SparkSession, df: DataFrame, group: str) -> DataFrame:
    """df as a stream of ARRIVALS batches or so: rows of a group (a number from 0) arrive together."""
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    df.withColumn("arrival", F.expr(group)).write.partitionBy("arrival").parquet(folder)
    n_files = spark.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().count()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, n_files // ARRIVALS)).parquet(f"{folder}/arrival=*")


def to_its_end(stream: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}")
    w.trigger(availableNow=True).start().awaitTermination()


def kept_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own: one that is run again writes the same folder."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


@query(
    f"""{with_('solutions')}, d as (select distinct NetworkCode, StationCode, date_diff('day', date '1858-11-17', date::date) m from solutions), g as (select *, lead(m) over (partition by NetworkCode, StationCode order by m) nxt from d)
select NetworkCode, StationCode, m last_mjd, nxt next_mjd, nxt - m - 1 gap_days from g where nxt - m - 1 >= 30"""
)
def gaps_of_arrivals(spark, sf):
    """2.14, W6: gaps of 30 days or more while days of all years arrive in four batches; late days take gaps back."""
    days = rows(spark, sf, "solutions").select("NetworkCode", "StationCode", F.expr("cast(datediff(cast(date as date), date'1858-11-17') as bigint)").alias("mjd"), "solution_id")
    path = f"{shared_folder(spark)}/gaps-{uuid.uuid4().hex}"
    to_its_end(ingest.gap_changes(arriving(spark, days, f"solution_id % {ARRIVALS}"), 30), kept_by_batch(path))
    return ingest.standing_gaps(spark.read.schema(ingest.GAP_CHANGES).parquet(f"{path}/batch=*"))


@query("select distinct l_orderkey, l_linenumber, year(l_shipdate)::int y from lineitem")
def arrivals_inserted(spark, sf):
    """2.14, S3: every row arrives twice, in different batches, and is inserted once; a batch reads its own years only."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(year(l_shipdate) as int) y", "explode(array(0, 1)) turn")
    path = f"{shared_folder(spark)}/inserted-{uuid.uuid4().hex}"
    to_its_end(arriving(spark, lines, f"(l_orderkey + turn) % {ARRIVALS}").drop("turn"), ingest.insert_new(path, ["l_orderkey", "l_linenumber", "y"], by="y"))
    return written(spark.read.schema("l_orderkey long, l_linenumber int, y int").parquet(path), "arrivals")


@query(
    """with f as (select concat('n', o_custkey % 7) NetworkCode, year(o_orderdate)::int "Year", o_orderkey from orders) select NetworkCode, "Year", count(*) n, count(distinct o_orderkey) n_files from f group by 1, 2"""
)
def files_counted_in_flight(spark, sf):
    """2.14, A2: files by network and year from the distinct arrivals of a stream in which each arrives twice."""
    f = table(spark, sf, "orders").selectExpr("concat('n', o_custkey % 7) NetworkCode", "cast(year(o_orderdate) as int) Year", "o_orderkey", "explode(array(0, 1)) turn", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey % 600 as int), 0) at")
    path = f"{shared_folder(spark)}/counted-{uuid.uuid4().hex}"
    once = ingest.distinct_arrivals(arriving(spark, f, f"(o_orderkey + turn) % {ARRIVALS}").drop("turn"), "at", ["o_orderkey"])
    to_its_end(once, kept_by_batch(path))
    read = spark.read.schema("NetworkCode string, Year int, o_orderkey long").parquet(f"{path}/batch=*")
    return read.groupBy("NetworkCode", "Year").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_files"))
