"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.storage import shared_folder

#: Shuffle files of a finished write go at once; what it wrote replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITING, LOCK = {"now": 0, "before": "false"}, threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of writes inside go when they are done. Threads that write at the same time share the setting."""
    with LOCK:
        if not WRITING["now"]:
            WRITING["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        WRITING["now"] += 1
    try:
        yield
    finally:
        with LOCK:
            WRITING["now"] -= 1
            if not WRITING["now"]:
                spark.conf.set(CLEANUP, WRITING["before"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with without_shuffle_files(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.driftline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.driftline_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_below(share: Column | float) -> Column:
    """Whether a document's id hashes into the lowest share of all hashes."""
    return F.xxhash64("doc_id").cast("double") < (F.lit(share) if not isinstance(share, Column) else share) * F.lit(2.0**64) - F.lit(2.0**63)


def smallest_hashes(rows: DataFrame, most: int, n: int) -> DataFrame:
    """The most rows of least hash of doc_id; n is the number of rows.

    Only about twice as many rows get to the sort, however many tasks there are."""
    near = rows if n <= 4 * most else rows.filter(hashed_below(2.0 * most / n))
    return near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
