"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset a local master, as in tests, gets a
    temporary folder, which goes with the process; elsewhere a local folder would be out of other executors' reach."""
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {FOLDER} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="driftline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(FOLDER, folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: evaluated once, and its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
