"""The table store (S1 to S6, K1, K2): Parquet tables under one folder, with staged rewrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.selection import condition, lookup
from driftline.sources.schema import KEYS, SCHEMAS


class DuplicateKey(ValueError):
    """An insert met a key that the table holds."""


class Store:
    """Tables as lists of Parquet folders. A change writes its rows to a new folder and then appends one row, the folders
    of the new version, to the version table, so that readers see all of a change or nothing (S5), on any file system
    Spark can reach. Inserts add a folder, updates and deletes rewrite the table. A table has one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def paths(self, name: str) -> list[str]:
        """The folders of a table's last version."""
        try:
            log = self.spark.read.schema("name string, paths array<string>, version long").parquet(f"{self.folder}/_versions")
            row = log.filter(F.col("name") == name).groupBy().agg(F.max_by("paths", "version").alias("p")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return list(row["p"] or []) if row else []

    def read(self, name: str) -> DataFrame:
        schema, paths = SCHEMAS[name], self.paths(name)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, name: str, rows: DataFrame) -> None:
        self.publish_all({name: [self.staged(name, rows)]})

    def replace_all(self, tables: dict[str, DataFrame]) -> None:
        """Several tables in one change: all are staged first, then one file names every new version, so that a
        failure on the way leaves all tables as they were."""
        self.publish_all({name: [self.staged(name, rows)] for name, rows in tables.items()})

    def staged(self, name: str, rows: DataFrame) -> str:
        """rows in a new folder, which no version names yet."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        self.conformed(name, rows).write.parquet(path)
        return path

    def publish(self, name: str, paths: list[str]) -> None:
        self.publish_all({name: paths})

    def publish_all(self, tables: dict[str, list[str]]) -> None:
        """The folders of each table's new version, as rows of one file."""
        if not tables:
            return
        listed = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, p)).alias("paths")) for n, p in tables.items()]))
        rows = self.spark.range(1).select(listed.alias("t"), F.unix_micros(F.current_timestamp()).alias("version")).select("t.name", "t.paths", "version")
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/_versions")

    def columns(self, name: str) -> list[str]:
        """S6."""
        return self.read(name).columns

    def conformed(self, name: str, rows: DataFrame) -> DataFrame:
        """The table's columns and types; unknown columns go, missing ones are null."""
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    def get(self, name: str, limit: int | None = None, fields: list[str] | None = None, **equal) -> DataFrame:
        """S2."""
        return lookup(self.read(name), limit, fields, **equal)

    def insert(self, name: str, rows: DataFrame, skip_known: bool = False) -> None:
        """S3, K1: appends rows; known or repeated keys raise, or are skipped."""
        new, keys = self.conformed(name, rows), KEYS[name]
        paths, known = self.paths(name), self.read(name).select(*keys)
        fresh = new.dropDuplicates(keys).join(known, keys, "left_anti").select(*new.columns)
        if not skip_known and fresh.count() != new.count():
            raise DuplicateKey(name)
        self.publish(name, [*paths, self.staged(name, fresh)])

    def update(self, name: str, values: dict, **equal) -> None:
        """Sets values in the rows of a condition."""
        if not equal:
            raise ValueError("an update needs a condition")
        test = condition(**equal)
        self.replace(name, self.read(name).withColumns({c: F.when(test, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, name: str, **equal) -> None:
        """Removes the rows of a condition, which must not be empty."""
        if not equal:
            raise ValueError("a delete needs a condition")
        self.replace(name, self.read(name).filter(~condition(**equal)))

    def sql(self, text: str, *names: str) -> DataFrame:
        """SQL text over the named tables."""
        for n in names:
            self.read(n).createOrReplaceTempView(n)
        return self.spark.sql(text)
