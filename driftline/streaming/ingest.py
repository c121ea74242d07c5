"""Structured Streaming counterparts of the polled ingest: file source, idempotent insert, late files, gaps in flight."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.archive import best_files, inspected
from driftline.operators.selection import KEY

DAY = [*KEY, "ObservationYear", "ObservationDOY"]


def arrivals(spark: SparkSession, folder: str, per_batch: int = 10_000) -> DataFrame:
    """Inspection records as they arrive: one JSON text a line, with the columns of inspected()."""
    return inspected(spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder), "value")


def distinct_arrivals(stream: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Arrivals less repeats of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Files by key and tumbling window, closed when the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


#: So many values of a partition column are listed one by one; beyond them their range is read.
MOST_LISTED = 1000


def touched(target: DataFrame, batch: DataFrame, by: str) -> DataFrame:
    """The rows of target in the partitions of a batch, by values the planner prunes with; null is a value too."""
    kind = batch.schema[by].dataType
    column = F.col(by).cast(kind)
    some = [r[0] for r in batch.select(by).distinct().limit(MOST_LISTED + 1).collect()]
    if len(some) <= MOST_LISTED:
        listed = [v for v in some if v is not None]
        return target.filter(column.isin(listed) | column.isNull() if None in some else column.isin(listed))
    low, high = batch.agg(F.min(by), F.max(by)).first()
    return target.filter(column.between(F.lit(low), F.lit(high)) | column.isNull())


def insert_new(path: str, keys: list[str], by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key the table at path lacks; a batch that is run again adds none.
    Nulls of a key are one value.

    by names a key column that the table's folders are parted by: a batch then reads the keys of its own parts only."""
    if by is not None and by not in keys:
        raise ValueError(f"{by} is no key: a known key might lie in another part")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path)
            known = (touched(known, batch, by) if by else known).select(*[F.col(k).cast(batch.schema[k].dataType).alias(k) for k in keys])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            known = batch.select(*keys).limit(0)
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        new = batch.dropDuplicates(keys).alias("b").join(known.alias("k"), same, "left_anti").write.mode("append")
        (new.partitionBy(by) if by else new).parquet(path)

    return run


def refreshed_days(files: DataFrame, batch: DataFrame) -> DataFrame:
    """The best file of each day that a batch touches: a late, better file changes its own day only."""
    return best_files(files.join(batch.select(*DAY).distinct(), DAY, "left_semi"))


GAPS = "NetworkCode string, StationCode string, last_mjd long, next_mjd long, gap_days long"


def gaps_in_flight(stream: DataFrame, least: int = 1) -> DataFrame:
    """Gaps between the days of each station as they arrive; the state is each station's last day.

    Days that arrive after a later one do not close a reported gap: gap_changes takes it back, with more state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        days = sorted({int(d) for b in batches for d in b["mjd"]})
        for d in days:
            if last is not None and d - last - 1 >= least:
                out.append((*key, last, d, d - last - 1))
            last = d if last is None else max(last, d)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["NetworkCode", "StationCode", "last_mjd", "next_mjd", "gap_days"])

    return stream.groupBy(*KEY).applyInPandasWithState(run, GAPS, "last long", "append", "NoTimeout")


GAP_CHANGES = "NetworkCode string, StationCode string, last_mjd long, next_mjd long, change int"


def runs_with(first: np.ndarray, last: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive days (their first and last days, ascending) after further days."""
    a, b = np.concatenate([first, days]), np.concatenate([last, days])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    cut = np.flatnonzero(a[1:] > b[:-1] + 1)
    return a[np.append(0, cut + 1)], b[np.append(cut, len(a) - 1)]


#: States that stations share in gap_changes; a stream's checkpoint holds for one number of them.
BUCKETS = 512


def gap_changes(stream: DataFrame, least: int = 1) -> DataFrame:
    """Gaps of at least so many days as they open and close, in whatever order a station's days (mjd) arrive.

    change is 1 for a gap that is there from now on and -1 for a reported one that a late day has closed, moved or parted,
    so that standing_gaps of all changes is what the batch operator finds in all days. Repeated days change nothing, days of
    null are passed over. Stations share BUCKETS states, so that a call works on the days of many at once; a state is their runs
    of consecutive days, as bytes: it grows with the gaps, not with the days."""

    def gaps_of(runs: pd.DataFrame) -> pd.DataFrame:
        station = runs["station"].to_numpy()
        last, following = runs["last"].to_numpy()[:-1], runs["first"].to_numpy()[1:]
        wide = (station[1:] == station[:-1]) & (following - last - 1 >= least)
        return pd.DataFrame({"station": station[:-1][wide], "last_mjd": last[wide], "next_mjd": following[wide]})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, runs = {}, pd.DataFrame({c: np.empty(0, np.int64) for c in ("station", "first", "last")})
        if state.exists:
            known, *packed = state.get
            names = {tuple(n): i for i, n in enumerate(json.loads(known))}
            runs = pd.DataFrame({c: np.frombuffer(bytes(p), np.int64) for c, p in zip(runs.columns, packed)})
        parts = [runs]
        for batch in batches:
            own = batch.dropna(subset=["mjd"])
            pairs = list(zip(*[own[c].astype(object).where(own[c].notna(), None).tolist() for c in KEY]))
            days = own["mjd"].to_numpy(np.int64)
            parts.append(pd.DataFrame({"station": np.fromiter((names.setdefault(p, len(names)) for p in pairs), np.int64, len(pairs)), "first": days, "last": days}))
        before, every = gaps_of(runs), pd.concat(parts)
        order = np.lexsort((every["first"], every["station"]))
        station, first, last = (every[c].to_numpy()[order] for c in ("station", "first", "last"))
        if len(station):
            # the greatest day so far of each station: stations are set apart by more than the days of all of them
            apart = (station - station[0]) * (int(last.max()) - int(first.min()) + 2)
            reach = np.maximum.accumulate(last + apart)
            cut = np.flatnonzero((station[1:] != station[:-1]) | (first[1:] + apart[1:] > reach[:-1] + 1)) + 1
            begin, end = np.append(0, cut), np.append(cut - 1, len(station) - 1)
            station, first, last = station[begin], first[begin], (reach - apart)[end]
        after = gaps_of(pd.DataFrame({"station": station, "first": first, "last": last}))
        state.update((json.dumps(list(names)), *[x.astype(np.int64).tobytes() for x in (station, first, last)]))
        both = before.merge(after, how="outer", indicator=True).sort_values(["station", "last_mjd", "next_mjd"])
        changed = both[both["_merge"] != "both"]
        change = np.where(changed["_merge"] == "left_only", -1, 1)
        place = list(names)
        out = {c: [place[i][k] for i in changed["station"]] for k, c in enumerate(KEY)}
        found = pd.DataFrame(out | {"last_mjd": changed["last_mjd"].to_numpy(), "next_mjd": changed["next_mjd"].to_numpy(), "change": change.astype(np.int32)})
        yield found.sort_values("change", kind="stable")

    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS))
    return stream.select(*KEY, "mjd", bucket.alias("bucket")).groupBy("bucket").applyInPandasWithState(run, GAP_CHANGES, "names string, station binary, first binary, last binary", "append", "NoTimeout")


def standing_gaps(changes: DataFrame) -> DataFrame:
    """The gaps that stand after all changes."""
    found = changes.groupBy(*KEY, "last_mjd", "next_mjd").agg(F.sum("change").alias("n")).filter("n > 0")
    return found.drop("n").withColumn("gap_days", F.col("next_mjd") - F.col("last_mjd") - 1)
