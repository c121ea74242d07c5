"""What a change to a table means for others: change sets, flags kept up to date, refused aliases, deletes that cascade (2.15).

Each is a function of two states of a table or of the rows that go, so that a flag can be kept by what has changed and equals one
computed from nothing."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.selection import KEY


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change (insert, delete, update) of the rows that two states of a table with these keys differ in; null keys are equal."""
    own = [c for c in after.columns if c not in keys]
    key = F.struct(*[F.col(f"`{c}`") for c in keys]).alias("driftline_key")
    side = lambda df, name: df.select(key, F.struct(F.lit(True).alias("there"), *[F.col(f"`{c}`") for c in own]).alias(name))
    both = side(before, "was").join(side(after, "now"), "driftline_key", "full_outer")
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
    return both.select(*[F.col(f"driftline_key.`{c}`").alias(c) for c in keys], kind.alias("change")).filter("change is not null")


def touched(*change_sets: DataFrame) -> DataFrame:
    """The stations that any of the changes concern."""
    return reduce(DataFrame.unionByName, [c.select(*KEY) for c in change_sets]).distinct()


def kept_flags(meta: DataFrame, files: DataFrame, sessions: DataFrame, sessions_now: DataFrame) -> DataFrame:
    """meta (station key, has_gaps_update_needed, has_stationinfo) after changes to files and sessions (of changes).

    A change to either makes a station's gaps due. Whether it has records is looked up for the stations whose records changed only."""
    due = touched(files, sessions).withColumn("due", F.lit(True))
    asked = touched(sessions).withColumn("asked", F.lit(True))
    there = sessions_now.join(asked.select(*KEY), KEY, "left_semi").select(*KEY).distinct().withColumn("there", F.lit(True))
    out = meta.join(due, KEY, "left").join(asked, KEY, "left").join(there, KEY, "left")
    flags = {
        "has_gaps_update_needed": F.coalesce(F.col("has_gaps_update_needed") | F.col("due"), "due", "has_gaps_update_needed"),
        "has_stationinfo": F.when(F.col("asked"), F.col("there").isNotNull()).otherwise(F.col("has_stationinfo")),
    }
    return out.withColumns(flags).select(*meta.columns)


def split_aliases(stations: DataFrame, aliases: DataFrame, alias: str = "StationAlias") -> tuple[DataFrame, DataFrame]:
    """New aliases, and those refused because a station has them as its code; a null alias is neither looked up nor refused."""
    codes = stations.select(F.col("StationCode").alias(alias)).distinct()
    return aliases.join(codes, alias, "left_anti").select(*aliases.columns), aliases.join(codes, alias, "left_semi").select(*aliases.columns)


class Link(NamedTuple):
    """Rows of child go with the rows of parent that they refer to: child_key and parent_key are the columns that must be equal."""

    child: str
    child_key: tuple[str, ...]
    parent: str
    parent_key: tuple[str, ...]


def cascade(tables: dict[str, DataFrame], root: str, gone: DataFrame, links: list[Link]) -> dict[str, DataFrame]:
    """All tables without the rows of root that are gone (rows of root) and what refers to them, link by link, parents first.

    A table that no link names stays as it is; null keys refer to nothing. Each link is a semi join that finds what goes and an anti join that leaves it out."""
    out, lost = dict(tables), {root: [gone]}
    of = lambda df, link: df.select(*[F.col(p).alias(c) for p, c in zip(link.parent_key, link.child_key)]).distinct()
    own = links[0].parent_key if links and links[0].parent == root else tuple(KEY)
    out[root] = tables[root].join(gone.select(*own).distinct(), list(own), "left_anti")
    for link in links:
        for rows in lost.get(link.parent, []):
            keys = of(rows, link)
            lost.setdefault(link.child, []).append(tables[link.child].join(keys, list(link.child_key), "left_semi"))
            out[link.child] = out[link.child].join(keys, list(link.child_key), "left_anti").select(*tables[link.child].columns)
    return out
