"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def station_key(network: Column, station: Column) -> Column:
    """`net.stnm`."""
    return F.concat_ws(".", F.lower(network), F.lower(station))


def pattern(similar: str) -> str:
    """an anchored regular expression of a SIMILAR TO pattern with % _ | [ ] and groups."""
    out = []
    for part in re.split(r"(\[[^\]]*\])", similar):
        if part.startswith("["):
            out.append(part)
            continue
        out += [{"%": ".*", "_": ".", "|": "|", "(": "(", ")": ")"}.get(c) or re.escape(c) for c in part]
    return "^(?:" + "".join(out) + ")$"


def similar_to(value: Column, similar: str) -> Column:
    return value.rlike(pattern(similar))


def not_temporary(network: Column) -> Column:
    """networks whose code begins with a question mark are temporary."""
    return ~network.startswith("?")


def signed_crc32(value: Column) -> Column:
    """CRC-32 in two's complement."""
    c = F.crc32(value)
    return F.when(c >= 2**31, c - 2**32).otherwise(c)


def year_key(year: Column, doy: Column) -> Column:
    """`yyyy ddd`, which sorts by day."""
    return F.format_string("%04d %03d", year.cast("int"), doy.cast("int"))


def wrapped(value: Column, width: int) -> Column:
    """Lines of at most width characters, cut at spaces; longer words stand alone."""
    words = F.split(value, " ")

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + F.length(word) + 1 <= width
        joined = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", last, word)))
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, joined).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), add)


SESSIONS = "0123456789abcdefghijklmnopqrstuvwxABCDEFGHIJKLMNOPQRSTUVWX"


def session_letter(number: Column) -> Column:
    """The letter of the n-th file of a day (from 1)."""
    return F.substring(F.lit(SESSIONS), number.cast("int"), F.lit(1))


def with_sessions(files: DataFrame, day: list[str], order: list[str]) -> DataFrame:
    return files.withColumn("session", session_letter(F.row_number().over(Window.partitionBy(*day).orderBy(*order))))


def plain_event(value: Column) -> Column:
    """Event text without characters beyond ASCII and without lines of scripts."""
    return F.regexp_replace(F.regexp_replace(value, r"[^\x00-\x7F]+", ""), r"(?im)^\s*<script.*?</script>\s*$", "")


def between(value: Column, start: str, end: str) -> Column:
    """The text between two marks."""
    return F.substring_index(F.substring_index(value, start, -1), end, 1)


def full_year(year: Column, turn: int = 80) -> Column:
    """Years of two digits; below the turn they are of this century."""
    return F.when(year >= 100, year).when(year < turn, year + 2000).otherwise(year + 1900)


def valid_equipment(rows: DataFrame, column: str, known: DataFrame, code: str) -> DataFrame:
    """Rows whose code is listed."""
    return rows.join(known.select(F.col(code).alias(column)).distinct(), column, "left_semi")


def host(value: Column) -> Column:
    """X11: struct of host and port of `host:port`."""
    parts = F.split(value, ":")
    return F.struct(parts[0].alias("host"), F.get(parts, F.lit(1)).try_cast("int").alias("port"))


def tagged_path(template: Column, tags: dict[str, Column]) -> Column:
    """A path template with ${tags} replaced."""
    for tag, value in tags.items():
        template = F.replace(template, F.lit("${" + tag + "}"), value.cast("string"))
    return template
