"""Calendar expressions (D1 to D10). All are built-in columns; dates are `date`, instants `timestamp_ntz`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MJD_OF_1970 = 40587
GPS_START = "1980-01-06"


def date_of(year: Column, doy: Column) -> Column:
    """The date of a year and day of year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def doy(day: Column) -> Column:
    return F.dayofyear(day)


def days_in_year(year: Column) -> Column:
    """366 in years divisible by 4, as the fractional years of the archive are defined."""
    return F.when(year % 4 == 0, 366).otherwise(365)


def is_leap(year: Column) -> Column:
    """The Gregorian rule."""
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def fractional_year(year: Column, doy: Column, hour=12, minute=0, second=0) -> Column:
    """The first day of a year begins at the whole number."""
    hours = [F.lit(x) if not isinstance(x, Column) else x for x in (hour, minute, second)]
    return year + (doy - 1 + hours[0] / 24 + hours[1] / 1440 + hours[2] / 86400) / days_in_year(year)


def fractional_year_from_one(year: Column, doy: Column, hour=12) -> Column:
    """The store's own variant, a day later: it counts the day of year from 1."""
    return year + (doy + F.lit(hour) / 24) / F.when(is_leap(year), 366).otherwise(365)


def from_fractional_year(fyear: Column) -> Column:
    """D3: the instant of a fractional year, to the second."""
    year = F.floor(fyear).cast("int")
    seconds = F.round((fyear - year) * days_in_year(year) * 86400).cast("long")
    start = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return start + F.make_interval(secs=seconds)


def gps_week(day: Column) -> Column:
    """Whole weeks since the start of GPS time."""
    return F.floor(F.datediff(day, F.lit(GPS_START).cast("date")) / 7).cast("int")


def gps_day(day: Column) -> Column:
    return F.pmod(F.datediff(day, F.lit(GPS_START).cast("date")), F.lit(7))


def mjd(day: Column) -> Column:
    """Modified Julian day number of a date."""
    return F.unix_date(day.cast("date")) + MJD_OF_1970


def from_mjd(number: Column) -> Column:
    return F.date_from_unix_date((number - MJD_OF_1970).cast("int"))


def parse_day(text: Column) -> Column:
    """`yyyy/mm/dd`, `yyyy_doy`, `wwww-d` (GPS week and day) or a fractional year; null where none fits."""
    week = F.regexp_extract(text, r"^(\d{4})-(\d)$", 1)
    day = F.regexp_extract(text, r"^(\d{4})-(\d)$", 2)
    y, d = (F.regexp_extract(text, r"^(\d{4})_(\d{1,3})$", i) for i in (1, 2))
    return (
        F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.to_date(text, "y/M/d"))
        .when(text.rlike(r"^\d{4}_\d{1,3}$"), date_of(F.expr("0") + y.try_cast("int"), d.try_cast("int")))
        .when(text.rlike(r"^\d{4}-\d$"), F.date_add(F.lit(GPS_START).cast("date"), week.try_cast("int") * 7 + day.try_cast("int")))
        .when(text.rlike(r"^\d{4}\.\d*$"), from_fractional_year(text.try_cast("double")).cast("date"))
    )


def session_instant(text: Column) -> Column:
    """`yyyy doy hh mm ss`; hours above 23 mean the day's last second, year 9999 an open end (null)."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{4})\s+(\d{1,3})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})", i).try_cast("int")
    late = part(3) > 23
    seconds = F.when(late, 86399).otherwise(part(3) * 3600 + part(4) * 60 + part(5))
    start = date_of(part(1), part(2)).cast("timestamp_ntz")
    return F.when(part(1) < 9999, start + F.make_interval(secs=seconds))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """The first and the last second of a day."""
    start = day.cast("timestamp_ntz")
    return start, start + F.make_interval(secs=F.lit(86399))


def segments(spans: DataFrame, start: str, end: str, days: int = 14) -> DataFrame:
    """Each row for each segment of so many days between two date columns, as segment_start and segment_end."""
    begin = F.explode(F.sequence(F.col(start), F.col(end), F.make_dt_interval(days=F.lit(days))))
    out = spans.withColumn("segment_start", begin)
    return out.withColumn("segment_end", F.least(F.date_add("segment_start", days), F.col(end)))


def calendar_columns(rows: DataFrame, day: str) -> DataFrame:
    """All day numberings of a date column at once."""
    d = F.col(day).cast("date")
    year, number = F.year(d), F.dayofyear(d)
    return rows.withColumns(
        {
            "year": year, "doy": number, "gps_week": gps_week(d), "gps_day": gps_day(d), "mjd": mjd(d),
            "fyear": F.round(fractional_year(year, number), 6), "leap": is_leap(year),
        }
    )
