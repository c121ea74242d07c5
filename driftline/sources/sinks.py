"""Text and JSON outputs (K1 to K10). Rows are formatted by expressions and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.archive import numbered
from driftline.operators.selection import KEY


def write_text(rows: DataFrame, path: str, by: list[str] = ()) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)


def fitted_rows(terms: DataFrame, solution: str, digest: DataFrame) -> DataFrame:
    """K1: terms as rows of the etms table, with the hash of their series (digest: station key, hash)."""
    t = terms.filter("term <> 'wrms'").join(digest, KEY)
    kind = F.when(F.col("term") == "poly", "polynomial").when(F.col("term").isin("sin", "cos"), "periodic").otherwise("jump")
    return t.select(
        *KEY, F.lit(solution).alias("soln"), kind.alias("object"), F.when(F.col("term") == "poly", F.col("at")).alias("t_ref"),
        F.when(F.col("term") == "decay", F.array("value")).alias("relaxation"), F.when(kind == "periodic", F.array(1 / F.col("at"))).alias("frequencies"), "params", "sigmas", "hash",
    )


def as_json(rows: DataFrame, name: str = "value") -> DataFrame:
    """K3: each row as JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def delay_lines(delays: DataFrame) -> DataFrame:
    """Zenith delays as text lines of alias, epoch, delay and sigma, with a `file` for each station."""
    d = F.col("Date")
    epoch = F.format_string("%02d:%03d:%05d", F.year(d) % 100, F.dayofyear(d), F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d).cast("int"))
    line = F.concat(F.lit(" "), F.rpad(F.upper("StationCode"), 4, " "), F.lit(" "), epoch, F.format_string("%9.1f%6.1f", F.col("ZTD") * 1000, F.col("sigma") * 1000))
    return delays.select(F.lower("StationCode").alias("file"), line.alias("value"))


def edited_sinex(lines: DataFrame, n_unknowns: int, domes: dict[str, str]) -> DataFrame:
    """K5: SINEX lines with the number of unknowns and the DOMES numbers of sites replaced."""
    line = F.col("line")
    fixed = F.when(line.rlike("^ NUMBER OF UNKNOWNS"), F.format_string(" %-30s%10d", F.lit("NUMBER OF UNKNOWNS"), F.lit(n_unknowns))).otherwise(line)
    site = F.upper(F.trim(F.substring(line, 2, 4)))
    known = F.create_map(*[x for k, v in domes.items() for x in (F.lit(k.upper()), F.lit(v))]) if domes else None
    if known is not None:
        is_site = line.rlike(r"^ \w{4}  ?[A-Z] ") & known[site].isNotNull()
        fixed = F.when(is_site, F.concat(F.substring(line, 1, 9), F.rpad(known[site], 9, " "), F.expr("substring(line, 19)"))).otherwise(fixed)
    return lines.withColumn("line", fixed)


def placemark_lines(stations: DataFrame, text: Column) -> DataFrame:
    """K6: KML placemarks, one a row; header and footer are added where the file is put together."""
    name = F.concat_ws(".", *KEY)
    point = F.concat_ws(",", *[F.col(c).cast("string") for c in ("lon", "lat", "height")])
    return stations.select(F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><description>"), text, F.lit("</description><Point><coordinates>"), point, F.lit("</coordinates></Point></Placemark>")).alias("value"))


def kml(placemarks: DataFrame, path: str) -> None:
    """K6: header, placemarks and footer as ordered lines of one folder."""
    s = placemarks.sparkSession
    ends = s.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), (2, "</Document></kml>")], "o int, value string")
    every = placemarks.select(F.lit(1).alias("o"), "value").union(ends)
    every.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def apriori_lines(stations: DataFrame) -> DataFrame:
    """K8: a-priori coordinate lines."""
    return stations.select(F.format_string(" %s_GPS %15.4f %15.4f %15.4f %9.5f %9.5f %9.5f %9.4f", F.upper("StationCode"), "X", "Y", "Z", "VX", "VY", "VZ", "epoch").alias("value"))


def sigma_lines(stations: DataFrame) -> DataFrame:
    """K8: coordinate constraint lines."""
    return stations.select(F.format_string("%s %s_GPS %8.3f %8.3f %8.3f", F.upper("StationCode"), F.upper("StationCode"), "sigma_n", "sigma_e", "sigma_u").alias("value"))


def loading_requests(stations: DataFrame, size: int = 99) -> DataFrame:
    """K9: request lines numbered into files of at most `size` stations."""
    line = F.format_string("%-24s %16.4f%16.4f%16.4f", F.concat_ws("_", *KEY), "auto_x", "auto_y", "auto_z")
    rows = numbered(stations.select(*KEY, line.alias("value")), KEY, "n")
    return rows.select(F.floor((F.col("n") - 1) / size).cast("int").alias("file"), "value")


def motion_lines(rows: DataFrame) -> DataFrame:
    """Station, lon, lat, east and north motion."""
    return rows.select(F.format_string("%s.%s %12.7f %12.7f %9.5f %9.5f", *KEY, "lon", "lat", "v_e", "v_n").alias("value"))
