"""Geodetic expressions (M1 to M6, M9 to M11, M17, M18); angles in degrees, lengths in metres unless named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two ellipsoid definitions in use and the mean radius.
SEMI_MAJOR = 6378137.0
ECCENTRICITY = 8.1819190842622e-2
INVERSE_FLATTENING = 298.257223563
RADIUS_KM = 6371.0

# The magnitude and distance score (Gomez et al. 2024) and its factor after the event.
SCORE_A, SCORE_B, AFTER_FACTOR = 0.5261, -1.1478, 1.5

# Fault dimensions from magnitude (Wells and Coppersmith 1994), as 10^(c + m * mag) times a unit.
FAULT = {
    "along_strike_m": (-3.22, 0.69, 1000.0),
    "down_dip_m": (-1.01, 0.32, 1000.0),
    "mean_slip_m": (-4.80, 0.69, 1.0),
    "rupture_km2": (-3.49, 0.91, 1.0),
    "largest_slip_m": (-5.46, 0.82, 1.0),
}


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """M1: great-circle distance on the mean sphere; null where a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() skips nulls: without the guard a missing coordinate would be half a circumference away
    return F.when(h.isNotNull(), 2 * RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """M2: initial bearing from the first point, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), north)) + 360, F.lit(360.0))


def geodetic(x: Column, y: Column, z: Column) -> Column:
    """M3: struct of lat, lon and height from earth-centred coordinates, in closed form."""
    e2 = ECCENTRICITY**2
    minor = SEMI_MAJOR * (1 - e2) ** 0.5
    second = (SEMI_MAJOR**2 - minor**2) / minor**2
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * SEMI_MAJOR, p * minor)
    lat = F.atan2(z + second * minor * F.pow(F.sin(t), 3), p - e2 * SEMI_MAJOR * F.pow(F.cos(t), 3))
    normal = SEMI_MAJOR / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (p / F.cos(lat) - normal).alias("height"))


def earth_centred(lat: Column, lon: Column, height: Column, digits: int = 4) -> Column:
    """M4: struct of x, y and z, rounded."""
    f = 1 / INVERSE_FLATTENING
    e2 = 1 - (1 - f) ** 2
    p, q = F.radians(lat), F.radians(lon)
    v = SEMI_MAJOR / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    flat = (v + height) * F.cos(p)
    return F.struct(
        F.round(flat * F.cos(q), digits).alias("x"), F.round(flat * F.sin(q), digits).alias("y"), F.round((v * (1 - e2) + height) * F.sin(p), digits).alias("z")
    )


def to_neu(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> Column:
    """M5: an earth-centred difference as struct of north, east and up at a place."""
    p, q = F.radians(lat), F.radians(lon)
    toward = F.cos(q) * dx + F.sin(q) * dy
    return F.struct(
        (F.cos(p) * dz - F.sin(p) * toward).alias("n"), (F.cos(q) * dy - F.sin(q) * dx).alias("e"), (F.cos(p) * toward + F.sin(p) * dz).alias("u")
    )


def from_neu(n: Column, e: Column, u: Column, lat: Column, lon: Column) -> Column:
    """The inverse of to_neu."""
    p, q = F.radians(lat), F.radians(lon)
    toward = F.cos(p) * u - F.sin(p) * n
    return F.struct(
        (F.cos(q) * toward - F.sin(q) * e).alias("dx"), (F.sin(q) * toward + F.cos(q) * e).alias("dy"), (F.cos(p) * n + F.sin(p) * u).alias("dz")
    )


def length3(a: Column, b: Column, c: Column) -> Column:
    """The length of a vector, the vertical component included."""
    return F.sqrt(a * a + b * b + c * c)


def spherical(x: Column, y: Column, z: Column) -> Column:
    """M6: struct of lat, lon and radius on a sphere."""
    r = length3(x, y, z)
    return F.struct(F.degrees(F.asin(z / r)).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), r.alias("radius"))


def on_sphere(lat: Column, lon: Column, radius=1.0) -> Column:
    p, q, r = F.radians(lat), F.radians(lon), radius if isinstance(radius, Column) else F.lit(radius)
    return F.struct((r * F.cos(p) * F.cos(q)).alias("x"), (r * F.cos(p) * F.sin(q)).alias("y"), (r * F.sin(p)).alias("z"))


def azimuthal(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """M9: struct of x and y in km on the azimuthal equidistant map around a centre."""
    p, p0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    cosine = F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)
    c = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))
    k = F.when(F.abs(F.sin(c)) < 1e-12, 1.0).otherwise(c / F.sin(c)) * RADIUS_KM
    return F.struct((k * F.cos(p) * F.sin(d)).alias("x"), (k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))).alias("y"))


def from_azimuthal(x: Column, y: Column, lat0: Column, lon0: Column) -> Column:
    """The inverse of azimuthal: struct of lat and lon."""
    p0, r = F.radians(lat0), F.sqrt(x * x + y * y)
    c = r / RADIUS_KM
    unit = F.when(r == 0, 0.0).otherwise(y / r)
    lat = F.asin(F.cos(c) * F.sin(p0) + unit * F.sin(c) * F.cos(p0))
    lon = F.degrees(F.atan2(x * F.sin(c), r * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c)))
    return F.struct(F.degrees(lat).alias("lat"), (lon0 + lon).alias("lon"))


def event_score(magnitude: Column, distance_km: Column) -> Column:
    """Positive where an event of this magnitude moves a station at this distance (at least a metre)."""
    return SCORE_A * magnitude - F.log10(F.greatest(distance_km, F.lit(1e-3))) + SCORE_B


def after_score(magnitude: Column, distance_km: Column) -> Column:
    """The score of slow motion after an event."""
    return event_score(magnitude, distance_km) + F.log10(F.lit(AFTER_FACTOR))


def fault_size(magnitude: Column) -> Column:
    """Struct of fault dimensions."""
    return F.struct(*[(F.pow(F.lit(10.0), c + m * magnitude) * unit).alias(k) for k, (c, m, unit) in FAULT.items()])


def subnet_minutes(n: Column) -> Column:
    """Expected processing minutes of a subnetwork of n stations."""
    return 6.04370855910554 - 0.102313555237178 * n + 0.0206316702864554 * n * n


def vertical_height(slant: Column, h_offset: Column, v_offset: Column) -> Column:
    """An antenna's slant height as vertical height."""
    return F.sqrt(slant * slant - h_offset * h_offset) - v_offset


def cross_track(x: Column, y: Column, z: Column, lat: Column, lon: Column, height: Column) -> Column:
    """Struct of north, east and up of a point against a reference place."""
    ref = earth_centred(lat, lon, height)
    return to_neu(x - ref["x"], y - ref["y"], z - ref["z"], lat, lon)
