"""Geometry as Column expressions: points are lon/lat doubles, rings arrays of structs, distances great-circle metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEG_M = 111_320.0
DEG_M_ROUND = 111_000.0
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINT = rf"(?i)POINT\s*(?:Z\s*)?\(\s*({NUMBER})\s+({NUMBER})"


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def point_of(wkt: Column | str) -> Column:
    """struct(lon, lat) of a WKT or EWKT point; null for null, empty and other geometries."""
    text = _c(wkt)
    lon, lat = (F.regexp_extract(text, POINT, k).try_cast("double") for k in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    a1, o1, a2, o2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(a2 - a1) / 2), 2) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cosine_law_m(lat1, lon1, lat2, lon2) -> Column:
    """The same distance by the spherical law of cosines, its argument clamped to [-1, 1]."""
    a1, o1, a2, o2 = map(_c, (lat1, lon1, lat2, lon2))
    x = F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.cos(F.radians(o2) - F.radians(o1)) + F.sin(F.radians(a1)) * F.sin(F.radians(a2))
    return F.lit(EARTH_M) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    a1, o1, a2, o2 = map(_c, (lat1, lon1, lat2, lon2))
    d = F.radians(o2) - F.radians(o1)
    y = F.sin(d) * F.cos(F.radians(a2))
    x = F.cos(F.radians(a1)) * F.sin(F.radians(a2)) - F.sin(F.radians(a1)) * F.cos(F.radians(a2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def lerp(a, b, t) -> Column:
    """Linear interpolation with t clamped to [0, 1]."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(t)))
    return _c(a) + (_c(b) - _c(a)) * u


def planar_degrees(lat1, lon1, lat2, lon2) -> Column:
    """Distance in degrees with longitudes unscaled: the order of a planar nearest-neighbour index."""
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), 2) + F.pow(_c(lon1) - _c(lon2), 2))


def in_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    """Four range comparisons, which reach the Parquet scan."""
    return _c(lat).between(F.lit(south), F.lit(north)) & _c(lon).between(F.lit(west), F.lit(east))


def box_around(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """south, west, north, east of a box that holds the circle."""
    import math

    d = metres / DEG_M
    e = d / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + d))))
    return lat - d, lon - e, lat + d, lon + e


def within_m(lat, lon, at_lat: float, at_lon: float, metres: float) -> Column:
    """A box that the scan can use and the exact distance."""
    return in_box(lat, lon, *box_around(at_lat, at_lon, metres)) & (haversine_m(lat, lon, at_lat, at_lon) <= metres)


def segment_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Distance in metres from a point to a segment: planar projection in degrees, great-circle measure."""
    p, q, a, b, c, d = map(_c, (lat, lon, lat1, lon1, lat2, lon2))
    dx, dy = d - b, c - a
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((q - b) * dx + (p - a) * dy) / norm)))
    return haversine_m(p, q, a + t * dy, b + t * dx)


def line_m(lat, lon, line: list[tuple[float, float]]) -> Column:
    """Distance in metres from a point to a fixed line of (lon, lat) vertices."""
    parts = [segment_m(lat, lon, a[1], a[0], b[1], b[0]) for a, b in zip(line, line[1:])]
    return parts[0] if len(parts) == 1 else F.least(*parts)


def ring_contains(ring: Column | str, lat, lon) -> Column:
    """Even-odd ray cast over a ring, an array of struct(lon, lat) whose last vertex repeats the first."""
    r, y, x = _c(ring), _c(lat), _c(lon)
    sides = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(r) - 1)),
        lambda i: F.struct(F.get(r, i - 1).alias("a"), F.get(r, i).alias("b")),
    )

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return (a["lat"] > y) != (b["lat"] > y)

    def left_of(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return x < (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]

    hits = F.size(F.filter(sides, lambda s: F.when(crosses(s), left_of(s)).otherwise(F.lit(False))))
    return F.when(F.size(r) >= 4, hits % 2 == 1).otherwise(F.lit(False))


def ring_area_m2(ring: Column | str) -> Column:
    """Area of a ring on the mean sphere, in square metres (unsigned)."""
    r = _c(ring)
    parts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(r) - 1)),
        lambda i: F.radians(F.get(r, i)["lon"] - F.get(r, i - 1)["lon"]) * (2 + F.sin(F.radians(F.get(r, i - 1)["lat"])) + F.sin(F.radians(F.get(r, i)["lat"]))),
    )
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.abs(total) * F.lit(EARTH_M * EARTH_M / 2)


def line_length_m(line: Column | str) -> Column:
    """Length of a line, an array of struct(lon, lat)."""
    r = _c(line)
    parts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(r) - 1)),
        lambda i: haversine_m(F.get(r, i - 1)["lat"], F.get(r, i - 1)["lon"], F.get(r, i)["lat"], F.get(r, i)["lon"]),
    )
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def point_geojson(lon, lat) -> Column:
    """GeoJSON text of a point."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(_c(lon), _c(lat)).alias("coordinates")))
