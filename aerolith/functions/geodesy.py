"""Geodesy as Column expressions; angles are degrees, distances metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean sphere, equatorial radius, WGS84 flattening and eccentricity.
MEAN_RADIUS = 6371000.0
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
EP2 = (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * MEAN_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north, up on a tangent plane; good over a few kilometres."""
    return F.radians(lon - lon0) * SEMI_MAJOR * F.cos(F.radians(lat0)), F.radians(lat - lat0) * SEMI_MAJOR, alt - alt0


def flat_geodetic(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    return lat0 + F.degrees(n / SEMI_MAJOR), lon0 + F.degrees(e / (SEMI_MAJOR * F.cos(F.radians(lat0)))), alt0 + u


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    sin_lat, cos_lat = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = SEMI_MAJOR / F.sqrt(1 - E2 * sin_lat * sin_lat)
    return (n + alt) * cos_lat * F.cos(F.radians(lon)), (n + alt) * cos_lat * F.sin(F.radians(lon)), (n * (1 - E2) + alt) * sin_lat


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """From ECEF, by Bowring's formula; on the axis the latitude is +-90."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * SEMI_MAJOR, p * SEMI_MINOR)
    lat = F.atan2(z + EP2 * SEMI_MINOR * F.pow(F.sin(theta), 3), p - E2 * SEMI_MAJOR * F.pow(F.cos(theta), 3))
    n = SEMI_MAJOR / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
    pole = p < 1e-6
    return (
        F.when(pole, F.signum(z) * 90.0).otherwise(F.degrees(lat)),
        F.when(pole, F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x))),
        F.when(pole, F.abs(z) - SEMI_MINOR).otherwise(p / F.cos(lat) - n),
    )


def _rotation(lat0: Column, lon0: Column) -> tuple[Column, Column, Column, Column]:
    return F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    x, y, z = (a - b for a, b in zip(ecef(lat, lon, alt), ecef(lat0, lon0, alt0), strict=True))
    s, c, so, co = _rotation(lat0, lon0)
    return y * co - x * so, z * c - s * (co * x + so * y), c * (co * x + so * y) + s * z


def from_enu(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    s, c, so, co = _rotation(lat0, lon0)
    x0, y0, z0 = ecef(lat0, lon0, alt0)
    out = c * u - s * n
    return geodetic(x0 + co * out - so * e, y0 + so * out + co * e, z0 + c * n + s * u)


def similarity(x: Column, y: Column, z: Column, scale: float, rotation: list[list[float]], shift: list[float]) -> list[Column]:
    """scale * R * (x, y, z) + shift."""
    return [scale * (r[0] * x + r[1] * y + r[2] * z) + t for r, t in zip(rotation, shift, strict=True)]


def unproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Camera coordinates of a pixel with depth, by the pinhole model."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def region(low: list[Column], high: list[Column], lat0: Column, lon0: Column, alt0: Column) -> list[Column]:
    """West, south, east, north in radians and the least and greatest height of a box of east, north, up."""
    a, b = from_enu(*low, lat0, lon0, alt0), from_enu(*high, lat0, lon0, alt0)
    lat, lon, alt = (list(pair) for pair in zip(a, b, strict=True))
    return [F.radians(F.least(*lon)), F.radians(F.least(*lat)), F.radians(F.greatest(*lon)), F.radians(F.greatest(*lat)), F.least(*alt), F.greatest(*alt)]
