"""Geodesy as Column expressions."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
# WGS-84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = 2 * WGS84_F - WGS84_F**2


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    """Spherical law of cosines with the cosine clamped to [-1, 1]."""
    a, b, c, d = map(F.radians, map(_c, (lat1, lon1, lat2, lon2)))
    cosine = F.cos(c) * F.cos(a) * F.cos(b - d) + F.sin(c) * F.sin(a)
    return EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Well conditioned at short range; metres."""
    a, b, c, d = map(F.radians, map(_c, (lat1, lon1, lat2, lon2)))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2000 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_radians_m(lat1, lon1, lat2, lon2):
    """The same on NumPy radians."""
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2000 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def radius_box(lat: float, lon: float, km: float):
    """Smallest latitude/longitude box holding the cap of radius ``km``."""
    angle = km / EARTH_KM * (1 + 1e-9)
    dlat = math.degrees(angle)
    south, north = lat - dlat, lat + dlat
    if south <= -90 or north >= 90:
        return max(south, -90.0), -180.0, min(north, 90.0), 180.0
    dlon = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    return south, lon - dlon, north, lon + dlon


def valid_coordinates(lat, lon) -> Column:
    return _c(lat).between(-90, 90) & _c(lon).between(-180, 180)


def valid_altitude(alt) -> Column:
    return _c(alt).isNull() | _c(alt).between(-500, 10000)


def geodetic_to_ecef(lat, lon, alt) -> Column:
    phi, lam, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(alt)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(phi), 2))
    return F.struct(
        ((n + h) * F.cos(phi) * F.cos(lam)).alias("x"),
        ((n + h) * F.cos(phi) * F.sin(lam)).alias("y"),
        ((n * (1 - WGS84_E2) + h) * F.sin(phi)).alias("z"),
    )


def ecef_to_geodetic(x, y, z, rounds: int = 10, tolerance: float = 1e-12) -> Column:
    """Fixed-point latitude iteration as an in-row fold."""
    x, y, z = _c(x), _c(y), _c(z)
    p = F.sqrt(x * x + y * y)

    def prime_vertical(phi):
        return WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(phi), 2))

    def step(state, _):
        n = prime_vertical(state["phi"])
        h = p / F.cos(state["phi"]) - n
        new = F.atan2(z, p * (1 - WGS84_E2 * n / (n + h)))
        done = state["done"] | (F.abs(new - state["phi"]) < tolerance)
        return F.struct(F.when(state["done"], state["phi"]).otherwise(new).alias("phi"), done.alias("done"))

    start = F.struct(F.atan2(z, p * (1 - WGS84_E2)).alias("phi"), F.lit(False).alias("done"))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["phi"]
    return F.struct(
        F.degrees(phi).alias("latitude"), F.degrees(F.atan2(y, x)).alias("longitude"),
        (p / F.cos(phi) - prime_vertical(phi)).alias("altitude"),
    )


def enu_to_ecef(east, north, up, lat0, lon0, alt0) -> Column:
    """Local tangent-plane offset to earth-centred coordinates."""
    e, n, u = _c(east), _c(north), _c(up)
    phi, lam = F.radians(_c(lat0)), F.radians(_c(lon0))
    origin = geodetic_to_ecef(lat0, lon0, alt0)
    return F.struct(
        (origin["x"] - F.sin(lam) * e - F.sin(phi) * F.cos(lam) * n + F.cos(phi) * F.cos(lam) * u).alias("x"),
        (origin["y"] + F.cos(lam) * e - F.sin(phi) * F.sin(lam) * n + F.cos(phi) * F.sin(lam) * u).alias("y"),
        (origin["z"] + F.cos(phi) * n + F.sin(phi) * u).alias("z"),
    )


def local_metres(lat, lon, lat0, east_scale, north_scale, lon0) -> Column:
    """Offset of a point in the equirectangular plane around (lat0, lon0)."""
    return F.struct(((lon - lon0) * east_scale).alias("x"), ((lat - lat0) * north_scale).alias("y"))


def rssi_distance_m(rssi, reference: float = -45.0, exponent: float = 2.0) -> Column:
    return F.pow(F.lit(10.0), (F.lit(reference) - _c(rssi)) / (10 * exponent))


def box_centre(south, west, north, east) -> Column:
    return F.struct(((_c(south) + _c(north)) / 2).alias("latitude"), ((_c(west) + _c(east)) / 2).alias("longitude"))
