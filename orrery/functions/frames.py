"""Frames and angles as columns.  Positions are kilometres, a vector is three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

# WGS-84, and the Earth's rate of rotation in radians a second.
EARTH_KM = 6378.137
FLATTENING = 1.0 / 298.257223563
E2 = 2 * FLATTENING - FLATTENING**2
EARTH_RATE = 7.2921150e-5


def vector(name: str) -> Vector:
    """The columns name_x, name_y, name_z."""
    return F.col(f"{name}_x"), F.col(f"{name}_y"), F.col(f"{name}_z")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    """Distance of positions, or relative speed of velocities."""
    return norm(minus(a, b))


def _asin(x: Column) -> Column:
    """Rounding must not carry the sine beyond 1, where it has no angle."""
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def rotate(r: Vector, angle: Column) -> Vector:
    """Inertial to Earth-fixed, by the sidereal time."""
    c, s = F.cos(angle), F.sin(angle)
    return r[0] * c + r[1] * s, r[1] * c - r[0] * s, r[2]


def sub_point(r: Vector, gmst: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees under an inertial position, on a sphere."""
    x, y, z = rotate(r, gmst)
    return F.degrees(_asin(z / norm((x, y, z)))), F.degrees(F.atan2(y, x))


def geodetic(lat_deg: Column, lon_deg: Column, alt_m: Column) -> Vector:
    """Earth-fixed position of a place on the ellipsoid."""
    lat, lon, alt = F.radians(lat_deg), F.radians(lon_deg), alt_m / F.lit(1000.0)
    n = F.lit(EARTH_KM) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(lat) * F.sin(lat))
    return (n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * F.lit(1.0 - E2) + alt) * F.sin(lat)


def look(sat: Vector, site: Vector, lat_deg: Column, lon_deg: Column) -> tuple[Column, Column, Column]:
    """Azimuth and elevation in degrees, and slant range, from a site to an Earth-fixed position."""
    d = minus(sat, site)
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    east = F.cos(lon) * d[1] - F.sin(lon) * d[0]
    north = F.cos(lat) * d[2] - F.sin(lat) * (F.cos(lon) * d[0] + F.sin(lon) * d[1])
    up = F.cos(lat) * (F.cos(lon) * d[0] + F.sin(lon) * d[1]) + F.sin(lat) * d[2]
    slant = norm(d)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.when(slant > 0, F.degrees(_asin(up / slant))).otherwise(F.lit(0.0)), slant


def track_bearing(r: Vector, v: Vector, gmst: Column) -> Column:
    """Direction of the ground track, radians clockwise from north, against the turning Earth."""
    p, w = rotate(r, gmst), rotate(v, gmst)
    w = (w[0] + F.lit(EARTH_RATE) * p[1], w[1] - F.lit(EARTH_RATE) * p[0], w[2])
    lat, lon = _asin(p[2] / norm(p)), F.atan2(p[1], p[0])
    east = F.cos(lon) * w[1] - F.sin(lon) * w[0]
    north = F.cos(lat) * w[2] - F.sin(lat) * (F.cos(lon) * w[0] + F.sin(lon) * w[1])
    return F.atan2(east, north)


def radial_along_cross(position: Vector, velocity: Vector, delta: Vector) -> Vector:
    """A difference in the radial, along-track and cross-track directions of a reference orbit."""
    normal = cross(position, velocity)
    r, n = norm(position), norm(normal)
    radial = tuple(x / r for x in position)
    out = tuple(x / n for x in normal)
    return dot(delta, radial), dot(delta, cross(out, radial)), dot(delta, out)


def mean_altitude(apoapsis: Column, periapsis: Column) -> Column:
    return (apoapsis + periapsis) / 2
