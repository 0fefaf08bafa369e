"""The geometry of `functions.frames` over arrays, for use within a propagation."""

from __future__ import annotations

import numpy as np

from ..functions.frames import E2, EARTH_KM
from .sgp4 import sidereal


def site(lat_deg: float, lon_deg: float, alt_m: float) -> np.ndarray:
    lat, lon, alt = np.radians(lat_deg), np.radians(lon_deg), alt_m / 1000.0
    n = EARTH_KM / np.sqrt(1 - E2 * np.sin(lat) ** 2)
    return np.array([(n + alt) * np.cos(lat) * np.cos(lon), (n + alt) * np.cos(lat) * np.sin(lon), (n * (1 - E2) + alt) * np.sin(lat)])


def fixed(r: np.ndarray, jd: np.ndarray, fr: np.ndarray) -> np.ndarray:
    """Inertial (..., 3) to Earth-fixed."""
    g = sidereal(jd + fr)
    c, s = np.cos(g), np.sin(g)
    return np.stack([r[..., 0] * c + r[..., 1] * s, r[..., 1] * c - r[..., 0] * s, r[..., 2]], -1)


def look(sat: np.ndarray, place: np.ndarray, lat_deg: float, lon_deg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Azimuth, elevation (degrees) and slant range (km)."""
    d = sat - place
    lat, lon = np.radians(lat_deg), np.radians(lon_deg)
    flat = np.cos(lon) * d[..., 0] + np.sin(lon) * d[..., 1]
    east = np.cos(lon) * d[..., 1] - np.sin(lon) * d[..., 0]
    north = np.cos(lat) * d[..., 2] - np.sin(lat) * flat
    up = np.cos(lat) * flat + np.sin(lat) * d[..., 2]
    slant = np.sqrt((d * d).sum(-1))
    with np.errstate(invalid="ignore", divide="ignore"):
        el = np.where(slant > 0, np.degrees(np.arcsin(np.clip(up / np.where(slant > 0, slant, 1), -1, 1))), 0.0)
    return np.degrees(np.arctan2(east, north)) % 360, el, slant


def runs(flag: np.ndarray) -> list[tuple[int, int]]:
    """[first, after last) of each run of true."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
