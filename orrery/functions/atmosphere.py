"""Density of the air, piecewise exponential (US Standard Atmosphere 1976)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Base altitude in km, scale height in km, density at the base in kg/m3.
LAYERS = [
    (0.0, 8.44, 1.225), (25.0, 6.49, 3.899e-2), (30.0, 6.75, 1.774e-2), (40.0, 7.58, 3.972e-3), (50.0, 8.55, 1.057e-3),
    (60.0, 7.71, 3.206e-4), (70.0, 6.59, 8.770e-5), (80.0, 5.98, 1.905e-5), (90.0, 5.57, 3.396e-6), (100.0, 5.23, 5.297e-7),
    (110.0, 5.63, 9.661e-8), (120.0, 6.34, 2.438e-8), (130.0, 7.43, 8.484e-9), (140.0, 8.82, 3.845e-9), (150.0, 11.51, 2.070e-9),
    (180.0, 15.67, 5.464e-10), (200.0, 18.29, 2.789e-10), (250.0, 22.26, 7.248e-11), (300.0, 29.74, 2.418e-11), (350.0, 37.11, 9.158e-12),
    (400.0, 45.45, 3.725e-12), (450.0, 53.64, 1.585e-12), (500.0, 60.92, 6.967e-13), (600.0, 63.14, 1.454e-13), (700.0, 58.52, 3.614e-14),
    (800.0, 53.30, 1.170e-14), (900.0, 53.55, 5.245e-15), (1000.0, 60.78, 3.019e-15),
]

_BASE, _SCALE, _DENSITY = (np.array(x) for x in zip(*LAYERS, strict=True))


def density(alt_km: Column) -> Column:
    """In kg/m3; below the ground that of the ground."""
    out = F.lit(LAYERS[0][2]) * F.exp(-alt_km / F.lit(LAYERS[0][1]))
    for base, scale, ground in LAYERS[1:]:
        out = F.when(alt_km >= base, F.lit(ground) * F.exp(-(alt_km - F.lit(base)) / F.lit(scale))).otherwise(out)
    return F.when(alt_km < 0, F.lit(LAYERS[0][2])).otherwise(out)


def density_array(alt_km: np.ndarray) -> np.ndarray:
    i = np.maximum(np.searchsorted(_BASE, alt_km, "right") - 1, 0)
    return np.where(alt_km < 0, _DENSITY[0], _DENSITY[i] * np.exp(-(alt_km - _BASE[i]) / _SCALE[i]))
