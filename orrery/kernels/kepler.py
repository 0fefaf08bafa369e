"""Motion on a fixed ellipse."""

from __future__ import annotations

import numpy as np

MU = 398600.4418


def anomaly(mean: np.ndarray, eccentricity: np.ndarray) -> np.ndarray:
    """Eccentric anomaly of a mean anomaly (radians), by Newton's method."""
    e = mean + eccentricity * np.sin(mean)
    for _ in range(50):
        move = (e - eccentricity * np.sin(e) - mean) / (1 - eccentricity * np.cos(e))
        e = e - move
        if np.all(np.abs(move) < 1e-14):
            break
    return e


def states(a_km, eccentricity, inclination, node, perigee, mean, seconds, mu: float = MU) -> np.ndarray:
    """States (..., 6) after some seconds; angles in radians, arrays of one shape."""
    a, e, i, o, w, m, t = np.broadcast_arrays(*map(np.asarray, (a_km, eccentricity, inclination, node, perigee, mean, seconds)))
    n = np.sqrt(mu / a**3)
    big = anomaly(m + n * t, e)
    x, y = a * (np.cos(big) - e), a * np.sqrt(1 - e**2) * np.sin(big)
    rate = n / (1 - e * np.cos(big))
    vx, vy = -a * np.sin(big) * rate, a * np.sqrt(1 - e**2) * np.cos(big) * rate
    co, so, cw, sw, ci, si = np.cos(o), np.sin(o), np.cos(w), np.sin(w), np.cos(i), np.sin(i)
    p = np.stack([co * cw - so * sw * ci, so * cw + co * sw * ci, sw * si], -1)
    q = np.stack([-co * sw - so * cw * ci, -so * sw + co * cw * ci, cw * si], -1)
    return np.concatenate([x[..., None] * p + y[..., None] * q, vx[..., None] * p + vy[..., None] * q], -1)
