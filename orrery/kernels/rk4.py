"""Numerical propagation with the Earth's flattening and drag, many states at once.

Fourth-order Runge-Kutta; the step of a state is a minute, or a tenth of its
time if that is less.  States are rows (x, y, z in km, vx, vy, vz in km/s).
"""

from __future__ import annotations

import numpy as np

from ..functions.atmosphere import density_array

# Gravity of the propagator.
MU, RADIUS, J2 = 398600.4418, 6378.137, 1.08262668e-3


def slope(state: np.ndarray, drag: np.ndarray, physical: bool = False) -> np.ndarray:
    """Time derivative.  drag: 1/m; physical: scale the drag term by the density that B* refers to."""
    r, v = state[:, :3], state[:, 3:]
    distance = np.sqrt((r * r).sum(1))[:, None]
    gravity = -MU / distance**3 * r
    z = (r[:, 2:] / distance) ** 2
    flat = 1.5 * J2 * MU * RADIUS**2 / distance**5 * r * (5 * z - np.array([1.0, 1.0, 3.0]))
    speed = np.sqrt((v * v).sum(1))[:, None]
    rho = density_array(distance[:, 0] - RADIUS)[:, None]
    if physical:
        # B* = rho0 * ballistic coefficient / 2 with rho0 = 0.1570 kg/m2 per Earth radius.
        air = -(2 * drag * RADIUS * 1e3 / 0.1570) / 2 * rho * (speed * 1000) ** 2 * v / speed / 1000
    else:
        air = -drag * rho * (speed * 1000) ** 2 * v / speed / 1000
    return np.concatenate([v, gravity + flat + air], axis=1)


def propagate(state: np.ndarray, drag: np.ndarray, seconds: np.ndarray, physical: bool = False) -> np.ndarray:
    """Each state after its own time (0 or more; negative times leave it where it is)."""
    out, drag = state.astype(float).copy(), np.asarray(drag, float)[:, None]
    seconds = np.asarray(seconds, float)
    step = np.where(seconds > 0, np.minimum(60.0, seconds / 10.0), 60.0)
    order = np.argsort(-np.ceil(np.maximum(seconds, 0) / step), kind="stable")  # those with most steps first
    gone = np.zeros(len(out))
    active = order[seconds[order] > 0]
    while len(active):
        h = np.minimum(step[active], seconds[active] - gone[active])[:, None]
        s, d = out[active], drag[active]
        k1 = slope(s, d, physical)
        k2 = slope(s + h / 2 * k1, d, physical)
        k3 = slope(s + h / 2 * k2, d, physical)
        k4 = slope(s + h * k3, d, physical)
        out[active] = s + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        gone[active] += h[:, 0]
        active = active[gone[active] < seconds[active]]
    return out
