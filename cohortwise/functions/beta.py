"""Beta distribution quantiles on numpy arrays.

In the logit t of x the density is proportional to x^a (1-x)^b, a smooth bump for every
a, b > 0 whose log is concave. The helper places Gauss-Legendre panels over the bump, adds
them up, and solves for the quantile inside the one panel that holds it. Working relative
to the peak needs no gamma function, so it stays accurate from a = 0.5 up to the claim
counts of very large cohorts.
"""

from __future__ import annotations

import numpy as np

PANELS = 32
DROP = 42.0  # exp(-42) of the peak is below double precision
ROW_CHUNK = 2048
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
_NODES = (_NODES + 1.0) / 2.0
_WEIGHTS = _WEIGHTS / 2.0


def _log_bump(u, a, total, peak):
    """Log density at logit distance u from the peak, relative to the peak."""
    return a * u - total * np.log1p(peak * np.expm1(u))


def _edge(sign, a, total, peak):
    """Distance on one side of the peak where the density has fallen by DROP."""
    reach = np.full_like(a, 1.0) / np.sqrt(total * peak * (1.0 - peak))
    while True:
        short = _log_bump(sign * reach, a, total, peak) > -DROP
        if not short.any():
            break
        reach = np.where(short, reach * 2.0, reach)
    inner, outer = np.zeros_like(reach), reach
    for _ in range(30):
        middle = (inner + outer) / 2.0
        low = _log_bump(sign * middle, a, total, peak) < -DROP
        outer, inner = np.where(low, middle, outer), np.where(low, inner, middle)
    return sign * outer


def _quantile_low_mean(p, a, b):
    """Quantiles for a <= b, as the pair (x, 1 - x)."""
    total = a + b
    peak = a / total
    left, right = _edge(-1.0, a, total, peak), _edge(1.0, a, total, peak)
    width = (right - left) / PANELS
    starts = left[:, None] + width[:, None] * np.arange(PANELS)
    grid = starts[:, :, None] + width[:, None, None] * _NODES
    shape = (slice(None), None, None)
    heights = np.exp(_log_bump(grid, a[shape], total[shape], peak[shape]))
    mass = (heights @ _WEIGHTS) * width[:, None]
    below = np.cumsum(mass, axis=1)
    target = p * below[:, -1]
    panel = np.minimum((below < target[:, None]).sum(axis=1), PANELS - 1)
    rows = np.arange(len(a))
    rest = target - (below[rows, panel] - mass[rows, panel])
    start = starts[rows, panel]
    low, high = np.zeros_like(start), width.copy()
    step = width * np.clip(rest / mass[rows, panel], 0.0, 1.0)
    for _ in range(60):
        inside = start[:, None] + step[:, None] * _NODES
        area = step * (
            np.exp(_log_bump(inside, a[:, None], total[:, None], peak[:, None])) @ _WEIGHTS
        )
        excess = area - rest
        high = np.where(excess > 0, step, high)
        low = np.where(excess <= 0, step, low)
        slope = np.exp(_log_bump(start + step, a, total, peak))
        moved = step - excess / slope
        moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2.0)
        done = np.abs(moved - step) <= 1e-15 * width
        step = moved
        if done.all():
            break
    u = start + step
    norm = 1.0 + peak * np.expm1(u)
    return peak * np.exp(u) / norm, (1.0 - peak) / norm


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p-quantile of Beta(a, b) for each pair of positive parameters."""
    a, b = np.asarray(a, dtype="float64"), np.asarray(b, dtype="float64")
    out = np.empty_like(a)
    for begin in range(0, len(a), ROW_CHUNK):
        cut = slice(begin, begin + ROW_CHUNK)
        swap = a[cut] > b[cut]
        small, large = np.where(swap, b[cut], a[cut]), np.where(swap, a[cut], b[cut])
        x, rest = _quantile_low_mean(np.where(swap, 1.0 - p, p), small, large)
        out[cut] = np.where(swap, rest, x)
    return out
