"""NumPy kernels over blocks of a frame, whose cost does not depend on the radius."""

from __future__ import annotations

import numpy as np


def running(a: np.ndarray, radius: int, axis: int, pick=np.maximum) -> np.ndarray:
    """``pick`` over the 2 * radius + 1 values around each along ``axis``; values beyond the ends do not count.

    Running extremes from both ends of pieces as long as the window: three comparisons a value, whatever the radius.
    """
    a, size = np.moveaxis(a, axis, -1), 2 * radius + 1
    nothing = -np.inf if pick is np.maximum else np.inf
    n = a.shape[-1]
    room = -(-(n + 2 * radius) // size) * size
    wide = np.full((*a.shape[:-1], room), nothing)
    wide[..., radius : radius + n] = a
    pieces = wide.reshape(*a.shape[:-1], room // size, size)
    ahead = pick.accumulate(pieces, axis=-1).reshape(wide.shape)
    back = pick.accumulate(pieces[..., ::-1], axis=-1)[..., ::-1].reshape(wide.shape)
    return np.moveaxis(pick(back[..., :n], ahead[..., size - 1 : size - 1 + n]), -1, axis)


def ellipse(radius: int) -> list[int]:
    """Half the width of each row of a filled ellipse of ``2 * radius + 1`` rows and columns."""
    return [round(radius * np.sqrt(max(radius * radius - d * d, 0)) / radius) if radius else 0 for d in range(-radius, radius + 1)]


def over_ellipse(a: np.ndarray, radius: int, pick=np.maximum) -> np.ndarray:
    """``pick`` over an ellipse around each value: its rows are runs, and rows of one width share one running extreme."""
    out = np.full(a.shape, -np.inf if pick is np.maximum else np.inf)
    runs: dict[int, np.ndarray] = {}
    for d, half in zip(range(-radius, radius + 1), ellipse(radius), strict=True):
        if half not in runs:
            runs[half] = running(a, half, 1, pick)
        to, of = slice(max(-d, 0), a.shape[0] - max(d, 0)), slice(max(d, 0), a.shape[0] + min(d, 0))
        if to.start < to.stop:
            out[to] = pick(out[to], runs[half][of])
    return out


def summed(a: np.ndarray) -> np.ndarray:
    """The summed-area table, with a row and a column of zeros before it."""
    return np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def window_means(a: np.ndarray, radius: int) -> np.ndarray:
    """The mean of the square around each value, as far as it is inside: four reads of the summed-area table."""
    table, (h, w) = summed(a), a.shape
    y, x = np.arange(h), np.arange(w)
    top, low, left, right = np.maximum(y - radius, 0), np.minimum(y + radius + 1, h), np.maximum(x - radius, 0), np.minimum(x + radius + 1, w)
    total = table[np.ix_(low, right)] - table[np.ix_(top, right)] - table[np.ix_(low, left)] + table[np.ix_(top, left)]
    return total / np.outer(low - top, right - left)


def bell(sigma: float, radius: int) -> np.ndarray:
    """Weights of a Gaussian, their sum one."""
    weights = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return weights / weights.sum()


def blurred(a: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """A Gaussian over rows, then columns; values beyond the ends are mirrored without repeating the last."""
    weights = bell(sigma, radius)
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        wide = np.pad(a, pad, mode="reflect")
        a = sum(w * np.take(wide, range(k, k + a.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return a


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences down and along: central inside, one-sided at the ends."""
    return np.gradient(a, axis=0), np.gradient(a, axis=1)
