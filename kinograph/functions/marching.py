"""A hole filled from its rim inwards: a front, ordered by its distance from the rim, that carries levels and their slopes along."""

from __future__ import annotations

import heapq

import numpy as np

_KNOWN, _FRONT, _HOLE = 0, 1, 2
_AROUND = ((-1, 0), (0, -1), (1, 0), (0, 1))


def _arrival(time: np.ndarray, state: np.ndarray, y: int, x: int) -> float:
    """When the front gets to a pixel, from what it has reached beside it: distance grows by one a pixel, straight or aslant."""
    h, w = time.shape

    def near(pairs) -> float:
        return min((time[p] for p in pairs if 0 <= p[0] < h and 0 <= p[1] < w and state[p] != _HOLE), default=np.inf)

    a, b = sorted((near(((y - 1, x), (y + 1, x))), near(((y, x - 1), (y, x + 1)))))
    return a + 1 if b - a >= 1 else (a + b + np.sqrt(2 - (a - b) ** 2)) / 2


def march(hole: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Distances of the pixels of ``hole`` from its rim, and the order in which the front reaches them; ties by row and column."""
    time, state, front, order = np.zeros(hole.shape), np.where(hole, _HOLE, _KNOWN), [], []

    def offer(y: int, x: int) -> None:
        for dy, dx in _AROUND:
            p = y + dy, x + dx
            if 0 <= p[0] < hole.shape[0] and 0 <= p[1] < hole.shape[1] and hole[p] and state[p] != _KNOWN:
                due = _arrival(time, state, *p)
                if state[p] == _HOLE or due < time[p]:
                    time[p], state[p] = due, _FRONT
                    heapq.heappush(front, (due, *p))

    for y, x in zip(*np.nonzero(~hole), strict=True):
        offer(int(y), int(x))
    while front:
        due, y, x = heapq.heappop(front)
        if state[y, x] == _FRONT and due == time[y, x]:
            state[y, x] = _KNOWN
            order.append((y, x))
            offer(y, x)
    return time, order


def _slope(a: np.ndarray, known: np.ndarray, y: int, x: int, axis: int) -> float:
    """The slope at a pixel from the neighbours that are known: central where both are, else one-sided, else none."""
    step = (1, 0) if axis == 0 else (0, 1)
    ends = []
    for sign in (1, -1):
        p = y + sign * step[0], x + sign * step[1]
        ends.append(p if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and known[p] else None)
    high, low = ends
    if high and low:
        return (a[high] - a[low]) / 2
    return a[high] - a[y, x] if high else a[y, x] - a[low] if low else 0.0


def fill(values: np.ndarray, hole: np.ndarray, radius: int) -> np.ndarray:
    """``values`` with the pixels of ``hole`` made from what is known within ``radius``, in the front's order.

    A known pixel counts by how much it lies along the front's direction, by its squared distance, and by how near its own distance from
    the rim is; it gives its level, carried on along its slope. Without anything known the values stay.
    """
    if hole.all() or not hole.any():
        return values.copy()
    time, order = march(hole)
    out, known = values.astype(np.float64).copy(), ~hole
    span = range(-radius, radius + 1)
    circle = [(dy, dx) for dy in span for dx in span if 0 < dy * dy + dx * dx <= radius * radius]
    everywhere = np.ones(hole.shape, bool)
    for y, x in order:
        way = _slope(time, everywhere, y, x, 0), _slope(time, everywhere, y, x, 1)
        top = bottom = 0.0
        for dy, dx in circle:
            q = y + dy, x + dx
            if not (0 <= q[0] < hole.shape[0] and 0 <= q[1] < hole.shape[1] and known[q]):
                continue
            far = dy * dy + dx * dx
            direction = max(abs(way[0] * dy + way[1] * dx) / np.sqrt(far), 1e-6)
            weight = direction / far / (1 + abs(time[q] - time[y, x]))
            carried = out[q] - _slope(out, known, *q, 0) * dy - _slope(out, known, *q, 1) * dx
            top, bottom = top + weight * carried, bottom + weight
        out[y, x] = top / bottom
        known[y, x] = True
    return out
