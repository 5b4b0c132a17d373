"""Angular distance from a point to a sky tile it lies outside of.

Runs inside tasks on Arrow batches, for the few rows near a tile edge. The edge
curves of polar tiles have no closed-form distance, so each of the four edges
is searched on a grid that closes in on its nearest point. Whether a distance is
within a reach is mostly told by fixed points of the border, which bound it from
both sides; only the rest is searched.
"""

from __future__ import annotations

import numpy as np

# Fixed value: a way along the unit face is at most this much longer on the sky (true bound 1.521).
MAX_STRETCH = 1.55
# Steps between the fixed points of an edge, and tiles whose points are held at once.
EDGE_STEPS, TILES_AT_ONCE = 32, 512


def face_to_vector(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of points (x, y in [0, 1]) of the twelve base faces."""
    row = face // 4
    start = np.where(row == 1, 2 * (face % 4), 2 * (face % 4) + 1)
    ring = 2 + row - x - y
    north, south = ring < 1, ring > 3
    size = np.where(north, ring, np.where(south, 4 - ring, 1.0))
    cap = size * size / 3
    z = np.where(north, 1 - cap, np.where(south, cap - 1, (2 - ring) * 2 / 3))
    # In the caps 1 - |z| is known exactly; that keeps full precision next to the poles.
    sin_theta = np.where(north | south, np.sqrt(cap * (2 - cap)), np.sqrt((1 - z) * (1 + z)))
    phi = np.pi / 4 * (start + np.divide(x - y, size, out=np.zeros_like(z), where=size > 0))
    return np.stack([sin_theta * np.cos(phi), sin_theta * np.sin(phi), z])


def distance_to_tile(
    ra: np.ndarray, dec: np.ndarray, order: np.ndarray, x: np.ndarray, y: np.ndarray, face: np.ndarray
) -> np.ndarray:
    """Radians from (ra, dec) in degrees to the border of tile (face, x, y) of an order."""
    lon, lat = np.radians(ra), np.radians(dec)
    point = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])[:, :, None]
    side = 1.0 / (1 << order.astype(np.int64))
    best = np.full(len(ra), np.inf)
    for axis in (0, 1):
        for end in (0, 1):
            low, high = np.zeros(len(ra)), np.ones(len(ra))
            for step in range(9):
                grid = low[:, None] + (high - low)[:, None] * np.linspace(0.0, 1.0, 17 if step == 0 else 9)
                along = [(x[:, None] + grid), (y[:, None] + grid)]
                along[axis] = np.broadcast_to(([x, y][axis] + end)[:, None], grid.shape)
                edge = face_to_vector(
                    np.broadcast_to(face[:, None], grid.shape), along[0] * side[:, None], along[1] * side[:, None]
                )
                chord = np.sqrt(((edge - point) ** 2).sum(axis=0))
                at = chord.argmin(axis=1)
                rows = np.arange(len(ra))
                best = np.minimum(best, chord[rows, at])
                width = grid[:, 1] - grid[:, 0]
                centre = grid[rows, at]
                low, high = np.maximum(centre - width, 0.0), np.minimum(centre + width, 1.0)
    return 2 * np.arcsin(np.minimum(best / 2, 1.0))


def border_points(order: np.ndarray, x: np.ndarray, y: np.ndarray, face: np.ndarray) -> np.ndarray:
    """Unit vectors (tile, 3, point) of points around each tile, EDGE_STEPS an edge."""
    step, zero = np.arange(EDGE_STEPS) / EDGE_STEPS, np.zeros(EDGE_STEPS)
    right = np.concatenate([step, zero + 1, 1 - step, zero])
    up = np.concatenate([zero, step, zero + 1, 1 - step])
    side = (1.0 / (1 << order.astype(np.int64)))[:, None]
    points = face_to_vector(
        np.broadcast_to(face[:, None], (len(face), len(up))), (x[:, None] + right) * side, (y[:, None] + up) * side
    )
    return points.transpose(1, 0, 2)


def within_reach(
    ra: np.ndarray, dec: np.ndarray, order: np.ndarray, x: np.ndarray, y: np.ndarray, face: np.ndarray, reach: float
) -> np.ndarray:
    """Whether ``distance_to_tile`` is at most ``reach`` (radians).

    The nearest fixed point of the border is at least as far as the border, and at most half
    a step farther. One product a tile gives it for all its rows; what the two bounds leave
    open is measured.
    """
    n = len(ra)
    if n == 0:
        return np.zeros(0, dtype=bool)
    lon, lat = np.radians(ra), np.radians(dec)
    point = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    at = np.lexsort((face, y, x, order))
    keys = np.stack([order, x, y, face])[:, at]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    after = np.append(first[1:], n)
    cosine = np.empty(n)
    for low in range(0, len(first), TILES_AT_ONCE):
        some = slice(low, low + TILES_AT_ONCE)
        for border, begin, end in zip(border_points(*keys[:, first[some]]), first[some], after[some]):
            rows = at[begin:end]
            cosine[rows] = (point[rows] @ border).max(axis=1)
    # Squares of chords from cosines are good to some 1e-15; what is nearer to a bound is measured.
    square, limit = 2 - 2 * cosine, 2 * np.sin(reach / 2)
    slack = MAX_STRETCH / (1 << order.astype(np.int64)) / (2 * EDGE_STEPS)
    found = square <= limit * limit - 1e-14
    rest = np.flatnonzero(~found & ~(square > (limit + slack) ** 2 + 1e-14))
    found[rest] = distance_to_tile(*(v[rest] for v in (ra, dec, order, x, y, face))) <= reach
    return found
