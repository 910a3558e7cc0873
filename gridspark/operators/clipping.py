"""Common areas of the cells of two grids whose axes do not align, such as a rotated and a regular one.

A cell is the quadrilateral of great circles between its corners.  Both grids are laid into cubes of space that are at least as
large as a cell, so cells that touch share a cube, wherever on the globe they lie; an equi-join on the cube finds them.  Each pair
is then projected around the middle of its target cell, where great circles are straight lines, and clipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid

CUBE = ("bx", "by", "bz")
#: Common areas below this share of the target cell are rounding, not contact.
LEAST_SHARE = 1e-12


def to_space(grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of points given by their coordinates in the system of the grid."""
    lon, lat = np.radians(x), np.radians(y)
    own = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)
    if grid.pole is None:
        return own
    top, east = np.radians(grid.pole[0]), np.radians(grid.pole[1])
    pole = np.array([np.cos(top) * np.cos(east), np.cos(top) * np.sin(east), np.sin(top)])
    zero = np.array([-np.sin(top) * np.cos(east), -np.sin(top) * np.sin(east), np.cos(top)])
    return own @ np.stack([zero, np.cross(pole, zero), pole])


def corners(grid: Grid, cell: np.ndarray) -> np.ndarray:
    """The four corners of cells, numbered line by line, in order around them."""
    iy, ix = np.divmod(cell, grid.nx)
    around = np.array([[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]])
    x = grid.x0 + (ix[:, None] + around[:, 0]) * grid.dx
    y = np.clip(grid.y0 + (iy[:, None] + around[:, 1]) * grid.dy, -90.0, 90.0)
    return to_space(grid, x, y)


def _boxes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in space of the cells, with what they bulge between their corners."""
    reach = np.maximum(np.linalg.norm(at - np.roll(at, 1, axis=1), axis=2).max(axis=1),
                       np.linalg.norm(at[:, :2] - at[:, 2:], axis=2).max(axis=1))
    bulge = (1.0 - np.sqrt(np.maximum(0.0, 1.0 - reach**2 / 4)) + 1e-12)[:, None]
    return at.min(axis=1) - bulge, at.max(axis=1) + bulge


def _in_cubes(spark: SparkSession, grid: Grid, size: float, name: str) -> DataFrame:
    """Every cell in each cube that its bounds reach, with the lowest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            low, high = (np.floor(b / size).astype(np.int32) for b in _boxes(corners(grid, cell)))
            span = high - low + 1
            n = span.prod(axis=1)
            row = np.repeat(np.arange(len(cell)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            offset = np.stack([k // (span[row, 1] * span[row, 2]), k // span[row, 2] % span[row, 1], k % span[row, 2]], axis=1)
            at = (low[row] + offset).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {name: pa.array(cell[row])} | {c: pa.array(at[:, i]) for i, c in enumerate(CUBE)}
                | {f"{name}_{c}": pa.array(low[row, i]) for i, c in enumerate(CUBE)})

    schema = f"{name} bigint, " + ", ".join(f"{c} int" for c in (*CUBE, *[f"{name}_{c}" for c in CUBE]))
    return spark.range(grid.nx * grid.ny).mapInArrow(run, schema)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _counter_clockwise(flat: np.ndarray) -> np.ndarray:
    turned = _cross(flat, np.roll(flat, -1, axis=1)).sum(axis=1) < 0
    return np.where(turned[:, None, None], flat[:, ::-1], flat)


def _clip(flat: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of polygons with ``n`` corners lies to the left of the lines from ``a`` to ``b``."""
    rows, width = np.arange(len(flat)), flat.shape[1]
    side = _cross((b - a)[:, None], flat - a[:, None])
    out, m = np.zeros((len(flat), width + 1, 2)), np.zeros(len(flat), np.int64)
    for i in range(width):
        last = (i - 1) % np.maximum(n, 1)
        here, before = side[:, i], side[rows, last]
        cut = (i < n) & ((here >= 0) != (before >= 0))
        share = before[cut] / (before[cut] - here[cut])
        start = flat[rows[cut], last[cut]]
        out[rows[cut], m[cut]] = start + share[:, None] * (flat[cut, i] - start)
        m[cut] += 1
        kept = (i < n) & (here >= 0)
        out[rows[kept], m[kept]] = flat[kept, i]
        m[kept] += 1
    return out, m


def _area(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Areas on the unit sphere of projected convex polygons, as triangles from their first corners."""
    space = np.concatenate([flat, np.ones((*flat.shape[:2], 1))], axis=2)
    space /= np.linalg.norm(space, axis=2, keepdims=True)
    scale = 1.0 / np.sqrt(1.0 + (flat**2).sum(axis=2))
    total = np.zeros(len(flat))
    for i in range(1, flat.shape[1] - 1):
        a, b, c = space[:, 0], space[:, i], space[:, i + 1]
        volume = _cross(flat[:, i] - flat[:, 0], flat[:, i + 1] - flat[:, 0]) * scale[:, 0] * scale[:, i] * scale[:, i + 1]
        spread = 1.0 + (a * b).sum(axis=1) + (b * c).sum(axis=1) + (c * a).sum(axis=1)
        total += np.where(i + 1 < n, 2.0 * np.arctan2(volume, spread), 0.0)
    return total


def common_areas(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common area of each pair of cells given by their corners, and the area of the target cell."""
    middle = target.sum(axis=1)
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    axis = np.eye(3)[np.abs(middle).argmin(axis=1)]
    u = np.cross(axis, middle)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.cross(middle, u)
    depth = [np.einsum("nkc,nc->nk", p, middle) for p in (source, target)]
    near = (depth[0] > 0).all(axis=1)  # a source cell on the far side has no place in the projection
    flat = [np.stack([np.einsum("nkc,nc->nk", p, w) / np.where(near[:, None], d, 1.0) for w in (u, v)], axis=2)
            for p, d in zip((source, target), depth)]
    part, window = _counter_clockwise(flat[0]), _counter_clockwise(flat[1])
    n = np.where(near, 4, 0)
    for i in range(4):
        part, n = _clip(part, n, window[:, i], window[:, (i + 1) % 4])
    return _area(part, n), _area(window, np.full(len(window), 4))


def clipped_weights(spark: SparkSession, src: Grid, dst: Grid) -> DataFrame:
    """``(iy, ix)`` of the source, ``(ty, tx)`` of the target and their common area ``w`` on the unit sphere.

    Cells wider than 60 degrees have no projection that is safe and are an error.
    """
    widest = max(abs(g) for grid in (src, dst) for g in (grid.dx, grid.dy))
    if widest > 60:
        raise ValueError(f"cells of {widest} degrees are too wide for regridding between axes that do not align")
    size = 1.5 * math.radians(widest)
    pairs = _in_cubes(spark, src, size, "s").join(_in_cubes(spark, dst, size, "t"), list(CUBE))
    # a pair that shares several cubes is taken in the lowest one only
    lowest = [F.col(c) == F.greatest(f"s_{c}", f"t_{c}") for c in CUBE]
    pairs = pairs.where(lowest[0] & lowest[1] & lowest[2]).select("s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (batch.column(i).to_numpy() for i in (0, 1))
            common, whole = common_areas(corners(src, s), corners(dst, t))
            keep = common > LEAST_SHARE * whole
            (iy, ix), (ty, tx) = np.divmod(s[keep], src.nx), np.divmod(t[keep], dst.nx)
            yield pa.RecordBatch.from_pydict({"iy": iy.astype(np.int32), "ix": ix.astype(np.int32), "ty": ty.astype(np.int32),
                                              "tx": tx.astype(np.int32), "w": common[keep]})

    return pairs.mapInArrow(run, "iy int, ix int, ty int, tx int, w double")
