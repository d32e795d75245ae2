"""Outlines of items, a record batch at a time: corners of grids or rings of geometries, densified and reprojected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import crs as C

RINGS = "array<array<struct<x:double,y:double>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.list_(pa.list_(_POINT))
#: Edges are cut to this part of the square root of an outline's area before it goes to another projection.
STEP = 0.04
_CORNERS = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)


def ring_areas(x: np.ndarray, y: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Areas of rings that are stored one after another, without their closing points."""
    nxt = _next(start, size)
    return np.abs(np.add.reduceat(x * y[nxt] - x[nxt] * y, start)) / 2 if len(start) else np.zeros(0)


def _next(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each point's successor in its ring."""
    nxt = np.arange(1, int(size.sum()) + 1)
    nxt[start + size - 1] = start
    return nxt


def densify(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings with points added so that no edge is longer than ``STEP`` of the square root of its ring's area."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    step = np.repeat(np.sqrt(ring_areas(x, y, start, size)) * STEP, size)
    nxt = _next(start, size)
    dx, dy = x[nxt] - x, y[nxt] - y
    length = np.hypot(dx, dy)
    n = np.where(step > 0, np.ceil(length / np.where(step > 0, step, 1)), 1).clip(1).astype(np.int64)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    t = k / np.repeat(n, n)
    return np.repeat(x, n) + np.repeat(dx, n) * t, np.repeat(y, n) + np.repeat(dy, n) * t, np.add.reduceat(n, start)


def _rings_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y of all points, points a ring, rings a row of a column of rings; closing points are left out."""
    rows, x, y, size = [], [], [], []
    for rings in column.to_pylist():
        rows.append(len(rings or ()))
        for r in rings or ():
            r = r[:-1] if len(r) > 1 and r[0] == r[-1] else r
            size.append(len(r))
            x += [p["x"] for p in r]
            y += [p["y"] for p in r]
    return np.array(x, float), np.array(y, float), np.array(size, np.int64), np.array(rows, np.int64)


def outlines(grid: pa.StructArray, rings: pa.ListArray, target_crs: str, pixel_of=None) -> pa.Array:
    """For each row its outline as rings without closing points: the corners of its grid, else its rings in degrees, in
    ``target_crs`` and there in pixels if ``pixel_of`` (x, y) says how. Null where there is neither."""
    n = len(grid)
    has = np.array([v is not None for v in grid.field("h").to_pylist()], bool) & ~np.array(grid.is_null())
    where: list[np.ndarray] = []
    parts: list[tuple] = []
    crs_of = grid.field("crs").to_pylist()
    value = lambda k, at: grid.field(k).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float)
    for crs in sorted({c for c, ok in zip(crs_of, has, strict=True) if ok}):
        at = np.flatnonzero(has & np.array([c == crs for c in crs_of]))
        w, h = value("w", at)[:, None] * _CORNERS[:, 0], value("h", at)[:, None] * _CORNERS[:, 1]
        a, b, c, d, e, f = (value(k, at)[:, None] for k in "abcdef")
        parts.append((crs, (a * w + b * h + c).ravel(), (d * w + e * h + f).ravel(), np.full(len(at), 4), np.ones(len(at), np.int64)))
        where.append(at)
    rest = np.flatnonzero(~has)
    if len(rest):
        x, y, size, rows = _rings_of(rings.take(pa.array(rest)))
        keep = rows > 0
        parts.append(("EPSG:4326", x, y, size, rows[keep]))
        where.append(rest[keep])
    made, index, base = [], np.full(n, -1, np.int64), 0
    for (crs, x, y, size, rows), at in zip(parts, where, strict=True):
        if not len(at):
            continue
        if C.epsg(crs) != C.epsg(target_crs):
            x, y, size = densify(x, y, size)
            x, y = C.transform(x, y, crs, target_crs)
        if pixel_of is not None:
            x, y = pixel_of(x, y)
        points = pa.StructArray.from_arrays([pa.array(np.asarray(x, float)), pa.array(np.asarray(y, float))], fields=list(_POINT))
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), points)
        made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows)]), pa.int32()), each).cast(ARROW))
        index[at] = base + np.arange(len(at))
        base += len(at)
    if not made:
        return pa.nulls(n, ARROW)
    return pa.concat_arrays(made).take(pa.array(index, mask=index < 0))


#: Part of a pixel by which an outline may reach over a tile's edge without meeting the tile.
TOUCH = 1e-9


def tiles_met(rings: pa.ListArray, h: int, w: int, tile: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, ty and tx of each tile of an output of h by w pixels that the outline of a row meets, once. The outline is
    rings of points in pixels; touching edges do not count. As ``operators.binning.bin_items`` does for columns."""
    ny, nx = -(-h // tile[0]), -(-w // tile[1])
    rows, tys, txs = [], [], []
    points = rings.flatten().flatten()
    px, py = points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)
    ends = rings.flatten().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(ends)])
    at = 0
    for row, n in enumerate(rings.value_lengths().to_pylist()):
        met = []
        for k in range(at, at + (n or 0)):
            x, y = px[ends[k] : ends[k + 1]], py[ends[k] : ends[k + 1]]
            if len(x) and np.isfinite(x).all() and np.isfinite(y).all():
                met.append(_ring_tiles(x, y, h, w, tile, ny, nx))
        at += n or 0
        if met:
            cells = met[0] if len(met) == 1 else np.unique(np.concatenate(met))
            rows.append(np.full(len(cells), row))
            tys.append(cells // nx)
            txs.append(cells % nx)
    join = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
    return join(rows), join(tys), join(txs)


def _ring_tiles(x: np.ndarray, y: np.ndarray, h: int, w: int, tile: tuple[int, int], ny: int, nx: int) -> np.ndarray:
    lo = lambda v, size: max(0, int(np.floor(v.min() / size + TOUCH)))
    hi = lambda v, size, n: min(n - 1, int(np.ceil(v.max() / size - TOUCH)) - 1)
    a, b, c, d = lo(y, tile[0]), hi(y, tile[0], ny), lo(x, tile[1]), hi(x, tile[1], nx)
    if a > b or c > d:
        return np.zeros(0, np.int64)
    ty, tx = (v.ravel() for v in np.meshgrid(np.arange(a, b + 1), np.arange(c, d + 1), indexing="ij"))
    x1, y1 = np.roll(x, -1), np.roll(y, -1)
    if len(x) != 4 or not ((x == x1) | (y == y1)).all():  # not a rectangle along the axes: the separating axes of its edges
        cx = np.stack([tx * tile[1], tx * tile[1], np.minimum(w, (tx + 1) * tile[1]), np.minimum(w, (tx + 1) * tile[1])])
        cy = np.stack([ty * tile[0], np.minimum(h, (ty + 1) * tile[0]), ty * tile[0], np.minimum(h, (ty + 1) * tile[0])])
        apart = np.zeros(len(tx), bool)
        for p, q, r, s in zip(x.tolist(), y.tolist(), x1.tolist(), y1.tolist(), strict=True):
            length = abs(r - p) + abs(s - q)
            if length > 0:
                own, box = (r - p) * (y - q) - (s - q) * (x - p), (r - p) * (cy - q) - (s - q) * (cx - p)
                tol = length * 1e-7
                apart |= ((own.min() >= -tol) & (box.max(axis=0) <= tol)) | ((own.max() <= tol) & (box.min(axis=0) >= -tol))
        ty, tx = ty[~apart], tx[~apart]
    return ty * nx + tx
