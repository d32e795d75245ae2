"""Numpy kernels over tiles: masks, fusing, resampling, packing. Used inside Arrow functions only."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

AGGREGATES = ("average", "mode", "max", "min", "med", "q1", "q3", "sum", "rms")
INTERPOLATED = {"bilinear": 1.0, "cubic": 2.0, "cubic_spline": 2.0, "lanczos": 3.0, "gauss": 1.5}
RESAMPLING = ("nearest", *INTERPOLATED, *AGGREGATES)


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unpack(data: bytes, dtype: str, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, dtype).reshape(h, w)


def missing(x: np.ndarray, nodata: float | None) -> np.ndarray:
    """Pixels without a value: NaN or nodata in floating point; nodata in integers, none where it is not set."""
    if x.dtype.kind == "f":
        m = np.isnan(x)
        return m if nodata is None or math.isnan(nodata) else m | (x == nodata)
    if nodata is None or math.isnan(nodata):
        return np.zeros(x.shape, bool)
    return x == nodata


def cast(x: np.ndarray, dtype: str) -> np.ndarray:
    """Into a pixel type; integers are held to its range, NaN becomes 0."""
    t = np.dtype(dtype)
    if t.kind == "f" or x.dtype == t:
        return x.astype(t)
    info = np.iinfo(t)
    if x.dtype.kind == "f":
        x = np.nan_to_num(x, nan=0.0, posinf=float(info.max), neginf=float(info.min))
        top = float(info.max)
        out = np.clip(np.trunc(x), float(info.min), top)
        return np.where(out >= top, info.max, out).astype(t) if t.itemsize == 8 else out.astype(t)
    return np.clip(x, max(info.min, np.iinfo(x.dtype).min), min(info.max, np.iinfo(x.dtype).max)).astype(t)


def remap_nodata(x: np.ndarray, source: float | None, target: float | None, dtype: str) -> np.ndarray:
    """Pixels without a value in terms of the source get the target's marker; all in the target's type."""
    gone = missing(x, source)
    out = cast(x, dtype)
    if target is not None and gone.any():
        out = out.copy()
        out[gone] = target
    return out


def fuse(shape: tuple[int, int], dtype: str, nodata: float | None, sources: Iterable[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """First valid pixel wins. Sources are (row, column, pixels) in order of priority. The first one is painted whole;
    later ones go where the output has no value. Without a nodata value an integer output takes the first source only.
    Pixels that no source has a value for hold the fill value."""
    fill = nodata if nodata is not None else (math.nan if np.dtype(dtype).kind == "f" else 0)
    out = np.full(shape, fill, dtype)
    for i, (y, x, pix) in enumerate(sources):
        y0, x0, y1, x1 = max(y, 0), max(x, 0), min(y + pix.shape[0], shape[0]), min(x + pix.shape[1], shape[1])
        if y1 <= y0 or x1 <= x0:
            continue
        part, view = pix[y0 - y : y1 - y, x0 - x : x1 - x], out[y0:y1, x0:x1]
        if i == 0:
            np.copyto(view, part.astype(dtype))
        else:
            np.copyto(view, part.astype(dtype), where=missing(view, nodata))
    gone = missing(out, nodata)
    out[gone] = fill
    return out


def _weights(kind: str, d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    if kind == "bilinear":
        return np.maximum(0, 1 - a)
    if kind == "cubic":
        return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0))
    if kind == "cubic_spline":
        return np.where(a < 1, (4 - 6 * a**2 + 3 * a**3) / 6, np.where(a < 2, (2 - a) ** 3 / 6, 0))
    if kind == "lanczos":
        return np.where(a < 3, np.sinc(d) * np.sinc(d / 3), 0)
    return np.where(a < 1.5, np.exp(-2 * d * d), 0)  # gauss


def sample(src: np.ndarray, px: np.ndarray, py: np.ndarray, kind: str, nodata: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Values at places given in pixels of the source (0.5 is the first centre), and which have one.

    Interpolation leaves out pixels without a value and scales the rest of the weights up to one."""
    h, w = src.shape
    if kind == "nearest":
        x, y = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        v = src[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
        return v, inside & ~missing(v, nodata)
    n = int(math.ceil(INTERPOLATED[kind]))
    x0, y0 = np.floor(px - 0.5).astype(np.int64), np.floor(py - 0.5).astype(np.int64)
    total, weight = np.zeros(px.shape), np.zeros(px.shape)
    good = ~missing(src, nodata)
    val = np.where(good, src, 0).astype(np.float64)
    for dy in range(1 - n, n + 1):
        wy = _weights(kind, py - 0.5 - (y0 + dy))
        for dx in range(1 - n, n + 1):
            x, y = x0 + dx, y0 + dy
            k = wy * _weights(kind, px - 0.5 - x)
            inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
            k = np.where(inside & good[y, x], k, 0)
            total += k * val[y, x]
            weight += k
    inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    ok = inside & (np.abs(weight) > 1e-9)
    return np.where(ok, total / np.where(ok, weight, 1), 0), ok


QUANTILES = {"med": 0.5, "q1": 0.25, "q3": 0.75}


def _reduce_rows(v: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values, NaN being none, as one: and which rows have any. Quantiles are values that occur; of equally
    frequent values the mode is the smallest."""
    has = ~np.isnan(v)
    n = has.sum(axis=1)
    ok = n > 0
    out = np.zeros(len(v))
    x, m = v[ok], n[ok]
    if not len(x):
        return out, ok
    if kind in QUANTILES:
        x = np.sort(x, axis=1)  # NaN last
        out[ok] = x[np.arange(len(x)), np.maximum(np.ceil(QUANTILES[kind] * m).astype(np.int64) - 1, 0)]
    elif kind == "mode":
        x = np.sort(x, axis=1)
        first = np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1).ravel()  # of a run of equals
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, x.size))
        size[np.isnan(x.ravel()[at])] = 0
        row = at // x.shape[1]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.maximum.reduceat(size * (x.shape[1] + 1) + (x.shape[1] - at % x.shape[1]), start)
        place = x.shape[1] - best % (x.shape[1] + 1)
        out[ok] = x[np.arange(len(x)), place]
    else:
        zero = np.where(np.isnan(x), 0.0, x)
        if kind == "sum":
            out[ok] = zero.sum(axis=1)
        elif kind == "average":
            out[ok] = zero.sum(axis=1) / m
        elif kind == "rms":
            out[ok] = np.sqrt((zero * zero).sum(axis=1) / m)
        else:
            out[ok] = np.nanmax(x, axis=1) if kind == "max" else np.nanmin(x, axis=1)
    return out, ok


def reduce_blocks(src: np.ndarray, ky: int, kx: int, kind: str, nodata: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Whole blocks of ky by kx pixels reduced to one (the last ones may be smaller), and which have a value."""
    h, w = -(-src.shape[0] // ky), -(-src.shape[1] // kx)
    pad = np.full((h * ky, w * kx), np.nan)
    pad[: src.shape[0], : src.shape[1]] = np.where(missing(src, nodata), np.nan, src.astype(np.float64))
    out, ok = _reduce_rows(pad.reshape(h, ky, w, kx).swapaxes(1, 2).reshape(h * w, ky * kx), kind)
    return out.reshape(h, w), ok.reshape(h, w)


#: Values that are gathered at once.
GATHER = 1 << 22


def reduce_at(src: np.ndarray, px: np.ndarray, py: np.ndarray, kind: str, nodata: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Values of output pixels given by their corners in source pixels, px and py of shape (h + 1, w + 1): the source
    pixels whose centres lie in the box of the corners. Output pixels are gathered in runs that bound the memory."""
    h, w = px.shape[0] - 1, px.shape[1] - 1
    cell = lambda a: np.stack([a[:-1, :-1], a[:-1, 1:], a[1:, :-1], a[1:, 1:]])
    edge = lambda a, n: np.clip(np.ceil(a - 0.5), 0, n).astype(np.int64).ravel()
    cx, cy = cell(px), cell(py)
    x0, x1 = edge(cx.min(axis=0), src.shape[1]), edge(cx.max(axis=0), src.shape[1])
    y0, y1 = edge(cy.min(axis=0), src.shape[0]), edge(cy.max(axis=0), src.shape[0])
    value = np.where(missing(src, nodata), np.nan, src.astype(np.float64)).ravel()
    value = np.append(value, np.nan)  # what lies outside of a box
    tall, wide = max(1, int((y1 - y0).max(initial=0))), max(1, int((x1 - x0).max(initial=0)))
    dy, dx = np.divmod(np.arange(tall * wide), wide)
    out, ok = np.zeros(h * w), np.zeros(h * w, bool)
    step = max(1, GATHER // (tall * wide))
    for a in range(0, h * w, step):
        part = slice(a, a + step)
        y, x = y0[part, None] + dy, x0[part, None] + dx
        at = np.where((y < y1[part, None]) & (x < x1[part, None]), y * src.shape[1] + x, len(value) - 1)
        out[part], ok[part] = _reduce_rows(value[at], kind)
    return out.reshape(h, w), ok.reshape(h, w)
