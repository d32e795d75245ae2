"""One source on one output tile: which level, which window, pasted or resampled. Runs inside Arrow functions.

A reader has two methods. ``describe(uri, band)`` tells (grid or None, (rows, columns), nodata or None, factors of its
overviews) without reading pixels; ``read(uri, band, level, window)`` gives the pixels of a window (y0, y1, x0, x1) of the
image (level None) or of an overview. A plain function ``(uri, band, level) -> (pixels, grid, nodata, overviews)`` is taken
as a reader of whole images.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np

from ..functions import crs as C
from ..functions import kernels
from ..functions.scalar import fill_of, is_float
from ..operators.grids import Grid

#: Output pixels that are resampled at once.
RUN = 1 << 20


class Whole:
    """A function that reads whole images, as a reader; the last image is kept, as the next tile may want it too."""

    def __init__(self, f: Callable):
        self.f, self._last = f, (None, None)

    def __getstate__(self):
        return {"f": self.f, "_last": (None, None)}

    def _get(self, *key):
        if self._last[0] != key:
            self._last = (key, self.f(*key))
        return self._last[1]

    def describe(self, uri: str, band: int):
        pix, grid, nodata, overviews = self._get(uri, band, None)
        return grid, pix.shape, nodata, list(overviews or [])

    def level_grid(self, uri: str, band: int, level: int) -> Grid | None:
        return self._get(uri, band, level)[1]

    def read(self, uri: str, band: int, level: int | None, window):
        y0, y1, x0, x1 = window
        return self._get(uri, band, level)[0][y0:y1, x0:x1]


def as_reader(reader):
    return reader if hasattr(reader, "describe") else Whole(reader)


def source_pixel(source: Grid, out: Grid, px, py):
    """Pixel coordinates of an output as those of a source."""
    x, y = out.xy(px, py)
    if C.epsg(source.crs) != C.epsg(out.crs):
        x, y = C.transform(np.asarray(x, float), np.asarray(y, float), out.crs, source.crs)
    return source.pixel(x, y)


def meeting(source: Grid, out: Grid, pad: int = 2) -> tuple[int, int, int, int] | None:
    """The window (y0, y1, x0, x1) of an output outside of which a source has no pixels; None if they do not meet."""
    t = np.linspace(0, 1, 22)
    edge = np.concatenate([np.column_stack(p) for p in ((t, 0 * t), (0 * t + 1, t), (t, 0 * t + 1), (0 * t, t))])
    x, y = source_pixel(out, source, edge[:, 0] * source.w, edge[:, 1] * source.h)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return 0, out.h, 0, out.w
    x0, x1, y0, y1 = max(0, math.floor(x.min()) - pad), min(out.w, math.ceil(x.max()) + pad), max(0, math.floor(y.min()) - pad), min(out.h, math.ceil(y.max()) + pad)
    return (y0, y1, x0, x1) if x0 < x1 and y0 < y1 else None


def level_grid(reader, uri: str, band: int, level: int | None, g: Grid, factors: list[int]) -> Grid:
    if level is None:
        return g
    own = getattr(reader, "level_grid", None)
    if own is not None and (got := own(uri, band, level)) is not None:
        return got
    shape = getattr(reader, "level_shape", None)
    h, w = shape(uri, level) if shape else (max(1, math.ceil(g.h / factors[level])), max(1, math.ceil(g.w / factors[level])))
    sy, sx = g.h / h, g.w / w
    return replace(g, h=h, w=w, a=g.a * sx, d=g.d * sx, b=g.b * sy, e=g.e * sy)


def shrink_of(source: Grid, out: Grid) -> float:
    """How many source pixels an output pixel is wide or high, the larger of both."""
    corners = [source_pixel(source, out, px, py) for px in (0, out.w) for py in (0, out.h)]
    return float(max((max(p[0] for p in corners) - min(p[0] for p in corners)) / out.w, (max(p[1] for p in corners) - min(p[1] for p in corners)) / out.h))


def read_onto(reader, uri: str, band: int, grid: Grid | None, out: Grid, cfg: dict) -> tuple[int, int, np.ndarray] | None:
    """One source on an output grid: (row, column, pixels in the output's type, with its nodata).

    Only the window that the output needs is read, of the coarsest overview that is still finer than the output. Pixels
    are pasted where grids agree up to whole pixels, else they are resampled."""
    found, shape, file_nodata, factors = reader.describe(uri, band)
    g = found or grid
    if g is None:
        raise ValueError(f"No grid for {uri}")
    g = replace(g, h=shape[0], w=shape[1])
    nd = next((v for v in (cfg.get("src_nodata_override"), file_nodata, cfg.get("src_nodata_fallback")) if v is not None), None)
    dtype, kind = cfg["dtype"], cfg["resampling"]
    target = cfg["fill_value"] if cfg["fill_value"] is not None else (math.nan if is_float(dtype) else nd)
    here = meeting(g, out)
    if here is None:
        return None
    top, left = here[0], here[2]
    out = out.crop(*here)
    shrink = shrink_of(g, out)
    level = None
    if shrink > 1 and cfg["use_overviews"] and (fit := [(o, i) for i, o in enumerate(factors) if o <= shrink + 1e-6]):
        level = max(fit)[1]
        g = level_grid(reader, uri, band, level, g, factors)
    ttol = 0.9 if kind == "nearest" else 0.05
    (px, py), (qx, qy), (rx, ry) = source_pixel(g, out, 0, 0), source_pixel(g, out, out.w, out.h), source_pixel(g, out, out.w, 0)
    same = C.epsg(g.crs) == C.epsg(out.crs) and all(abs(a - b) < 1e-6 * max(out.w, out.h) for a, b in ((qx - px, out.w), (qy - py, out.h), (rx - px, out.w), (ry - py, 0)))
    if same and abs(px - round(px)) <= ttol / 2 + 1e-9 and abs(py - round(py)) <= ttol / 2 + 1e-9:
        x, y = round(px), round(py)
        a, b, c, d = max(y, 0), min(y + out.h, g.h), max(x, 0), min(x + out.w, g.w)
        if b <= a or d <= c:
            return None
        return top + a - y, left + c - x, kernels.remap_nodata(reader.read(uri, band, level, (a, b, c, d)), nd, target, dtype)
    fill = np.array(target if target is not None else fill_of(dtype, None)).astype(dtype)
    pix, seen = np.full((out.h, out.w), fill, dtype), np.zeros((out.h, out.w), bool)
    rows = max(1, RUN // out.w)
    for a in range(0, out.h, rows):  # strips of the output bound what the kernels hold
        strip = out.crop(a, min(a + rows, out.h), 0, out.w)
        got = _resampled(reader, uri, band, level, g, strip, kind, nd)
        if got is None:
            continue
        v, ok = got
        if not is_float(dtype) and kind != "nearest":
            v = np.rint(v)
        seen[a : a + strip.h] = ok
        np.copyto(pix[a : a + strip.h], kernels.cast(v, dtype), where=ok)
    if not seen.any():
        return None
    # only the box in which there are pixels counts as this source's
    ys, xs = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    return top + int(ys[0]), left + int(xs[0]), np.ascontiguousarray(pix[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1])


def _resampled(reader, uri: str, band: int, level: int | None, g: Grid, out: Grid, kind: str, nd: float | None):
    block = kind in kernels.AGGREGATES
    at = (np.arange(out.w + 1.0), np.arange(out.h + 1.0)) if block else (np.arange(out.w) + 0.5, np.arange(out.h) + 0.5)
    px, py = source_pixel(g, out, *np.meshgrid(*at))
    fine = np.isfinite(px) & np.isfinite(py)
    if not fine.any():
        return None
    px, py = np.where(fine, px, -1e9), np.where(fine, py, -1e9)
    n = 1 + math.ceil(kernels.INTERPOLATED.get(kind, 0))
    x0, x1 = max(0, math.floor(px[fine].min()) - n), min(g.w, math.ceil(px[fine].max()) + n)
    y0, y1 = max(0, math.floor(py[fine].min()) - n), min(g.h, math.ceil(py[fine].max()) + n)
    if x0 >= x1 or y0 >= y1:
        return None
    src = reader.read(uri, band, level, (y0, y1, x0, x1))
    return (kernels.reduce_at if block else kernels.sample)(src, px - x0, py - y0, kind, nd)


class Memory:
    """A reader over arrays: uri to (pixels or list of bands, grid, nodata); overviews are made by picking pixels. It
    counts the pixels that were read."""

    FACTORS = (2, 4, 8)

    def __init__(self, rasters: dict[str, tuple]):
        self.rasters, self.n_read = rasters, 0

    def _bands(self, uri: str, band: int):
        if uri not in self.rasters:
            raise FileNotFoundError(uri)
        pix, g, nodata = self.rasters[uri]
        pix = pix if isinstance(pix, list) else [pix]
        if not 1 <= band <= len(pix):
            raise ValueError(f"Band {band} of {len(pix)}: {uri}")
        return pix[band - 1], g, nodata

    def describe(self, uri: str, band: int):
        p, g, nodata = self._bands(uri, band)
        return g, p.shape, nodata, [k for k in self.FACTORS if min(p.shape) >= 2 * k]

    def level_grid(self, uri: str, band: int, level: int) -> Grid:
        p, g, _ = self._bands(uri, band)
        k = self.FACTORS[level]
        h, w = p[k // 2 :: k, k // 2 :: k].shape
        return replace(g.zoom_out(k), h=h, w=w)

    def read(self, uri: str, band: int, level: int | None, window):
        p, _, _ = self._bands(uri, band)
        if level is not None:
            k = self.FACTORS[level]
            p = p[k // 2 :: k, k // 2 :: k]
        y0, y1, x0, x1 = window
        self.n_read += (y1 - y0) * (x1 - x0)
        return p[y0:y1, x0:x1]
