"""Raster files: TIFF images read by window and written with tiles, predictors, overviews and georeferencing.

Read: classic and big TIFF in either byte order; strips or tiles; no compression, deflate or PackBits; predictors 2 and 3;
8 to 64 bit integers and floating point; bands side by side or one after another; overviews as further or as sub
directories; geokeys with an EPSG code, scale and tie point or a matrix, pixels as areas or points; nodata as text. Only
the strips or tiles that a window meets are fetched, through Arrow's file systems (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow.fs as pafs

from ..operators.grids import Grid

# Tags and types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, SUB, FORMAT, SUBTYPE = 322, 323, 324, 325, 330, 339, 254
SCALE, TIE, MATRIX, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MODEL, RASTER, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
NONE, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 8, 32773, 32946


@dataclass
class Level:
    """One directory: the image or an overview of it."""

    h: int
    w: int
    bands: int
    dtype: np.dtype
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    planar: bool


@dataclass
class Raster:
    """What a file says of itself: its levels (the first is the image), grid, nodata."""

    levels: list[Level]
    grid: Grid | None
    nodata: float | None
    order: str
    overviews: list[int] = field(default_factory=list)

    def grid_of(self, level: int | None) -> Grid | None:
        if level is None or self.grid is None:
            return self.grid
        got, g = self.levels[level + 1], self.grid
        sy, sx = g.h / got.h, g.w / got.w
        return replace(g, h=got.h, w=got.w, a=g.a * sx, d=g.d * sx, b=g.b * sy, e=g.e * sy)


def open_file(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return fs.open_input_file(path)


def _directory(f, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    count, entry, offset, size = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    head = struct.calcsize(order + count)
    (n,) = struct.unpack(order + count, f.read_at(head, at))
    raw = f.read_at(n * entry + size, at + head)
    out = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, i * entry)
        (m,) = struct.unpack_from(order + offset, raw, i * entry + 4)
        if kind not in TYPES:
            continue
        form = TYPES[kind]
        code = f"{order}{m}s" if form == "s" else f"{order}{m * len(form)}{form[0]}"
        need = struct.calcsize(code)
        where = i * entry + 4 + size
        data = raw[where : where + need] if need <= size else f.read_at(need, struct.unpack_from(order + offset, raw, where)[0])
        out[tag] = struct.unpack(code, data)
    (after,) = struct.unpack_from(order + offset, raw, n * entry)
    return out, after


def describe(f) -> Raster:
    """The structure of an open file; pixels are not read."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    found, seen = [], set()
    queue = [at]
    while queue:
        at = queue.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        tags, after = _directory(f, at, order, big)
        found.append(tags)
        queue += [after, *tags.get(SUB, ())]
    first = found[0]
    levels = [_level(t, order) for t in found if t is first or t.get(SUBTYPE, (0,))[0] & 1]
    levels = [levels[0], *sorted((x for x in levels[1:] if x.bands == levels[0].bands and not first.get(SUBTYPE, (0,))[0] & 4), key=lambda x: -x.h)]
    text = b"".join(first.get(NODATA, ())).split(b"\0")[0].strip()
    return Raster(levels, _grid(first, levels[0]), float(text) if text else None, order, [round(levels[0].w / x.w) for x in levels[1:]])


def _level(t: dict[int, tuple], order: str) -> Level:
    one = lambda k, d=None: t.get(k, (d,))[0]
    h, w, n, bits = one(HEIGHT), one(WIDTH), one(SAMPLES, 1), one(BITS, 8)
    if len(set(t.get(BITS, (8,)))) > 1 or bits not in (8, 16, 32, 64):
        raise ValueError(f"{t.get(BITS)} bits a sample are not read")
    dtype = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{bits // 8}")
    compression = one(COMPRESSION, NONE)
    if compression not in (NONE, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError(f"compression {compression} is not read")
    tiled = TILES in t
    block = (one(TILE_H), one(TILE_W)) if tiled else (min(h, one(ROWS, h)), w)
    offsets, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    return Level(h, w, n, dtype, block, offsets, sizes, compression, one(PREDICTOR, 1), one(PLANAR, 1) == 2)


def _grid(t: dict[int, tuple], level: Level) -> Grid | None:
    keys = t.get(GEOKEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    epsg = geo.get(PROJECTED) or geo.get(GEOGRAPHIC)
    if MATRIX in t:
        m = t[MATRIX]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif SCALE in t and TIE in t:
        (sx, sy, _), (i, j, _, x, y, _) = t[SCALE], t[TIE][:6]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    else:
        return None
    if geo.get(RASTER) == 2:  # the tie point is a pixel's centre
        c, f = c - (a + b) / 2, f - (d + e) / 2
    return Grid(level.h, level.w, a, b, c, d, e, f, f"EPSG:{epsg}" if epsg and epsg != 32767 else "")


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _block(f, v: Level, k: int, order: str) -> np.ndarray:
    """A strip or tile as (rows, columns, samples)."""
    bh, bw = v.block
    n = 1 if v.planar else v.bands
    if not v.sizes[k]:
        return np.zeros((bh, bw, n), v.dtype)  # a sparse file leaves out empty blocks
    raw = f.read_at(v.sizes[k], v.offsets[k])
    if v.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif v.compression == PACKBITS:
        raw = _unpack_bits(raw)
    row = bw * n * v.dtype.itemsize
    rows = min(bh, len(raw) // row)
    if v.predictor == 3:
        b = np.frombuffer(raw[: rows * row], np.uint8).reshape(rows, row)
        summed = np.empty_like(b)
        for s in range(n):
            summed[:, s::n] = np.cumsum(b[:, s::n], axis=1, dtype=np.uint8)
        planes = summed.reshape(rows, v.dtype.itemsize, bw * n)  # most significant bytes first
        return np.ascontiguousarray(planes.swapaxes(1, 2)).view(v.dtype.newbyteorder(">")).reshape(rows, bw, n)
    x = np.frombuffer(raw[: rows * row], v.dtype).reshape(rows, bw, n)
    return np.cumsum(x, axis=1, dtype=v.dtype.newbyteorder("=")) if v.predictor == 2 else x


def read_window(f, r: Raster, band: int, level: int | None, window: tuple[int, int, int, int]) -> np.ndarray:
    """Rows y0 to y1 and columns x0 to x1 of a band (from 1) of the image or of an overview."""
    v = r.levels[0 if level is None else level + 1]
    if not 1 <= band <= v.bands:
        raise ValueError(f"Band {band} of {v.bands}")
    y0, y1, x0, x1 = window
    bh, bw = v.block
    across, down = -(-v.w // bw), -(-v.h // bh)
    out = np.zeros((y1 - y0, x1 - x0), v.dtype.newbyteorder("="))
    for by in range(y0 // bh, -(-y1 // bh)):
        for bx in range(x0 // bw, -(-x1 // bw)):
            k = by * across + bx + ((band - 1) * across * down if v.planar else 0)
            b = _block(f, v, k, r.order)[:, :, 0 if v.planar else band - 1]
            ya, yb, xa, xb = max(y0, by * bh), min(y1, by * bh + b.shape[0]), max(x0, bx * bw), min(x1, (bx + 1) * bw)
            out[ya - y0 : yb - y0, xa - x0 : xb - x0] = b[ya - by * bh : yb - by * bh, xa - bx * bw : xb - bx * bw]
    return out


# --- writing


def encode(bands: list[np.ndarray], grid: Grid | None = None, nodata: float | None = None, *, tile: int | None = 256, compression: int = DEFLATE, predictor: int = 2, overviews: tuple[int, ...] = (), planar: bool = False) -> bytes:
    """Bands of one shape and type as a TIFF file: tiled (or in strips), with overviews that pick pixels."""
    images = [bands, *[[b[k // 2 :: k, k // 2 :: k] for b in bands] for k in overviews]]
    body, directories = bytearray(b"II*\0\0\0\0\0"), []
    for i, image in enumerate(images):
        x = np.stack(image, axis=2)
        x = x.astype(x.dtype.newbyteorder("<"))
        h, w, n = x.shape
        how = predictor if x.dtype.kind != "f" or predictor != 2 else 1
        bh, bw = (tile, tile) if tile else (min(h, 64), w)
        offsets, sizes = [], []
        for layer in [x[:, :, k : k + 1] for k in range(n)] if planar else [x]:
            for y in range(0, h, bh):
                for c in range(0, w, bw):
                    b = layer[y : y + bh, c : c + bw]
                    if tile:
                        b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                    data = _encoded(np.ascontiguousarray(b), how)
                    data = zlib.compress(data, 6) if compression == DEFLATE else data
                    offsets.append(len(body))
                    sizes.append(len(data))
                    body += data
        tags = {
            SUBTYPE: ("I", [1 if i else 0]), WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [x.dtype.itemsize * 8] * n), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [n]),
            PLANAR: ("H", [2 if planar else 1]), PREDICTOR: ("H", [how]), FORMAT: ("H", [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]] * n),
        }
        tags |= {TILE_W: ("I", [bw]), TILE_H: ("I", [bh]), TILES: ("I", offsets), TILE_BYTES: ("I", sizes)} if tile else {ROWS: ("I", [bh]), STRIPS: ("I", offsets), STRIP_BYTES: ("I", sizes)}
        if grid is not None and not i:
            code = int(grid.crs.rsplit(":", 1)[-1])
            flat = code in (4326, 4269, 4283, 4979)
            tags[GEOKEYS] = ("H", [1, 1, 0, 3, MODEL, 0, 1, 2 if flat else 1, RASTER, 0, 1, 1, GEOGRAPHIC if flat else PROJECTED, 0, 1, code])
            if grid.b == grid.d == 0 and grid.a > 0 > grid.e:
                tags |= {SCALE: ("d", [grid.a, -grid.e, 0.0]), TIE: ("d", [0.0, 0.0, 0.0, grid.c, grid.f, 0.0])}
            else:
                tags[MATRIX] = ("d", [grid.a, grid.b, 0.0, grid.c, grid.d, grid.e, 0.0, grid.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
        if nodata is not None:
            tags[NODATA] = ("s", [f"{nodata:.17g}".encode() + b"\0"])
        directories.append(tags)
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    link = 4
    for tags in directories:
        entries = []
        for tag in sorted(tags):
            form, values = tags[tag]
            data = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
            count = len(data) if form == "s" else len(values)
            if len(data) > 4:
                body += b"\0" * (len(body) % 2)
                at, data = len(body), data
                body += data
                data = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, kinds[form], count) + data.ljust(4, b"\0"))
        body += b"\0" * (len(body) % 2)
        struct.pack_into("<I", body, link, len(body))
        body += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def _encoded(b: np.ndarray, predictor: int) -> bytes:
    if predictor == 2:
        d = b.copy()
        d[:, 1:] -= b[:, :-1]
        return d.tobytes()
    if predictor == 3:
        rows, cols, n = b.shape
        big = np.ascontiguousarray(b.astype(b.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, cols * n, b.dtype.itemsize)
        planes = np.ascontiguousarray(big.swapaxes(1, 2)).reshape(rows, -1)
        d = planes.copy()
        d[:, n:] -= planes[:, :-n]
        return d.tobytes()
    return b.tobytes()


class TiffReader:
    """Reads TIFF files by window; what the last files say of themselves is kept in a worker."""

    def __init__(self, keep: int = 64):
        self.keep, self._known = keep, {}

    def __getstate__(self):
        return {"keep": self.keep, "_known": {}}

    def describe(self, uri: str, band: int) -> tuple[Grid | None, tuple[int, int], float | None, list[int]]:
        if uri not in self._known:
            if len(self._known) >= self.keep:
                self._known.clear()
            with open_file(uri) as f:
                self._known[uri] = describe(f)
        r = self._known[uri]
        if not 1 <= band <= r.levels[0].bands:
            raise ValueError(f"Band {band} of {r.levels[0].bands}: {uri}")
        return r.grid if r.grid is not None and r.grid.crs else None, (r.levels[0].h, r.levels[0].w), r.nodata, r.overviews

    def level_shape(self, uri: str, level: int | None) -> tuple[int, int]:
        v = self._known[uri].levels[0 if level is None else level + 1]
        return v.h, v.w

    def read(self, uri: str, band: int, level: int | None, window: tuple[int, int, int, int]) -> np.ndarray:
        with open_file(uri) as f:
            return read_window(f, self._known[uri], band, level, window)
