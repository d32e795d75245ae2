"""Raster files, windowed reading, outlines, late assets, public names."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest

import rastercube
from rastercube.functions import kernels as K
from rastercube.functions import outline
from rastercube.operators import infer
from rastercube.operators.grids import Grid
from rastercube.plans.read import Memory, Whole, read_onto
from rastercube.sources import stac, tiff

G = Grid(70, 50, 10.0, 0.0, 600000.0, 0.0, -10.0, 5000000.0, "EPSG:32633")
CFG = {"dtype": "int16", "fill_value": -1.0, "resampling": "nearest", "use_overviews": True, "fail_on_error": True}


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("how", [{"tile": 16}, {"tile": None}, {"tile": 32, "predictor": 1}, {"tile": None, "compression": tiff.NONE}, {"tile": 16, "planar": True}, {"tile": 64, "predictor": 3}])
def test_tiff_round_trip(dtype, how):
    if how.get("predictor") == 3 and not dtype.startswith("float"):
        how = {**how, "predictor": 2}
    r = np.random.default_rng(1)
    bands = [(r.random((70, 50)) * 200).astype(dtype) for _ in range(3)]
    f = Bytes(tiff.encode(bands, G, 7, overviews=(2, 4), **how))
    d = tiff.describe(f)
    assert d.grid == G and d.nodata == 7 and d.overviews == [2, 4] and (d.levels[0].h, d.levels[0].w, d.levels[0].bands) == (70, 50, 3)
    for b in range(3):
        assert (tiff.read_window(f, d, b + 1, None, (0, 70, 0, 50)) == bands[b]).all()
        assert (tiff.read_window(f, d, b + 1, None, (13, 41, 9, 37)) == bands[b][13:41, 9:37]).all()
        assert (tiff.read_window(f, d, b + 1, 1, (2, 9, 1, 11)) == bands[b][2::4, 2::4][2:9, 1:11]).all()
    with pytest.raises(ValueError):
        tiff.read_window(f, d, 4, None, (0, 1, 0, 1))
    with pytest.raises(ValueError):
        tiff.describe(Bytes(b"not a file at all"))


def test_rotated_grids_are_kept():
    g = Grid(4, 5, 10.0, 2.0, 1.0, 1.0, -10.0, 2.0, "EPSG:4326")
    assert tiff.describe(Bytes(tiff.encode([np.zeros((4, 5), "uint8")], g))).grid == g


def test_each_source_pixel_is_read_once():
    pix = np.arange(400 * 400, dtype="int32").reshape(400, 400) % 1000
    g = Grid(400, 400, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, "EPSG:3857")
    reader = Memory({"a": (pix, g, None)})
    out = np.zeros((400, 400), "int32")
    for y in range(0, 400, 50):
        for x in range(0, 400, 50):
            at, left, got = read_onto(reader, "a", 1, None, g.crop(y, y + 50, x, x + 50), {**CFG, "dtype": "int32", "fill_value": None})
            out[y + at : y + at + got.shape[0], x + left : x + left + got.shape[1]] = got
    assert (out == pix).all() and reader.n_read == pix.size
    assert read_onto(reader, "a", 1, None, g.crop(900, 950, 0, 50), CFG) is None and reader.n_read == pix.size
    coarse = Grid(50, 50, 80.0, 0.0, 0.0, 0.0, -80.0, 0.0, "EPSG:3857")
    read_onto(reader, "a", 1, None, coarse, CFG)
    assert reader.n_read - pix.size <= 50 * 50  # the overview, not the image


@pytest.mark.parametrize("kind", K.AGGREGATES)
def test_reduced_as_pixel_by_pixel(kind):
    r = np.random.default_rng(3)
    src = r.integers(-1, 6, (23, 31)).astype("int16")
    py, px = np.meshgrid(np.linspace(-2, 25, 9), np.linspace(-1, 33, 8), indexing="ij")
    got, ok = K.reduce_at(src, px, py, kind, -1)
    want = {
        "average": np.mean, "max": np.max, "min": np.min, "sum": np.sum, "rms": lambda v: np.sqrt(np.mean(v * v)), "mode": lambda v: min(sorted(set(v)), key=lambda x: -np.sum(v == x)),
        "med": lambda v: np.quantile(v, 0.5, method="inverted_cdf"), "q1": lambda v: np.quantile(v, 0.25, method="inverted_cdf"), "q3": lambda v: np.quantile(v, 0.75, method="inverted_cdf"),
    }[kind]
    for y in range(8):
        for x in range(7):
            v = [float(src[i, j]) for i in range(23) for j in range(31) if py[y, 0] <= i + 0.5 < py[y + 1, 0] and px[0, x] <= j + 0.5 < px[0, x + 1] and src[i, j] != -1]
            assert ok[y, x] == bool(v) and (not v or abs(got[y, x] - want(np.array(v))) < 1e-9)


def test_functions_are_readers_of_whole_images():
    pix = np.arange(70 * 50).reshape(70, 50)
    w = Whole(lambda uri, band, level: (pix, G, None, []))
    assert w.describe("u", 1) == (G, (70, 50), None, []) and (w.read("u", 1, None, (1, 3, 2, 5)) == pix[1:3, 2:5]).all()


def test_tiles_of_outlines():
    """Against a test of every tile: rings in any place, several a row, null and empty."""
    r = random.Random(5)
    rows = []
    for _ in range(60):
        x, y, w, h = r.uniform(-20, 100), r.uniform(-20, 80), r.uniform(1, 40), r.uniform(1, 40)
        s = r.choice([0, 0, r.uniform(-8, 8)])
        ring = [(x, y), (x + w, y + s), (x + w + s, y + h + s), (x + s, y + h)] if s else [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        rows.append([[{"x": a, "y": b} for a, b in ring]])
    rows[7] = rows[7] + rows[8]
    rows += [None, []]
    row, ty, tx = outline.tiles_met(pa.array(rows, outline.ARROW), 75, 95, (20, 30))
    got = {}
    for k, a, b in zip(row.tolist(), ty.tolist(), tx.tolist(), strict=True):
        assert (a, b) not in got.setdefault(k, set())
        got[k].add((a, b))
    t = np.linspace(0, 1, 41)
    for k, rings in enumerate(rows):
        inside = set()
        for ring in rings or ():
            p = np.array([(q["x"], q["y"]) for q in ring])
            # points all over the quadrilateral
            u, v = np.meshgrid(t, t)
            pts = ((1 - u) * (1 - v))[..., None] * p[0] + (u * (1 - v))[..., None] * p[1] + (u * v)[..., None] * p[2] + ((1 - u) * v)[..., None] * p[3]
            e = 1e-6
            for a, b in pts.reshape(-1, 2):
                if e < a < 95 - e and e < b < 75 - e and min(a % 30, 30 - a % 30) > e and min(b % 20, 20 - b % 20) > e:
                    inside.add((int(b // 20), int(a // 30)))
        assert inside <= got.get(k, set()), k


def test_densified_outlines():
    grid = pa.struct([("h", pa.int32()), ("w", pa.int32()), *[(k, pa.float64()) for k in "abcdef"], ("crs", pa.string())])
    wide = {"h": 10, "w": 1000, "a": 10.0, "b": 0.0, "c": 500000.0, "d": 0.0, "e": -10.0, "f": 5000000.0, "crs": "EPSG:32633"}
    got = outline.outlines(pa.array([wide, None, None], grid), pa.array([None, [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]], None], outline.ARROW), "EPSG:4326").to_pylist()
    assert got[2] is None and len(got[1][0]) == 3 and len(got[0][0]) > 400  # a long edge has many points, degrees none to add
    same = outline.outlines(pa.array([wide], grid), pa.array([None], outline.ARROW), "EPSG:32633").to_pylist()
    assert len(same[0][0]) == 4


def test_load_over_files(spark, tmp_path):
    """Files written here, loaded pixel by pixel, with an overview for a coarser grid, and written again as files."""
    r = np.random.default_rng(2)
    pix = [r.integers(0, 500, (70, 50)).astype("uint16") for _ in range(2)]
    docs = []
    for i, p in enumerate(pix):
        uri = str(tmp_path / f"{i}.tif")
        (tmp_path / f"{i}.tif").write_bytes(tiff.encode([p], G, 0, tile=16, overviews=(2,)))
        docs.append(stac.item_document(f"i{i}", f"2020-01-0{i + 1}T00:00:00Z", collection="c", assets={"b": (G, "uint16", 0, uri)}))
    plan = rastercube.load(docs, "b", spark=spark, geobox=G, chunks={"y": 32, "x": 32})
    out = [np.zeros((70, 50), "uint16") for _ in pix]
    for t in plan.tiles().collect():
        out[t.t_idx][t.ty * 32 : t.ty * 32 + t.h, t.tx * 32 : t.tx * 32 + t.w] = K.unpack(t.data, t.dtype, t.h, t.w)
    assert all((a == b).all() for a, b in zip(out, pix, strict=True))
    files = plan.write_images(str(tmp_path / "out")).collect()
    assert len(files) == 12
    reader = tiff.TiffReader()
    grid, shape, nodata, _ = reader.describe(files[0].uri, 1)
    f = files[0]
    assert nodata == 0 and (reader.read(f.uri, 1, None, (0, *shape[:1], 0, shape[1])) == pix[f.t_idx][f.ty * 32 : f.ty * 32 + shape[0], f.tx * 32 : f.tx * 32 + shape[1]]).all()
    assert grid == G.crop(f.ty * 32, f.ty * 32 + shape[0], f.tx * 32, f.tx * 32 + shape[1])
    plan.close()


def test_late_assets(spark):
    """Names of grids of assets that turn up after a collection's first item, also by way of each other."""
    g = lambda r: {"proj:epsg": 32633, "proj:shape": [10, 10], "proj:transform": [r, 0, 0, 0, -r, 0], "type": "image/tiff"}
    a = {"a": {"href": "http://h/a", **g(10)}, "b": {"href": "http://h/b", **g(20)}}
    docs = [
        stac.item_document("1", "2020-01-01T00:00:00Z", collection="c", assets=a),
        stac.item_document("2", "2020-01-01T00:00:00Z", collection="c", assets={**a, "c": {"href": "http://h/c", **g(20)}, "d": {"href": "http://h/d", **g(60)}}),
        stac.item_document("3", "2020-01-01T00:00:00Z", collection="c", assets={"d": {"href": "http://h/d", **g(60)}, "e": {"href": "http://h/e", **g(60)}, "f": {"href": "http://h/f", **g(5)}}),
    ]
    found = infer.parse_items(spark, docs)
    assert {r.asset: r.grid_name for r in found.grids.collect()} == {"a": "default", "b": "g20", "c": "g20", "d": "grid-d", "e": "grid-d", "f": "grid-f"}


def test_public_names():
    assert rastercube.stac_load is rastercube.load and rastercube.output_geobox is rastercube.output_grid
    assert all(hasattr(rastercube, n) for n in rastercube.__all__)
    with pytest.raises(AttributeError):
        rastercube.nothing  # noqa: B018
