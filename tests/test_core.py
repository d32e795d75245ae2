"""Operators on metadata and pixels, with literal expectations."""

import json
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rastercube.functions import crs as C
from rastercube.functions import kernels as K
from rastercube.functions import scalar as S
from rastercube.operators import bands as B
from rastercube.operators import binning, grids, infer, pixels, temporal
from rastercube.operators.grids import Grid, from_bbox
from rastercube.plans import cube, products, report
from rastercube.sources import settings, stac
from rastercube.sources.stac import item_document

G = from_bbox((-20, -10, 20, 10), "EPSG:3857", (0.1, -0.1))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# --- time planes

A, B1, B2, CC = ("a", 150, "2020-01-02T23:59:00"), ("b1", 151, "2020-01-03T00:01:00"), ("b2", 152, "2020-01-03T00:01:00"), ("c", 0, "2020-01-02T23:59:00")


@pytest.mark.parametrize(
    ("order", "how", "want"),
    [
        ([], {"groupby": "time"}, []),
        ([B1, A, B2], {"groupby": "id"}, [["b1"], ["a"], ["b2"]]),
        ([B1, A, B2], {"groupby": "time"}, [["a"], ["b1", "b2"]]),
        ([B2, A, B1], {"groupby": "time", "preserve_order": True}, [["a"], ["b2", "b1"]]),
        ([A, CC, B1, B2], {"groupby": "time", "preserve_order": True}, [["a", "c"], ["b1", "b2"]]),
        ([A, B1, B2, CC], {"groupby": "solar_day"}, [["c"], ["a", "b1", "b2"]]),
        ([A, B1, B2, CC], {"groupby": "solar_day", "lon": 151}, [["a", "c", "b1", "b2"]]),
        ([B1, A], {"groupby": "proj:epsg"}, [["a", "b1"]]),
        ([A, B1], {"groupby": "proj:transform"}, [["a"], ["b1"]]),
        ([A, B1, B2, CC], {"groupby": lambda: F.col("item_seq") % 2, "preserve_order": True}, [["a", "b2"], ["b1", "c"]]),
    ],
)
def test_grouping(spark, order, how, want):
    rows = [(i, n, ts, float(lon), f'{{"proj:epsg": 32606, "proj:transform": [{10 + (n != "a")}, 0]}}') for i, (n, lon, ts) in enumerate(order)]
    df = spark.createDataFrame(rows, "item_seq long, id string, ts string, lon double, p string").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "properties": F.parse_json("p")})
    got = temporal.group_items(df, **how).orderBy("t_idx", "prio").collect()
    planes = {}
    for r in got:
        planes.setdefault(r.t_idx, []).append(r.id)
    assert list(planes.values()) == want


@pytest.mark.parametrize(("lon", "hours"), [(0, 0), (1, 0), (-2, 0), (3, 0), (14, 0), (-14, 0), (15.1, 1), (-15.1, -1), (20, 1), (None, 0)])
def test_solar_time(spark, lon, hours):
    ts = F.lit("2020-01-01T12:00:00").cast("timestamp_ntz")
    r = one(spark, S.solar_time(ts, F.lit(lon).cast("double")).alias("s"), ts.alias("t"))
    assert (r.s - r.t).total_seconds() == hours * 3600


def test_no_time_fails(spark):
    null = F.lit(None).cast("timestamp")
    with pytest.raises(Exception, match="no timestamp"):
        one(spark, S.nominal_time(null, null, null))


# --- scalars


def test_chunks(spark):
    r = one(spark, S.chunk_sizes(F.lit(11), F.lit(4)).alias("a"), S.chunk_sizes(F.lit(11), F.lit(-1)).alias("b"), S.chunk_sizes(F.lit(4), F.lit(4)).alias("c"))
    assert (r.a, r.b, r.c) == ([4, 4, 3], [11], [4])
    assert S.chunks_of(11, 4) == (4, 4, 3)


def test_overviews(spark):
    levels = F.array(*map(F.lit, (2, 4, 8)))
    got = [one(spark, S.pick_overview(F.lit(s), o).alias("o")).o for s, o in [(2, F.array().cast("array<int>")), (1, F.array(F.lit(2), F.lit(4))), (2, levels), (3, levels), (4, levels), (7, levels), (8, levels), (20, levels)]]
    assert got == [None, None, 0, 0, 1, 1, 2, 2]


def test_same_nodata(spark):
    v = [None, math.nan, 0.0, -1.0]
    for i, a in enumerate(v):
        for j, b in enumerate(v):
            assert one(spark, S.same_nodata(F.lit(a).cast("double"), F.lit(b).cast("double")).alias("s")).s == (i == j)


def test_short_numbers_and_ids(spark):
    for x in (10.0, 0.5, 1e6, 123456.7, 1e-5, 0.0001, 60.0, 3.14159265, 0.0, -20.0, 1234567.0):
        assert one(spark, S.short_number(F.lit(x)).alias("s")).s == f"{x:g}"
    r = one(spark, S.uuid5(F.lit("sentinel-2-l2a\nid1\n")).alias("u"))
    assert r.u == "14ae6be1-8abe-5e4e-8ed3-f73c805c8264" == str(uuid.uuid5(S.NAMESPACE, "sentinel-2-l2a\nid1\n"))


def test_band_names(spark):
    got = [tuple(one(spark, S.band_of(F.lit(n)).alias("b")).b) for n in ("a", "a.3", "SR_B1.TIF", "x.y.2")]
    assert got == [("a", 1), ("a", 3), ("SR_B1.TIF", 1), ("x.y", 2)]


@pytest.mark.parametrize("dtype", [d for d in S.DTYPES if d not in ("float32", "float64")])
def test_casts_hold_the_range(spark, dtype):
    lo, hi = S.DTYPES[dtype][1:3]
    for v in (-1e30, 1e30, 3.9, -3.9, math.nan) if hi < 2**53 else (3.9, 1e10):
        got = int(one(spark, S.to_dtype(F.lit(v), dtype).alias("v")).v)
        assert got == int(K.cast(np.array([v]), dtype)[0]) and lo <= got <= hi


# --- bands


def test_names_of_bands(spark):
    bands = spark.createDataFrame([("x", "a", i, i, "uint8", None, "1") for i in (1, 2, 3)] + [("x", "b", 1, 4, "int16", -1.0, "1")], "collection_id string, asset string, idx int, band_pos int, data_type string, nodata double, unit string")
    aliases = spark.createDataFrame([("x", "AA", 0, 0, "a", 2), ("x", "AAA", 1, 0, "a", 3), ("x", "B", 2, 0, "b", 1)], "collection_id string, alias string, alias_pos long, rank long, asset string, idx int")
    assert [r.name for r in B.canonical_names(bands, aliases).orderBy("band_pos").collect()] == ["a.1", "AA", "AAA", "b"]
    got = B.resolve_bands(B.band_query(spark, ["B", "a", "AAA", "b.1"]), bands, aliases).orderBy("pos").collect()
    assert [(r.asset, r.idx) for r in got] == [("b", 1), ("a", 1), ("a", 3), ("b", 1)]
    assert [r["query"] for r in B.resolve_bands(None, bands, aliases).orderBy("pos").collect()] == ["a.1", "AA", "AAA", "b"]
    with pytest.raises(Exception, match="No such band"):
        B.resolve_bands(B.band_query(spark, "zz"), bands, aliases).collect()
    names = spark.createDataFrame([("x", n) for n in ("a", "AA", "b.1", "b.2", "q")], "collection_id string, query string")
    assert sorted(r["query"] for r in B.contains(names, bands, aliases).collect()) == ["AA", "a", "b.1"]


def test_load_config(spark):
    b = spark.createDataFrame([("a", "int8", -1.0), ("b", "float64", None)], "query string, data_type string, nodata double")
    get = lambda **k: {r.band: r for r in B.load_config(b, **k).collect()}
    assert {k: (r.dtype, r.fill_value, r.resampling) for k, r in get(resampling="average").items()} == {"a": ("int8", -1, "average"), "b": ("float64", None, "average")}
    got = get(resampling={"*": "mode", "b": "sum"}, nodata=-999, dtype="int64")
    assert {k: (r.dtype, r.fill_value, r.resampling) for k, r in got.items()} == {"a": ("int64", -999, "mode"), "b": ("int64", -999, "sum")}
    assert {k: r.dtype for k, r in get(dtype={"a": "float32"}).items()} == {"a": "float32", "b": "float64"}


# --- raster predicate


@pytest.mark.parametrize(
    ("media", "roles", "href", "want"),
    [
        ("image/jpeg", None, "", True), ("image/jpeg", ["data"], "", True), ("image/jpeg", ["overview"], "", False), ("image/jpeg", ["thumbnail"], "", False),
        (None, ["data"], "", True), (None, ["metadata"], "x.tif", False), (None, ["custom"], "", False), ("text/xml", ["data"], "x.tif", False), ("IMAGE/TIFF; application=geotiff", None, "", True),
        *[(None, None, f"f.{e}", True) for e in ("tif", "tiff", "TIF", "TIFF", "jpeg", "jpg")], (None, None, "f.tif?x=1", False),
    ],
)
def test_raster_predicate(spark, media, roles, href, want):
    df = spark.createDataFrame([(href, media, roles)], "href string, media_type string, roles array<string>")
    assert df.select(stac.is_raster().alias("r")).first().r is want
    if "?" in href:
        assert df.select(stac.is_raster(strip_query=True).alias("r")).first().r is True


# --- grids


def test_boxes_and_anchors():
    a = from_bbox((0, -10, 100, 25), "EPSG:4326", 1)
    assert (a.h, a.w, a.c, a.f) == (35, 100, 0, 25) and a.anchor() == grids.EDGE
    b = from_bbox((0.2, 0.2, 9.7, 9.7), "EPSG:3857", 1, "center")
    assert b.anchor() == grids.CENTER and b.bbox() == (-0.5, -0.5, 10.5, 10.5)
    c = from_bbox((3, 3, 9, 9), "EPSG:3857", 2, (0.25, 0.125))
    assert c.anchor() == (0.25, 0.125)
    assert grids.align_to_anchor(5, 10) == (0.5, 0.5)
    r = G.rotated(30)
    x, y = r.xy(3, 7)
    assert np.allclose(r.pixel(x, y), (3, 7)) and r.b != 0


def test_anchor_column(spark):
    for g in (from_bbox((3, 3, 9, 9), "EPSG:3857", 2, (0.25, 0.125)), G, from_bbox((0, 0, 9, 9), "EPSG:3857", 1, "center"), G.rotated(20)):
        r = one(spark, grids.grid_anchor(g.column()).alias("a"), grids.grid_bbox(g.column()).alias("b"))
        assert np.allclose(tuple(r.a), g.anchor()) and np.allclose(tuple(r.b), g.bbox())


def test_asset_grid_errors(spark):
    arr = lambda v: F.lit(None).cast("array<double>") if v is None else F.array(*[F.lit(float(x)) for x in v])
    good = [10, 0, 5, 0, -10, 7]
    for shape, t, crs, msg in [([4, 5], good, "EPSG:1", None), ([4, 5], [*good, 0, 0, 1], "EPSG:1", None), (None, good, "EPSG:1", "no shape"), ([4, 5], good, None, "no projection"), ([4, 5], good[:5], "EPSG:1", "6 or 9"), ([4, 5], [*good, 0, 0, 2], "EPSG:1", "not affine")]:
        g = grids.asset_grid(arr(shape), arr(t), F.lit(crs).cast("string"))
        if msg:
            with pytest.raises(Exception, match=msg):
                one(spark, g.alias("g"))
        else:
            assert Grid.of(one(spark, g.alias("g")).g) == Grid(4, 5, 10, 0, 5, 0, -10, 7, "EPSG:1")


def most_common(spark, gs):
    df = spark.createDataFrame([(i,) for i in range(len(gs))], "item_seq long")
    g = F.lit(None).cast(grids.GRID)
    for i, x in enumerate(gs):
        g = F.when(F.col("item_seq") == i, x.column()).otherwise(g)
    return grids.most_common_grid(df.withColumn("grid", g)).first()


def test_most_common(spark):
    assert Grid.of(most_common(spark, [G, G]).grid) == G
    r = most_common(spark, [G, G.crop(0, 50, 0, 50), from_bbox((0, 0, 9, 9), "EPSG:3857", 1)])
    assert r.grid is None and (r.res_x, r.crs) == (0.1, "EPSG:3857") and (r.anchor_x, r.anchor_y) == grids.EDGE
    assert most_common(spark, []) is None


@pytest.mark.parametrize("crs", ["EPSG:3857", "EPSG:32601", "EPSG:32735", "EPSG:3577", "EPSG:3031", "EPSG:6933", "EPSG:28355", "EPSG:5070"])
def test_projections_round_trip(spark, crs):
    lat0 = -75 if crs == "EPSG:3031" else -25 if crs in ("EPSG:3577", "EPSG:28355", "EPSG:32735") else 35
    lon0 = {"EPSG:32601": -177, "EPSG:32735": 27, "EPSG:3577": 134, "EPSG:28355": 147, "EPSG:5070": -96}.get(crs, 12)
    lon, lat = np.meshgrid(lon0 + np.linspace(-3, 3, 7), lat0 + np.linspace(-4, 4, 5))
    x, y = C.transform(lon, lat, "EPSG:4326", crs)
    back = C.transform(x, y, crs, "EPSG:4326")
    assert np.allclose(back[0], lon, atol=1e-8) and np.allclose(back[1], lat, atol=1e-8)
    px, py = C.transform(F.lit(float(lon[1, 2])), F.lit(float(lat[1, 2])), "EPSG:4326", crs)
    assert np.allclose(tuple(one(spark, px, py)), (x[1, 2], y[1, 2]), atol=1e-6)


def test_projection_check_points():
    """Worked examples of published texts, and identities."""
    x, y = C.transform(np.array([9.0]), np.array([0.0]), "EPSG:4326", "EPSG:32632")
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    x, y = C.transform(np.array([180.0]), np.array([85.0511287798066]), "EPSG:4326", "EPSG:3857")
    assert abs(x[0] - 20037508.342789244) < 1e-3 and abs(y[0] - 20037508.342789244) < 1e-2
    x, y = C.transform(np.array([180.0]), np.array([0.0]), "EPSG:4326", "EPSG:6933")
    assert abs(x[0] - 17367530.445161) < 0.01
    x, y = C.transform(np.array([0.0]), np.array([-71.0]), "EPSG:4326", "EPSG:3031")
    assert abs(x[0]) < 1e-6 and abs(y[0] - 2082760.109) < 0.01
    assert C.utm_of(27.0, -25.0) == "EPSG:32735" and C.pick_crs("utm-n", (2, -1, 3, 0)) == "EPSG:32631"


# --- binning


def test_bins_match_geometry(spark):
    g = Grid(100, 120, 1.0, 0.0, 0.0, 0.0, -1.0, 100.0, "EPSG:3857")
    r = random.Random(4)
    rows = []
    for i in range(60):
        cx, cy, w, h, a = r.uniform(-5, 125), r.uniform(-5, 105), r.uniform(1, 40), r.uniform(1, 40), r.uniform(0, 3)
        pts = [(cx + math.cos(a) * u * w - math.sin(a) * v * h, cy + math.sin(a) * u * w + math.cos(a) * v * h) for u, v in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]
        rows.append((i, pts))
    df = spark.createDataFrame(rows, "item_seq long, footprint array<struct<x:double,y:double>>")
    got = {(x.item_seq, x.ty, x.tx) for x in binning.bin_items(df, g, (16, 20)).collect()}

    def meets(p, ty, tx):  # fine sampling of the footprint
        u = np.linspace(0.004, 0.996, 200)
        uu, vv = np.meshgrid(u, u)
        p = np.array(p)
        pts = p[0] + uu[..., None] * (p[1] - p[0]) + vv[..., None] * (p[3] - p[0])
        return bool(((pts[..., 0] > tx * 20) & (pts[..., 0] < min(120, tx * 20 + 20)) & (pts[..., 1] > ty * 16) & (pts[..., 1] < min(100, ty * 16 + 16))).any())

    sampled = {(i, ty, tx) for i, p in rows for ty in range(7) for tx in range(6) if meets(p, ty, tx)}
    assert sampled <= got and len(got - sampled) <= 0.03 * len(got) + 2


# --- pixels


@pytest.mark.parametrize(("dtype", "nodata"), [("float32", None), ("float32", -9.0), ("int16", -9.0), ("uint8", None)])
def test_fuse(spark, dtype, nodata):
    """Rows, tiles and a pixel-by-pixel reading of the contract agree."""
    r = np.random.default_rng(7)
    h, w, sources = 9, 11, []
    for _ in range(5):
        y, x, a, b = r.integers(-3, 6), r.integers(-3, 7), r.integers(2, 8), r.integers(2, 8)
        p = r.integers(0, 9, (a, b)).astype(dtype)
        if nodata is not None:
            p[r.random(p.shape) < 0.4] = nodata
        if dtype == "float32":
            p[r.random(p.shape) < 0.2] = np.nan
        sources.append((int(y), int(x), p))
    fill = nodata if nodata is not None else (math.nan if dtype == "float32" else 0)
    want = np.full((h, w), fill, dtype)
    for yy in range(h):
        for xx in range(w):
            for k, (y, x, p) in enumerate(sources):
                if 0 <= yy - y < p.shape[0] and 0 <= xx - x < p.shape[1]:
                    v = p[yy - y, xx - x]
                    if dtype == "uint8" and k:
                        continue
                    if not K.missing(np.array([v]), nodata)[0]:
                        want[yy, xx] = v
                        break
    assert np.array_equal(K.fuse((h, w), dtype, nodata, sources), want, equal_nan=dtype == "float32")
    rows = [Row(band="b", t_idx=0, y=int(y + i), x=int(x + j), prio=k, v=float(p[i, j])) for k, (y, x, p) in enumerate(sources) for i in range(p.shape[0]) for j in range(p.shape[1]) if 0 <= y + i < h and 0 <= x + j < w]
    spine = spark.range(h * w).select(F.lit("b").alias("band"), F.lit(0).cast("long").alias("t_idx"), F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x"))
    got = np.full((h, w), 0, dtype)
    for p in pixels.dense(pixels.fuse_rows(spark.createDataFrame(rows), dtype, nodata), spine, dtype, nodata).collect():
        got[p.y, p.x] = p.v
    assert np.array_equal(got, want, equal_nan=dtype == "float32")
    parts = spark.createDataFrame([("b", 0, 0, 0, k, y, x, *p.shape, K.pack(p)) for k, (y, x, p) in enumerate(sources)], "band string, t_idx long, ty int, tx int, prio long, y int, x int, h int, w int, data binary")
    tiles = pixels.fuse_tiles(parts, spark.createDataFrame([("b", 0, 0, 0, h, w)], "band string, t_idx long, ty int, tx int, h int, w int"), dtype, nodata)
    t = tiles.first()
    assert np.array_equal(K.unpack(t.data, dtype, h, w), want, equal_nan=dtype == "float32")


@pytest.mark.parametrize("kind", K.AGGREGATES)
def test_block_aggregates(spark, kind):
    r = np.random.default_rng(3)
    x = r.integers(0, 6, (8, 12)).astype("float64")
    x[r.random(x.shape) < 0.3] = -1
    rows = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(8) for j in range(12)], "y int, x int, v double")
    got = {(p.y, p.x): p.v for p in pixels.resample_rows(rows, 4, 3, kind, "float64", -1.0, ()).collect()}
    v, ok = K.reduce_blocks(x, 4, 3, kind, -1.0)
    assert got.keys() == {(int(a), int(b)) for a, b in zip(*np.nonzero(ok), strict=True)}
    assert all(abs(got[k] - v[k]) < 1e-9 for k in got)


def test_interpolation():
    x = np.arange(20.0)[None, :] + 3 * np.arange(15.0)[:, None]
    cols, rows = np.meshgrid(np.linspace(4, 15, 9), np.linspace(4, 11, 8))
    for kind in ("bilinear", "cubic"):  # both reproduce a plane
        v, ok = K.sample(x, cols, rows, kind, None)
        assert ok.all() and np.allclose(v, (cols - 0.5) + 3 * (rows - 0.5))
    for kind in K.INTERPOLATED:
        v, ok = K.sample(np.full((9, 9), 7.0), cols / 3, rows / 3, kind, None)
        assert np.allclose(v[ok], 7)
    gap = x.copy()
    gap[7, 7] = np.nan
    v, ok = K.sample(gap, np.array([7.5, 8.0]), np.array([7.5, 7.5]), "bilinear", None)
    assert list(ok) == [False, True] and v[1] == x[7, 8]


# --- load


def scene(name, ts, grid, pix, dtype="int16", nodata=-99, **assets):
    return item_document(name, ts, collection="c", assets={"b1": (grid, dtype, nodata, f"mem://{name}/b1"), **assets}), {f"mem://{name}/b1": (pix, grid, nodata)}


def whole(plan, band="b1", t=0):
    out = np.full((plan.grid.h, plan.grid.w), 0, plan.config[band]["dtype"])
    for r in plan.tiles().where(f"band = '{band}' AND t_idx = {t}").collect():
        y, x = r.ty * plan.tile[0], r.tx * plan.tile[1]
        out[y : y + r.h, x : x + r.w] = r.fill if r.data is None else K.unpack(r.data, r.dtype, r.h, r.w)
    return out


def test_load_mosaics(spark):
    g = from_bbox((500000, 0, 500000 + 60 * 10, 40 * 10), "EPSG:32632", 10)
    a, b = np.zeros((40, 60), "int16") + 1, np.zeros((40, 60), "int16") + 2
    a[:, 30:] = -99
    d1, r1 = scene("s1", "2020-01-01T10:00:00Z", g, a)
    d2, r2 = scene("s2", "2020-01-01T10:00:05Z", g, b)
    right = g.crop(0, 40, 50, 70)
    d3, r3 = scene("s3", "2020-01-03T10:00:00Z", right, np.full((40, 20), 3, "int16"))
    reader = cube.memory_reader(r1 | r2 | r3)
    plan = cube.load([d1, d2, d3], spark=spark, groupby="solar_day", geobox=g, reader=reader, chunks={"y": 16, "x": 25})
    assert [(str(r.time)[:10], r.n_items) for r in plan.time.orderBy("t_idx").collect()] == [("2020-01-01", 2), ("2020-01-03", 1)]
    first, second = whole(plan), whole(plan, t=1)
    assert (first[:, :30] == 1).all() and (first[:, 30:] == 2).all()
    assert (second[:, :50] == -99).all() and (second[:, 50:] == 3).all()
    assert {r.n for r in plan.pixels().groupBy("t_idx").agg(F.count("*").alias("n")).collect()} == {2400}
    auto = cube.load([d1, d2], "b1", spark=spark, reader=reader)
    assert auto.grid == g and len(auto.time.collect()) == 2
    y, x = auto.coords()
    assert (x[0], y[0]) == (500005, 395)
    union = cube.load([d1, d3], spark=spark, reader=reader)
    assert union.grid == g.crop(0, 40, 0, 70)
    half = cube.load([d1, d2], spark=spark, groupby="solar_day", resolution=20, crs="EPSG:32632", resampling="average", dtype="float32", reader=reader)
    assert (half.grid.h, half.grid.w) == (20, 30) and set(np.unique(whole(half))) == {1.0, 2.0}


def test_load_other_projection(spark):
    g = from_bbox((500000, 5000000, 503200, 5001600), "EPSG:32632", 10)
    pix = np.zeros((g.h, g.w), "int16")
    pix[30:47, 190:210] = 333
    d, r = scene("s", "2020-01-01T10:00:00Z", g, pix)
    lon, lat = C.transform(*map(np.array, g.xy(200, 38.5)), g.crs, "EPSG:4326")
    plan = cube.load([d], spark=spark, crs="EPSG:4326", resolution=0.0001, bbox=(lon - 0.0003, lat - 0.0003, lon + 0.0003, lat + 0.0003), reader=cube.memory_reader(r))
    assert (whole(plan) == 333).all()


def test_load_errors_and_policies(spark):
    g = from_bbox((0, 0, 320, 160), "EPSG:3857", 1)
    d, r = scene("s", "2020-01-01T10:00:00Z", g, np.full((160, 320), 5, "int16"))
    for args in ({"bbox": (0, 0, 1, 1), "x": (0, 1), "y": (0, 1), "crs": 3857, "resolution": 1}, {"lon": (0, 1)}, {"geobox": g, "bbox": (0, 0, 1, 1)}, {"geobox": g, "resolution": 3}):
        with pytest.raises(ValueError):
            cube.load([d], spark=spark, **args)
    with pytest.raises(ValueError, match="empty"):
        cube.load([], spark=spark)
    with pytest.raises(ValueError, match="No such band"):
        cube.load([d], "nope", spark=spark)
    with pytest.raises(Exception, match="mem://s"):
        cube.load([d], spark=spark, reader=cube.memory_reader({})).tiles().collect()
    lenient = cube.load([d], spark=spark, reader=cube.memory_reader({}), fail_on_error=False)
    assert (whole(lenient) == -99).all()
    assert [(r.band, r.t_idx, "mem://s/b1" in r.error) for r in lenient.errors().collect()] == [("b1", 0, True)]
    patched = cube.load([d], spark=spark, reader=cube.memory_reader({"new/s/b1": r["mem://s/b1"]}), patch_url=lambda u: F.regexp_replace(u, "^mem://", "new/"))
    assert (whole(patched) == 5).all()


# --- schemas


def config():
    return {"c": {"assets": {"*": {"data_type": "uint16", "nodata": 0}, "SCL": {"data_type": "uint8", "nodata": 0}}, "aliases": {"rededge1": "B05", "r2": ["visual", 2]}}}


def test_schema_from_items(spark):
    g10, g60 = from_bbox((0, 0, 600, 600), "EPSG:32632", 10), from_bbox((0, 0, 600, 600), "EPSG:32632", 60)
    eo = lambda *names: [{"name": n, "common_name": c} for n, c in names]
    proj = lambda g: {"proj:epsg": 32632, "proj:shape": [g.h, g.w], "proj:transform": [*g.transform, 0, 0, 1], "type": "image/tiff"}
    assets = {
        "visual": {"href": "./v.tif", **proj(g10), "eo:bands": eo(("B04", "red"), ("B03", "green")), "raster:bands": [{"data_type": "uint8"}, {"data_type": "uint8", "nodata": "nan"}]},
        "B04": {"href": "http://h/b4.tif", **proj(g10), "eo:bands": eo(("B04", "red"))}, "B01": {"href": "b1.tif", **proj(g60)}, "SCL": {"href": "scl.tif", **proj(g10)},
        "thumb": {"href": "t.jpg", "type": "image/jpeg", "roles": ["thumbnail"]}, "meta": {"href": "m.xml", "type": "text/xml"},
    }
    late = {**assets, "B05": {"href": "b5.tif", **proj(g60)}}
    docs = [item_document("i1", "2020-01-01T00:00:00Z", collection="c", assets=assets, href="http://h/x/i1.json"), item_document("i2", None, collection="c", assets=late, href="http://h/x/i2.json", properties={"start_datetime": "2020-02-01T00:00:00Z"})]
    parsed = stac.parse_documents(stac.items_from(spark, docs))
    found = infer.collections_of(stac.items_table(parsed), stac.assets_table(parsed), config())
    got = {(r.asset, r.idx): (r.data_type, r.nodata, r.band_pos) for r in found.bands.collect()}
    assert {k: v[:2] for k, v in got.items() if k != ("visual", 2)} == {("visual", 1): ("uint8", 0), ("B04", 1): ("uint16", 0), ("B01", 1): ("uint16", 0), ("SCL", 1): ("uint8", 0), ("B05", 1): ("uint16", 0)}
    assert math.isnan(got["visual", 2][1]) and sorted(got, key=lambda k: got[k][2])[-1] == ("B05", 1)
    al = {}
    for r in found.aliases.orderBy("alias", "rank").collect():
        al.setdefault(r.alias, []).append((r.asset, r.idx))
    assert al == {"red": [("B04", 1), ("visual", 1)], "green": [("visual", 2)], "B03": [("visual", 2)], "rededge1": [("B05", 1)], "r2": [("visual", 2)]}
    assert {r.asset: r.grid_name for r in found.grids.collect()} == {"visual": "default", "B04": "default", "SCL": "default", "B01": "g60", "B05": "g60"}
    src = {(r.item_seq, r.asset, r.idx): r for r in found.sources().collect()}
    assert src[0, "B01", 1].uri == "http://h/x/b1.tif" and src[0, "visual", 2].uri == "http://h/x/v.tif" and src[0, "B04", 1].uri == "http://h/b4.tif"
    assert Grid.of(src[1, "B05", 1].grid) == g60 and (0, "B05", 1) not in src
    p = products.products(found).first()
    assert [json.loads(m)["name"] for m in p.measurements] == ["visual", "visual_2", "B04", "B01", "SCL", "B05"]
    assert json.loads(p.product)["metadata_type"] == "eo3" and json.loads(p.measurements[1])["band"] == 2
    ds = {r.item_seq: r for r in products.datasets(found).collect()}
    assert ds[0].id == str(uuid.uuid5(S.NAMESPACE, "c\ni1\n")) and '"g60"' in ds[0].dataset and "dtr:start_datetime" in ds[1].dataset


def test_proj_fallback_and_collections(spark):
    docs = [item_document("i", "2020-01-01T00:00:00Z", collection="p", assets={"a": {"href": "a.tif", "proj:epsg": 4326}, "b": {"href": "b.tif", "gsd": 10}}, rings=[(0, 0), (3, 0), (3, 1), (0, 1), (0, 0)])]
    parsed = stac.parse_documents(stac.items_from(spark, docs))
    found = infer.collections_of(stac.items_table(parsed), stac.assets_table(parsed))
    assert {r.asset: r.has_proj for r in found.assets.collect()} == {"a": False, "b": False}
    assert abs(found.items.first().lon - 1.5) < 1e-9
    c = '{"type":"Collection","id":"k\\"1","stac_extensions":["item-assets"],"item_assets":{"z":{"type":"image/tiff","roles":["data"]},"a":{"type":"image/tiff"},"e":{}}}'
    sample = stac.parse_documents(stac.collection_items(spark.createDataFrame([(0, c)], "item_seq long, text string")))
    a = stac.assets_table(sample).orderBy("asset_pos").collect()
    assert [(r.asset, r.href, r.collection_id) for r in a] == [("z", "", 'k"1'), ("a", "", 'k"1'), ("e", "", 'k"1')]
    with pytest.raises(Exception, match="item_assets"):
        stac.collection_items(spark.createDataFrame([(0, '{"id":"q"}')], "item_seq long, text string")).collect()


def test_files(spark, tmp_path):
    import json

    docs = [item_document(f"i{k}", "2020-01-01T00:00:00Z", collection="f") for k in range(3)]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": docs[:2]}))
    (tmp_path / "b.json").write_text(json.dumps(docs[2]))
    got = stac.read_items(spark, str(tmp_path))
    assert [r.id for r in stac.items_table(stac.parse_documents(got)).orderBy("item_seq").collect()] == ["i0", "i1", "i2"]
    stac.dump_items(got, str(tmp_path / "out"))
    assert stac.read_item_lines(spark, str(tmp_path / "out")).count() == 3


# --- the rest


def test_settings():
    s = settings.s3_settings(env={"AWS_NO_SIGN_REQUEST": "YES", "AWS_REGION": "xx-1"}, requester_pays=True)
    assert s["spark.hadoop.fs.s3a.endpoint.region"] == "xx-1" and "Anonymous" in s["spark.hadoop.fs.s3a.aws.credentials.provider"]
    s = settings.s3_settings(env={}, credentials={"key": "K", "secret": "S", "token": "T"})
    assert settings.sanitize(s)["spark.hadoop.fs.s3a.secret.key"] == "xx..xx"
    assert not any("session" in k or "secret" in k for k in settings.sanitize(s, no_session_keys=True))
    assert settings.sanitize({"AZURE_SAS": "s", "swift_auth_token": "t", "AZURE_STORAGE_ACCOUNT": "a"}) == {"AZURE_SAS": "xx..xx", "swift_auth_token": "xx..xx", "AZURE_STORAGE_ACCOUNT": "a"}
    waits = []
    assert settings.with_retry(lambda: 7 if len(waits) == 3 else None, sleep=waits.append) == 7 and waits[2] > waits[0]
    settings.register_reader("mine", max)
    assert settings.reader_for("mine") is max and hasattr(settings.reader_for(None), "describe")
    with pytest.raises(ValueError):
        settings.find_region({})


def test_report(spark, tmp_path):
    p = report.LoadParams(scenario="s", chunks=(16, 32), bands=("a",), crs="EPSG:32735", extra={"x": 1})
    assert report.LoadParams.from_json(p.to_json()) == p and p.epsg == 32735 and p.chunks_as_dict() == {"y": 16, "x": 32}
    assert p.compute_args()["x"] == 1 and report.method_of("rastercube.plans.report.default_nodata")("int8") == 0
    c = report.context_of(spark, (1, 3, 100, 50), "uint16", (1, 1, 16, 32), "EPSG:32735", 80, "s")
    assert (c.data_signature, c.chunk_signature, c.nbytes) == ("1.3.100.50.uint16", "1.1.16.32", 30000)
    assert c.row()["chunks_x"] == 32 and c.row()["chunks_y"] == 16
    report.run_bench(lambda: spark.range(10).toDF("i"), c, 2, str(tmp_path / "r"))
    got = report.summary(report.load_results(spark, str(tmp_path / "r"))).first()
    assert got.n == 2 and got.best > 0 and "Mpx/s" in c.render(0, 1, 2)


def test_stream(spark, tmp_path):
    import json

    from rastercube.streaming import ingest

    (tmp_path / "in").mkdir()
    docs = [item_document(f"i{k}", f"2020-01-0{1 + k // 3}T23:30:00Z", collection="s", rings=[(150, 0), (151, 0), (151, 1), (150, 1), (150, 0)]) for k in range(6)]
    docs.append(docs[0])
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, docs)))
    days = ingest.solar_days(ingest.stream_items(ingest.stream_documents(spark, str(tmp_path / "in"))))
    q = days.writeStream.outputMode("complete").format("memory").queryName("days").start() if False else days.writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in/b.json").write_text(json.dumps(item_document("z", "2020-02-01T00:00:00Z", collection="s")))
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.day), r.n_items) for r in spark.sql("SELECT * FROM days").collect()) == [("2020-01-02", 3), ("2020-01-03", 3)]
