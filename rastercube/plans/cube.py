"""``load``: from items to a cube of pixels.

The planner parses items, infers schemas, settles the output grid (at most two small aggregates are run, as tiles are
numbered by it), groups items into planes, bins footprints onto tiles, and joins bins with sources. All of that is
lazy. Pixels come from a pixel table or a reader; resampling and fusing run once per (band, plane, tile).
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import kernels, outline
from ..functions.scalar import DTYPES, chunks_of, fill_of
from ..operators import bands as B
from ..operators import binning, grids, temporal
from ..operators.grids import Grid
from ..operators.infer import Collections, MDConfig, collections_of
from ..operators.pixels import TILE, TILE_ARROW, unpack_tiles
from ..sources import settings, stac, tiff
from .read import Memory, as_reader, read_onto, source_pixel  # noqa: F401

DEFAULT_TILE = (2048, 2048)
REGION = ("bbox", "geopolygon", "lon", "lat", "x", "y")


@dataclass
class LoadPlan:
    """Everything that a load consists of; ``tiles`` and ``pixels`` are the result, the rest is there to look at."""

    grid: Grid
    tile: tuple[int, int]
    config: dict[str, dict]
    items: DataFrame
    grouped: DataFrame
    spine: DataFrame
    bins: DataFrame
    parts: DataFrame
    reader: object | None = None
    collections: Collections | None = None
    sources: DataFrame | None = None
    notes: dict = field(default_factory=dict)

    @property
    def time(self) -> DataFrame:
        return temporal.time_axis(self.grouped)

    def chunks(self) -> dict[str, tuple[int, ...]]:
        return {"y": chunks_of(self.grid.h, self.tile[0]), "x": chunks_of(self.grid.w, self.tile[1])}

    def coords(self) -> tuple[np.ndarray, np.ndarray]:
        """y and x of pixel centres of a grid without rotation."""
        g = self.grid
        return g.f + g.e * (np.arange(g.h) + 0.5), g.c + g.a * (np.arange(g.w) + 0.5)

    def tiles(self, dense: bool = True) -> DataFrame:
        """Packed tiles (band, t_idx, ty, tx, h, w, dtype, fill, data). A tile without any source has no data and stands
        for its fill value; with ``dense=False`` it is left out."""
        found = fuse_sources(self)
        return (found.unionByName(empty_tiles(self)) if dense else found).drop("errors")

    def errors(self) -> DataFrame:
        """(band, t_idx, ty, tx, error) of sources that were left out, where ``fail_on_error`` is off."""
        return fuse_sources(self).select("band", "t_idx", "ty", "tx", F.explode("errors").alias("error"))

    def pixels(self, dense: bool = True) -> DataFrame:
        """Rows (band, t_idx, y, x, v)."""
        return unpack_tiles(self.tiles(dense), self.tile)

    def write(self, path: str) -> None:
        """The cube as Parquet, by band and plane."""
        self.tiles().write.mode("overwrite").partitionBy("band", "t_idx").parquet(path)

    def write_images(self, path: str, overviews: tuple[int, ...] = (2, 4)) -> DataFrame:
        """Each tile with data as a georeferenced TIFF file with overviews, written where it is fused; a table (uri, band,
        t_idx, ty, tx) of the files. ``path`` is a folder of any of Arrow's file systems that executors share."""
        grid, tile = self.grid, self.tile

        def run(batches):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if r["data"] is None:
                        continue
                    here = grid.crop(r["ty"] * tile[0], r["ty"] * tile[0] + r["h"], r["tx"] * tile[1], r["tx"] * tile[1] + r["w"])
                    uri = f"{path}/{r['band']}-{r['t_idx']}-{r['ty']}-{r['tx']}.tif"
                    x = kernels.unpack(r["data"], r["dtype"], r["h"], r["w"])
                    data = tiff.encode([x], here, None if r["fill"] != r["fill"] else r["fill"], overviews=tuple(k for k in overviews if min(x.shape) >= 2 * k))
                    fs, name = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
                    fs.create_dir(name.rpartition("/")[0])
                    with fs.open_output_stream(name) as f:
                        f.write(data)
                    out.append((uri, r["band"], r["t_idx"], r["ty"], r["tx"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["uri", "band", "t_idx", "ty", "tx"])

        return self.tiles(dense=False).mapInArrow(run, "uri string, band string, t_idx long, ty int, tx int")

    def close(self) -> None:
        """Let go of what the planner kept in memory."""
        if self.sources is not None:
            self.sources.unpersist()
        if self.collections is not None and self.notes.get("own"):
            self.collections.close()

    def explain(self) -> None:
        self.parts.explain("formatted")


# --- output grid


def check_args(**given) -> None:
    """Regions exclude each other, and halves of one need the other half."""
    have = {k for k, v in given.items() if v is not None}
    for whole in (("lon", "lat"), ("x", "y")):
        if len(have & set(whole)) == 1:
            raise ValueError(f"Need both of {whole}")
    kinds = [k for k in (("geobox",), ("like",), ("geopolygon",), ("bbox",), ("lon", "lat"), ("x", "y")) if have & set(k)]
    if len(kinds) > 1:
        raise ValueError(f"These exclude each other: {', '.join('/'.join(k) for k in kinds)}")
    if kinds and kinds[0][0] in ("geobox", "like") and (more := have & {"crs", "resolution", "anchor", "align"}):
        raise ValueError(f"{kinds[0][0]} settles the grid; drop {sorted(more)}")


def norm_geometry(g) -> tuple[list[tuple[float, float]], str]:
    """The outer ring of a polygon and its projection, from GeoJSON (geometry, feature, collection), a pair (ring, crs),
    or an object with ``__geo_interface__``."""
    if isinstance(g, tuple) and len(g) == 2 and isinstance(g[1], str):
        return [tuple(p) for p in g[0]], C.norm_crs(g[1])
    g = getattr(g, "__geo_interface__", g)
    if isinstance(g, dict):
        if g.get("type") == "FeatureCollection" and g.get("features"):
            boxes = [norm_geometry(f)[0] for f in g["features"]]
            xs, ys = zip(*(p for b in boxes for p in b), strict=True)
            x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
            return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], "EPSG:4326"
        if g.get("type") == "Feature":
            return norm_geometry(g.get("geometry"))
        if g.get("type") == "Polygon":
            return [tuple(p[:2]) for p in g["coordinates"][0]], "EPSG:4326"
        if g.get("type") == "MultiPolygon":
            return norm_geometry({"type": "FeatureCollection", "features": [{"type": "Polygon", "coordinates": p} for p in g["coordinates"]]})
    raise ValueError("Not a polygon")


def box_ring(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def ring_bbox(ring) -> tuple[float, float, float, float]:
    xs, ys = zip(*ring, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def region_of(*, bbox=None, geopolygon=None, lon=None, lat=None, x=None, y=None, crs=None) -> tuple[list, str] | None:
    if geopolygon is not None:
        return norm_geometry(geopolygon)
    if bbox is not None:
        return box_ring(*bbox), "EPSG:4326"
    if lon is not None:
        (x0, x1), (y0, y1) = sorted(lon), sorted(lat)
        return box_ring(x0, y0, x1, y1), "EPSG:4326"
    if x is not None:
        if crs is None:
            raise ValueError("x and y need crs")
        (x0, x1), (y0, y1) = sorted(x), sorted(y)
        return box_ring(x0, y0, x1, y1), C.norm_crs(crs)
    return None


def output_grid(spark: SparkSession, items: DataFrame, sources: DataFrame, *, crs=None, resolution=None, anchor=None, align=None, geobox: Grid | None = None, like=None, **region) -> Grid | None:
    """The grid of the output: given, taken from another result, or built over a region or over all items. What is not
    given is the most common of the items' finest grids. An anchor goes before an alignment, and that before the items'.
    None if it cannot be told."""
    check_args(geobox=geobox, like=like, crs=None if "x" in region and region.get("x") is not None else crs, resolution=resolution, anchor=anchor, align=align, **region)
    if geobox is not None:
        return geobox
    if like is not None:
        return like if isinstance(like, Grid) else like.grid
    where = region_of(crs=crs, **region)
    auto = None
    if crs is None or resolution is None or (anchor is None and align is None):
        auto = grids.most_common_grid(grids.finest_grids(sources)).first()
        if auto is not None and crs is None and resolution is None and anchor is None and align is None and where is None and auto.grid is not None:
            return Grid.of(auto.grid)
    if resolution is None and auto is not None and (crs is None or str(crs).lower().startswith("utm") is False and C.norm_crs(crs) == C.norm_crs(auto.crs)):
        resolution = (auto.res_x, auto.res_y)
        crs = crs or auto.crs
    if crs is None:
        crs = where[1] if where else auto.crs if auto is not None else None
    if crs is None or resolution is None:
        return None
    if anchor is None:
        anchor = grids.align_to_anchor(align, resolution)
    if anchor is None:
        anchor = (auto.anchor_x, auto.anchor_y) if auto is not None and not str(crs).lower().startswith("utm") and C.norm_crs(auto.crs) == C.norm_crs(crs) and (auto.res_x, abs(auto.res_y)) == (resolution if isinstance(resolution, tuple) else (resolution, resolution))[:1] + (abs((resolution if isinstance(resolution, tuple) else (resolution, -resolution))[1]),) else grids.EDGE
    if where is not None:
        ring, source = where
        if str(crs).lower().startswith("utm"):
            crs = C.pick_crs(crs, ring_bbox(C.reproject_ring(ring, source, "EPSG:4326")))
        box = ring_bbox(C.reproject_ring(ring, source, C.norm_crs(crs)))
    else:
        if str(crs).lower().startswith("utm"):
            first = items_bbox(items, sources, "EPSG:4326").collect()
            crs = C.pick_crs(crs, tuple(first[0][k] for k in ("x0", "y0", "x1", "y1")))
        got = items_bbox(items, sources, C.norm_crs(crs)).first()
        if got is None or got.x0 is None:
            return None
        box = (got.x0, got.y0, got.x1, got.y1)
    return grids.from_bbox(box, C.norm_crs(crs), resolution, anchor)


def footprints(items: DataFrame, sources: DataFrame, target: Grid | str, *carry: str) -> DataFrame:
    """(item_seq, *carry, footprint): the outline of an item's finest grid, else of its geometry, as rings of points in
    pixels of a grid or in a projection; edges that may bend are cut to a part of the outline's size. Series of
    projections make huge expressions, so numpy does them, a record batch at a time."""
    finest = grids.finest_grids(sources)
    rows = items.select("item_seq", *carry, "geometry").join(finest, "item_seq", "left")
    schema = f"{rows.drop('geometry', 'grid')._jdf.schema().toDDL()}, footprint {outline.RINGS}"
    crs, pixel = (target.crs, target.pixel) if isinstance(target, Grid) else (target, None)

    def run(batches):
        for b in batches:
            got = outline.outlines(b.column("grid"), b.column("geometry"), crs, pixel)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("item_seq", *carry)), got], names=["item_seq", *carry, "footprint"])

    return rows.mapInArrow(run, schema)


def item_tiles(grouped: DataFrame, sources: DataFrame, grid: Grid, tile: tuple[int, int]) -> DataFrame:
    """(t_idx, ty, tx, prio, item_seq): the tiles of the output that the outline of each item meets."""
    carry = ("t_idx", "prio", "item_seq")
    rows = grouped.select(*carry, "geometry").join(grids.finest_grids(sources), "item_seq", "left").select(*carry, "geometry", "grid")
    schema = pa.schema([("t_idx", pa.int64()), ("ty", pa.int32()), ("tx", pa.int32()), ("prio", pa.int64()), ("item_seq", pa.int64())])

    def run(batches):
        for b in batches:
            got = outline.outlines(b.column("grid"), b.column("geometry"), grid.crs, grid.pixel)
            row, ty, tx = outline.tiles_met(got, grid.h, grid.w, tile)
            t, prio, seq = (b.column(c).take(pa.array(row)) for c in carry)
            yield pa.RecordBatch.from_arrays([t, pa.array(ty, pa.int32()), pa.array(tx, pa.int32()), prio, seq], schema=schema)

    return rows.mapInArrow(run, "t_idx long, ty int, tx int, prio long, item_seq long")


def image_geometry(items: DataFrame, sources: DataFrame, crs: str) -> DataFrame:
    """(item_seq, footprint): the outline of an item's finest grid alone, null without one."""
    return footprints(items.withColumn("geometry", F.lit(None).cast(outline.RINGS)), sources, C.norm_crs(crs))


def safe_geometry(items: DataFrame, sources: DataFrame, crs: str) -> DataFrame:
    """(item_seq, footprint): the outline of an item's finest grid, else its geometry."""
    return footprints(items, sources, C.norm_crs(crs))


def items_bbox(items: DataFrame, sources: DataFrame, crs: str) -> DataFrame:
    """Union box of all footprints in a projection."""
    f = footprints(items, sources, crs)
    points = F.flatten("footprint")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return grids.union_bbox(f.where("footprint IS NOT NULL").select(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


# --- load


def load(
    items, bands=None, *, spark: SparkSession | None = None, groupby="time", resampling=None, dtype=None, chunks: dict | None = None, crs=None, resolution=None, anchor=None, align=None,
    geobox=None, like=None, geopolygon=None, bbox=None, lon=None, lat=None, x=None, y=None, preserve_original_order: bool = False, fail_on_error: bool = True, use_overviews: bool = True,
    nodata=None, stac_cfg: dict | None = None, patch_url=None, reader=None, measurements=None, output_crs=None, progress=None, pool=None, debug=None, **_,
) -> LoadPlan:
    """Plan a cube of pixels. ``items``: documents (dicts or texts), a table (item_seq, text), or ``Collections``.

    ``reader``: a reader (see ``plans.read``), the name of a registered one, or None for TIFF files. ``pool``: how many
    tasks fuse tiles, else Spark's own number. ``measurements`` and ``output_crs`` are older names of ``bands`` and
    ``crs``. ``progress`` and ``debug`` are accepted: Spark reports and explains by itself.

    One small job settles the bands; a second and third find the grid where it is not given. All else is lazy."""
    bands = bands if bands is not None else measurements
    crs = crs if crs is not None else output_crs
    groupby = "id" if groupby is None else groupby
    spark = spark or SparkSession.active()
    own = not isinstance(items, Collections)
    if own:
        docs = items if isinstance(items, DataFrame) else list(items)
        if docs.isEmpty() if isinstance(docs, DataFrame) else not docs:
            raise ValueError("Can't load empty sequence")
        parsed = stac.parse_documents(docs if isinstance(docs, DataFrame) else stac.items_from(spark, docs))
        found = collections_of(stac.items_table(parsed).persist(), stac.assets_table(parsed), MDConfig(stac_cfg or {}))
    else:
        found = items
    resolved = B.resolve_bands(B.band_query(spark, bands), found.bands, found.aliases, outer=True)
    # as many rows as bands are asked for, a collection; and which collection comes first
    order = found.assets.groupBy("collection_id").agg(F.min("first_seq").alias("first_seq"))
    named = resolved.join(order, "collection_id", "left").collect()
    if lost := [r for r in named if r.asset is None]:
        first = min(named, key=lambda r: (r.first_seq is None, r.first_seq or 0)).collection_id
        if unknown := [r.query for r in lost if r.collection_id == first]:
            raise ValueError(f"No such band: {', '.join(unknown)}")
    known = sorted((r for r in named if r.asset is not None), key=lambda r: (r.pos, r.collection_id))
    options = {"resampling": resampling, "dtype": dtype, "nodata": nodata, "use_overviews": use_overviews, "fail_on_error": fail_on_error}
    config = {q: B.band_config(q, *next((r.data_type, r.nodata) for r in known if r.query == q), **options) for q in dict.fromkeys(r.query for r in known)}
    wanted = found.sources(fail_on_error).join(F.broadcast(_rows(spark, known)), ["collection_id", "asset", "idx"])
    if geobox is None and like is None:
        wanted = wanted.persist()  # read by the jobs that find the grid, and by the load
    grid = output_grid(spark, found.items, wanted, crs=crs, resolution=resolution, anchor=anchor, align=align, geobox=geobox, like=like, geopolygon=geopolygon, bbox=bbox, lon=lon, lat=lat, x=x, y=y)
    if grid is None:
        raise ValueError("Failed to auto-guess CRS/resolution")
    if patch_url is not None:
        wanted = B.patch_urls(wanted, patch_url)
    x0, y0, x1, y1 = ring_bbox(C.reproject_ring(box_ring(*grid.bbox()), grid.crs, "EPSG:4326"))
    usable = found.items.where("ts IS NOT NULL") if not fail_on_error else found.items.withColumn("ts", F.coalesce("ts", F.raise_error(F.lit("Item has no timestamp")).cast("timestamp")))
    grouped = temporal.group_items(usable, groupby, lon=(x0 + x1) / 2, preserve_order=preserve_original_order)
    tile = chunk_shape(grid, chunks, config)
    spine = binning.tile_spine(spark, grid, tile)

    bins = item_tiles(grouped, wanted, grid, tile)
    # only what a task needs goes on: no metadata of items, no assets that nobody asked for
    parts = bins.join(wanted.select("item_seq", "band", "asset", "idx", "uri", "grid"), "item_seq")
    return LoadPlan(grid, tile, config, found.items, grouped, spine, bins, parts, as_reader(settings.reader_for(reader)), found, wanted, {"debug": debug, "pool": pool, "own": own})


def _rows(spark: SparkSession, known: list) -> DataFrame:
    """Which asset and band of a collection each queried band is: rows that the planner holds already."""
    each = [F.struct(F.lit(r.collection_id).alias("collection_id"), F.lit(r.query).alias("band"), F.lit(r.asset).alias("asset"), F.lit(r.idx).cast("int").alias("idx")) for r in known]
    if not each:
        return spark.createDataFrame([], "collection_id string, band string, asset string, idx int")
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*each)))


def chunk_shape(grid: Grid, chunks: dict | None, config: dict) -> tuple[int, int]:
    """Rows and columns of a tile: by name of the dimension (y, x or latitude, longitude); -1 is all; ``auto`` fills about
    128 MiB of the widest type; without chunks, 2048 by 2048."""
    if chunks is None:
        return min(DEFAULT_TILE[0], grid.h), min(DEFAULT_TILE[1], grid.w)
    width = max((DTYPES[c["dtype"]][3] for c in config.values()), default=2)
    side = 1 << int(math.log2(math.sqrt((128 << 20) / width)))
    out = []
    for names, n in ((("y", "latitude", "lat"), grid.h), (("x", "longitude", "lon"), grid.w)):
        c = next((chunks[k] for k in names if k in chunks), -1)
        c = side if c == "auto" else c
        out.append(n if c < 1 or c > n else int(c))
    return out[0], out[1]


#: What may be wrong with a source, besides mistakes in the program.
SOURCE_ERRORS = (OSError, ValueError, zlib.error, struct.error)


def fuse_sources(plan: LoadPlan) -> DataFrame:
    """Read, resample and fuse the tiles that any source meets: one task's work is one (band, plane, tile)."""
    grid, tile, cfg, reader = plan.grid, plan.tile, plan.config, plan.reader

    def run(tbl: pa.Table) -> pa.Table:
        r = tbl.sort_by("prio").to_pylist()
        f = r[0]
        c = cfg[f["band"]]
        y0, x0 = f["ty"] * tile[0], f["tx"] * tile[1]
        here = grid.crop(y0, min(grid.h, y0 + tile[0]), x0, min(grid.w, x0 + tile[1]))
        parts, errors = [], []
        for p in r:
            try:
                got = read_onto(reader, p["uri"], p["idx"], Grid.of(p["grid"]), here, c)
            except SOURCE_ERRORS as e:
                if c["fail_on_error"]:
                    raise
                errors.append(f"{p['uri']}: {type(e).__name__}: {e}")
                continue
            if got is not None:
                parts.append(got)
        out = kernels.fuse((here.h, here.w), c["dtype"], c["fill_value"], parts)
        fill = float(fill_of(c["dtype"], c["fill_value"]))
        # a tile that no source has a pixel in needs no data
        data = kernels.pack(out) if parts else None
        return pa.table([[f["band"]], [f["t_idx"]], [f["ty"]], [f["tx"]], [here.h], [here.w], [c["dtype"]], [fill], [data], [errors or None]], schema=_FUSED)

    parts = plan.parts
    if plan.notes.get("pool"):
        parts = parts.repartition(int(plan.notes["pool"]), "band", "t_idx", "ty", "tx")
    return parts.groupBy("band", "t_idx", "ty", "tx").applyInArrow(run, f"{TILE}, errors array<string>")


_FUSED = TILE_ARROW.append(pa.field("errors", pa.list_(pa.string())))


def empty_tiles(plan: LoadPlan) -> DataFrame:
    """The tiles of the cube that no source meets, without data: their number is that of the output's tiles, and they
    are not shuffled with those that have pixels."""
    each = [F.struct(F.lit(b).alias("band"), F.lit(c["dtype"]).alias("dtype"), F.lit(float(fill_of(c["dtype"], c["fill_value"]))).alias("fill")) for b, c in plan.config.items()]
    t = plan.grouped.select("t_idx").distinct()
    full = plan.spine.select("ty", "tx", "h", "w", F.inline(F.array(*each))).join(t)
    met = plan.parts.select("band", "t_idx", "ty", "tx").distinct()
    return full.join(met, ["band", "t_idx", "ty", "tx"], "left_anti").select("band", "t_idx", "ty", "tx", "h", "w", "dtype", "fill", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("array<string>").alias("errors"))


def memory_reader(rasters: dict[str, tuple]) -> Memory:
    """A reader over arrays: uri to (pixels or list of bands, grid, nodata)."""
    return Memory(rasters)
