"""Pixels: fusing overlapping sources, dense output, nodata, resampling, pasting. As rows and as packed tiles.

Rows (…, y, x, prio, v) stay in generated code and sum up before they are dealt out. Packed tiles (one BINARY a tile)
move a pixel in as many bytes as its type has; numpy handles one tile at a time. ``plans.cube`` chooses between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalar import fill_of, is_float, missing, to_dtype

PLACE = ("band", "t_idx")


# --- rows


def fuse_rows(pixels: DataFrame, dtype: str, nodata: float | None, *, keys: tuple[str, ...] = PLACE, bins: DataFrame | None = None) -> DataFrame:
    """First valid pixel by ``prio`` of rows (*keys, y, x, prio, v), as (*keys, y, x, v).

    Where integers have no nodata value every pixel is valid and only the first source of a tile counts, even where it
    has no pixel: then ``bins`` (*keys, ty, tx, prio) and columns ty, tx of ``pixels`` say which that is; without them
    all pixels of ``keys`` are one tile."""
    at = [*keys, "y", "x"]
    if is_float(dtype) or nodata is not None:
        good = pixels.where(~missing("v", nodata, dtype))
        return good.groupBy(*at).agg(F.min_by("v", "prio").alias("v"))
    tile = [*keys, "ty", "tx"] if bins is not None else list(keys)
    first = (bins if bins is not None else pixels).groupBy(*tile).agg(F.min("prio").alias("prio"))
    return pixels.join(first, [*tile, "prio"]).select(*at, "v")


def first_valid_window(pixels: DataFrame, dtype: str, nodata: float | None, keys: tuple[str, ...] = PLACE) -> DataFrame:
    """The same as a window function: every source row with the value its pixel ends up with."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys, "y", "x").orderBy("prio").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    good = F.when(~missing("v", nodata, dtype), F.col("v"))
    return pixels.withColumn("fused", F.first(good, ignorenulls=True).over(w))


def dense(fused: DataFrame, spine: DataFrame, dtype: str, nodata: float | None, keys: tuple[str, ...] = PLACE) -> DataFrame:
    """Every pixel of ``spine`` (*keys, y, x), with the fill value where there is none."""
    got = spine.join(fused, [*keys, "y", "x"], "left")
    return got.withColumn("v", to_dtype(F.coalesce(F.col("v").cast("double"), F.lit(fill_of(dtype, nodata)).cast("double")), dtype))


def remap(v: Column | str, source: float | None, target: float | None, source_dtype: str, dtype: str) -> Column:
    """Values of a source in terms of the output: its missing pixels become the output's, the rest is cast."""
    v = F.col(v) if isinstance(v, str) else v
    if target is None:
        return to_dtype(v, dtype)
    return F.when(missing(v, source, source_dtype), F.lit(target).cast("double")).otherwise(to_dtype(v, dtype).cast("double"))


def paste(pixels: DataFrame, dy: int | Column, dx: int | Column, h: int | Column, w: int | Column) -> DataFrame:
    """Pixels moved by whole rows and columns, those that leave an output of h by w dropped."""
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    moved = pixels.withColumns({"y": F.col("y") + as_col(dy), "x": F.col("x") + as_col(dx)})
    return moved.where((F.col("y") >= 0) & (F.col("y") < as_col(h)) & (F.col("x") >= 0) & (F.col("x") < as_col(w)))


def resample_rows(pixels: DataFrame, ky: int, kx: int, kind: str, dtype: str, nodata: float | None, keys: tuple[str, ...]) -> DataFrame:
    """Blocks of ky by kx pixels as one. Aggregates leave out missing pixels; ``nearest`` takes the pixel in which the
    centre of the block lies."""
    y, x = F.floor(F.col("y") / ky), F.floor(F.col("x") / kx)
    at = [*keys, y.cast("int").alias("y"), x.cast("int").alias("x")]
    if kind == "nearest":
        hit = (F.col("y") % ky == ky // 2) & (F.col("x") % kx == kx // 2)
        return pixels.where(hit).select(*at, "v")
    good = pixels.where(~missing("v", nodata, dtype))
    v = F.col("v").cast("double")
    if kind == "mode":
        n = good.groupBy(*at, "v").agg(F.count("*").alias("n"))
        return n.groupBy(*keys, "y", "x").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))
    rank = {"med": 0.5, "q1": 0.25, "q3": 0.75}
    if kind in rank:
        agg = F.expr(f"percentile_disc({rank[kind]}) WITHIN GROUP (ORDER BY cast(v AS double))")
    else:
        agg = {"average": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "rms": lambda c: F.sqrt(F.avg(c * c))}[kind](v)
    return good.groupBy(*at).agg(agg.alias("v"))


def tiles_to_rows(tiles: DataFrame, values: str, width: int, *carry: str) -> DataFrame:
    """An array column in row order as pixels (*carry, y, x, v)."""
    return tiles.select(*carry, F.posexplode(values).alias("i", "v")).select(*carry, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "v")


# --- packed tiles


#: A packed tile; without ``data`` it is full of ``fill``.
TILE = "band string, t_idx long, ty int, tx int, h int, w int, dtype string, fill double, data binary"
TILE_ARROW = pa.schema([("band", pa.string()), ("t_idx", pa.int64()), ("ty", pa.int32()), ("tx", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("dtype", pa.string()), ("fill", pa.float64()), ("data", pa.binary())])


def fuse_tiles(parts: DataFrame, spine: DataFrame, dtype: str, nodata: float | None) -> DataFrame:
    """First valid pixel over packed parts (band, t_idx, ty, tx, prio, y, x, h, w, data), each placed at row y and column
    x of its tile, for every tile of ``spine`` (band, t_idx, ty, tx, h, w); tiles without parts hold the fill value.

    One tile's parts meet in one task: as many as overlap there, a tile being small."""
    want = spine.select("band", "t_idx", "ty", "tx", F.col("h").alias("th"), F.col("w").alias("tw"))
    rows = want.join(parts, ["band", "t_idx", "ty", "tx"], "left")

    def run(t: pa.Table) -> pa.Table:
        r = t.sort_by("prio").to_pylist()
        have = [(p["y"], p["x"], kernels.unpack(p["data"], dtype, p["h"], p["w"])) for p in r if p["data"] is not None]
        h, w = r[0]["th"], r[0]["tw"]
        out = kernels.fuse((h, w), dtype, nodata, have)
        first = r[0]
        return pa.table([[first["band"]], [first["t_idx"]], [first["ty"]], [first["tx"]], [h], [w], [dtype], [float(fill_of(dtype, nodata))], [kernels.pack(out)]], schema=TILE_ARROW)

    return rows.groupBy("band", "t_idx", "ty", "tx").applyInArrow(run, TILE)


def unpack_tiles(tiles: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Packed tiles as pixel rows (band, t_idx, y, x, v); a tile without data is full of its fill value."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n = r["h"] * r["w"]
                x = np.full(n, r["fill"]) if r["data"] is None else kernels.unpack(r["data"], r["dtype"], r["h"], r["w"]).ravel()
                yy, xx = np.divmod(np.arange(n), r["w"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(r["band"], pa.string()), n), pa.repeat(pa.scalar(r["t_idx"], pa.int64()), n),
                        pa.array((yy + r["ty"] * tile[0]).astype(np.int32)), pa.array((xx + r["tx"] * tile[1]).astype(np.int32)), pa.array(x.astype(np.float64)),
                    ],
                    names=["band", "t_idx", "y", "x", "v"],
                )

    return tiles.mapInArrow(run, "band string, t_idx long, y int, x int, v double")
