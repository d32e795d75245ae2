"""Pixel grids: shape, affine, projection. Columns over a grid struct, and a small Python twin for the planner.

A grid maps pixel (col, row) to (a * col + b * row + c, d * col + e * row + f) in ``crs``. All six terms are carried, so
rotated grids work everywhere; snapping and alignment are for grids without rotation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import col, short_number

GRID = "struct<h:int,w:int,a:double,b:double,c:double,d:double,e:double,f:double,crs:string>"
EDGE, CENTER = (0.0, 0.0), (0.5, 0.5)
#: Part of a pixel by which an edge may miss a pixel boundary and still be on it.
SNAP = 1e-6


@dataclass(frozen=True)
class Grid:
    h: int
    w: int
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    crs: str

    @property
    def transform(self) -> tuple[float, ...]:
        return self.a, self.b, self.c, self.d, self.e, self.f

    def xy(self, px: float, py: float) -> tuple[float, float]:
        return self.a * px + self.b * py + self.c, self.d * px + self.e * py + self.f

    def pixel(self, x: float, y: float) -> tuple[float, float]:
        det = self.a * self.e - self.b * self.d
        x, y = x - self.c, y - self.f
        return (self.e * x - self.b * y) / det, (self.a * y - self.d * x) / det

    @property
    def resolution(self) -> float:
        return min(abs(self.a), abs(self.e))

    def bbox(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(self.xy(px, py) for px in (0, self.w) for py in (0, self.h)), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def crop(self, y0: int, y1: int, x0: int, x1: int) -> Grid:
        c, f = self.xy(x0, y0)
        return replace(self, h=y1 - y0, w=x1 - x0, c=c, f=f)

    def pad(self, n: int) -> Grid:
        return self.crop(-n, self.h + n, -n, self.w + n)

    def rotated(self, degrees: float) -> Grid:
        """The grid turned about the origin of its projection, as rotation times grid does."""
        s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
        return replace(self, a=c * self.a - s * self.d, b=c * self.b - s * self.e, c=c * self.c - s * self.f, d=s * self.a + c * self.d, e=s * self.b + c * self.e, f=s * self.c + c * self.f)

    def zoom_out(self, k: float) -> Grid:
        return replace(self, h=max(1, math.ceil(self.h / k)), w=max(1, math.ceil(self.w / k)), a=self.a * k, b=self.b * k, d=self.d * k, e=self.e * k)

    def anchor(self, tol: float = 1e-3) -> tuple[float, float]:
        """Where the origin of the projection lies inside a pixel; near an edge or the centre, there."""

        def part(v: float) -> float:
            v = v - math.floor(v)
            return 0.0 if v < tol or 1 - v < tol else 0.5 if abs(v - 0.5) < tol else v

        px, py = self.pixel(0.0, 0.0)
        return part(px), part(py)

    def column(self) -> Column:
        return F.struct(*[F.lit(getattr(self, k)).cast(t).alias(k) for k, t in (x.split(":") for x in GRID[7:-1].split(","))])

    @staticmethod
    def of(row) -> Grid | None:
        return None if row is None else Grid(*(row[k] for k in ("h", "w", "a", "b", "c", "d", "e", "f", "crs")))


def snap(lo: float, hi: float, res: float, off: float) -> tuple[float, int]:
    """Pixel boundaries at (n + off) * |res| around an interval: the lower end and the number of pixels, one or more."""
    r = abs(res)
    first = math.floor(lo / r - off + SNAP)
    last = math.ceil(hi / r - off - SNAP)
    return (first + off) * r, max(1, last - first)


def from_bbox(bbox: tuple[float, float, float, float], crs: str, resolution: float | tuple[float, float], anchor: tuple[float, float] | str = EDGE) -> Grid:
    """The grid that covers a box. A scalar resolution r is (x: r, y: -r). ``anchor``: ``edge``, ``center``, the part of
    a pixel at which the projection's origin lies, or ``floating`` to begin at the box itself."""
    rx, ry = resolution if isinstance(resolution, tuple) else (resolution, -resolution)
    x0, y0, x1, y1 = bbox
    if anchor == "floating":
        w, h = max(1, math.ceil((x1 - x0) / abs(rx) - SNAP)), max(1, math.ceil((y1 - y0) / abs(ry) - SNAP))
        return Grid(h, w, rx, 0.0, x0 if rx > 0 else x1, 0.0, ry, y1 if ry < 0 else y0, crs)
    ax, ay = {"edge": EDGE, "center": CENTER}[anchor] if isinstance(anchor, str) else anchor
    # the origin lies at `anchor` of a pixel, so boundaries lie at (n - anchor) pixels, counted along each axis's sign
    x, w = snap(x0, x1, rx, -ax if rx > 0 else ax)
    y, h = snap(y0, y1, ry, -ay if ry > 0 else ay)
    return Grid(h, w, float(rx), 0.0, x if rx > 0 else x + w * abs(rx), 0.0, float(ry), y + h * abs(ry) if ry < 0 else y, crs)


def align_to_anchor(align: float | tuple[float, float] | None, resolution: float | tuple[float, float]) -> tuple[float, float] | None:
    """An alignment in units of the projection as a part of a pixel."""
    if align is None:
        return None
    ax, ay = align if isinstance(align, tuple) else (align, align)
    rx, ry = resolution if isinstance(resolution, tuple) else (resolution, -resolution)
    return (ax / abs(rx)) % 1.0, (ay / abs(ry)) % 1.0


# --- columns


def grid_of(h, w, a, b, c, d, e, f, crs) -> Column:
    return F.struct(*[col(x).cast(t).alias(k) for x, (k, t) in zip((h, w, a, b, c, d, e, f, crs), (y.split(":") for y in GRID[7:-1].split(",")), strict=True)])


def gsd(grid: Column | str) -> Column:
    g = col(grid)
    return F.least(F.abs(g["a"]), F.abs(g["e"]))


def grid_bbox(grid: Column | str) -> Column:
    """Bounding box of a grid's four corners, as a struct."""
    g = col(grid)
    xs = [g["a"] * px + g["b"] * py + g["c"] for px in (F.lit(0), g["w"]) for py in (F.lit(0), g["h"])]
    ys = [g["d"] * px + g["e"] * py + g["f"] for px in (F.lit(0), g["w"]) for py in (F.lit(0), g["h"])]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def grid_anchor(grid: Column | str, tol: float = 1e-3) -> Column:
    """As ``Grid.anchor``: parts of a pixel in x and y."""
    g = col(grid)
    det = g["a"] * g["e"] - g["b"] * g["d"]

    def part(v: Column) -> Column:
        v = v - F.floor(v)
        return F.when((v < tol) | (1 - v < tol), 0.0).when(F.abs(v - 0.5) < tol, 0.5).otherwise(v)

    return F.struct(part((g["b"] * g["f"] - g["e"] * g["c"]) / det).alias("x"), part((g["d"] * g["c"] - g["a"] * g["f"]) / det).alias("y"))


def one_pixel(bbox: Column | str, crs: Column | str) -> Column:
    """A grid of one pixel over a box."""
    b = col(bbox)
    zero = F.lit(0.0)
    return grid_of(F.lit(1), F.lit(1), b["x1"] - b["x0"], zero, b["x0"], zero, b["y0"] - b["y1"], b["y1"], crs)


def asset_grid(shape: Column, transform: Column, crs: Column) -> Column:
    """A grid from projection metadata: a shape (rows, columns), six terms of an affine or nine with (0, 0, 1) last, and
    a projection; fails with what is wrong."""
    fail = lambda m: F.raise_error(F.lit(m)).cast(GRID)
    t = lambda i: F.get(transform, F.lit(i))
    n = F.size(transform)
    good = grid_of(F.get(shape, F.lit(0)), F.get(shape, F.lit(1)), t(0), t(1), t(2), t(3), t(4), t(5), crs)
    return (
        F.when(shape.isNull() | transform.isNull(), fail("Asset has no shape or transform"))
        .when(crs.isNull(), fail("Asset has no projection"))
        .when(~n.isin(6, 9), fail("Transform must have 6 or 9 terms"))
        .when((n == 9) & ~((t(6) == 0) & (t(7) == 0) & (t(8) == 1)), fail("Transform is not affine"))
        .otherwise(good)
    )


# --- grids of a collection


def name_grids(rows: DataFrame, grid: str = "grid", part: list[str] | None = None) -> DataFrame:
    """``rows`` (collection_id, asset, asset_pos, ``grid``) with ``grid_name``.

    The grid of most assets is ``default`` (of equals the finest, then the one seen first); others are ``g<gsd>``, and
    those whose name is taken already get ``-<first asset>`` added. With numbers for grids, these are the gsd."""
    part = part or ["collection_id"]
    numeric = not rows.schema[grid].dataType.simpleString().startswith("struct")
    size = F.coalesce(F.col(grid).cast("double"), F.lit(0.0)) if numeric else gsd(grid)
    g = rows.groupBy(*part, grid).agg(F.count("*").alias("n"), F.min("asset_pos").alias("pos"), F.min_by("asset", "asset_pos").alias("first_asset")).withColumn("gsd", size)
    rank = F.row_number().over(W.partitionBy(*part).orderBy(F.desc("n"), "gsd", "pos"))
    g = g.withColumn("rank", rank).withColumn("plain", F.concat(F.lit("g"), short_number("gsd")))
    taken = F.row_number().over(W.partitionBy(*part, "plain", F.col("rank") == 1).orderBy("pos"))
    name = F.when(F.col("rank") == 1, "default").when(taken == 1, F.col("plain")).otherwise(F.concat_ws("-", "plain", "first_asset"))
    g = g.withColumn("grid_name", name).select(*[F.col(p).alias(f"_{p}") for p in part], F.col(grid).alias("_g"), "grid_name")
    on = F.col(grid).eqNullSafe(F.col("_g"))
    for p in part:
        on = on & F.col(p).eqNullSafe(F.col(f"_{p}"))
    return rows.join(g, on).drop("_g", *[f"_{p}" for p in part])


def most_common_grid(grids: DataFrame, thresh: float = 0.1) -> DataFrame:
    """One row (crs, res_x, res_y, anchor_x, anchor_y, grid) for rows (item_seq, grid).

    If all are one grid, ``grid`` is it. Else the most frequent (crs, resolution, anchor), if more than ``thresh`` of
    all have it; else the most frequent (crs, resolution) with the anchor at the edge. Of equals, the first seen."""
    x = grids.where("grid is not null").select("item_seq", "grid", F.col("grid.crs").alias("crs"), F.col("grid.a").alias("res_x"), F.col("grid.e").alias("res_y"), grid_anchor("grid").alias("anchor"))
    fine = x.groupBy("crs", "res_x", "res_y", "anchor").agg(F.count("*").alias("n"), F.min("item_seq").alias("seq"), F.min_by("grid", "item_seq").alias("g"), F.count_distinct("grid").alias("kinds"))
    best = lambda keys, n="n", seq="seq": F.max_by(F.struct(*keys), F.struct(F.col(n), -F.col(seq)))
    coarse = fine.groupBy("crs", "res_x", "res_y").agg(F.sum("n").alias("cn"), F.min("seq").alias("cseq")).agg(best(["crs", "res_x", "res_y"], "cn", "cseq").alias("coarse"))
    top = fine.agg(best(["crs", "res_x", "res_y", "anchor"]).alias("fine"), F.max("n").alias("n"), F.sum("n").alias("total"), F.count("*").alias("groups"), F.max("kinds").alias("kinds"), F.min_by("g", "seq").alias("g"))
    x = top.crossJoin(coarse)  # one row by one row
    same = (F.col("groups") == 1) & (F.col("kinds") == 1)
    often = F.col("n") / F.col("total") > thresh
    pick = lambda k: F.when(often, F.col(f"fine.{k}")).otherwise(F.col(f"coarse.{k}"))
    return x.where("total > 0").select(
        *[pick(k).alias(k) for k in ("crs", "res_x", "res_y")],
        F.when(often, F.col("fine.anchor.x")).otherwise(0.0).alias("anchor_x"), F.when(often, F.col("fine.anchor.y")).otherwise(0.0).alias("anchor_y"),
        F.when(same, F.col("g")).alias("grid"),
    )


def finest_grids(sources: DataFrame) -> DataFrame:
    """The finest grid of each item (item_seq, grid) over its sources (item_seq, band_pos, grid)."""
    x = sources.where("grid is not null")
    return x.groupBy("item_seq").agg(F.min_by("grid", F.struct(gsd("grid"), F.col("band_pos"))).alias("grid"))


def item_grids(sources: DataFrame) -> DataFrame:
    """Distinct grids of each item, the finest first."""
    x = sources.where("grid is not null").groupBy("item_seq", "grid").agg(F.min("band_pos").alias("pos"))
    order = W.partitionBy("item_seq").orderBy(gsd("grid"), "pos")
    return x.withColumn("rank", F.row_number().over(order) - 1).drop("pos")


def union_bbox(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Union of boxes (x0, y0, x1, y1)."""
    return boxes.groupBy(*(by or [])).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
