"""Output tiles, and which items fall into which.

A footprint's box gives the range of tile numbers by arithmetic, which ``sequence`` and ``explode`` turn into rows: no
join on inequalities. An exact test of polygon against tile follows where it matters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import projection
from .grids import Grid

TOUCH = 1e-9


def tile_count(grid: Grid, tile: tuple[int, int]) -> tuple[int, int]:
    return math.ceil(grid.h / tile[0]), math.ceil(grid.w / tile[1])


def tile_spine(spark: SparkSession, grid: Grid, tile: tuple[int, int]) -> DataFrame:
    """Every tile of a grid: ty, tx, its pixel window y0, y1, x0, x1, its size h, w."""
    ny, nx = tile_count(grid, tile)
    t = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("ty"), (F.col("id") % nx).cast("int").alias("tx"))
    return windows(t, grid, tile)


def windows(tiles: DataFrame, grid: Grid, tile: tuple[int, int]) -> DataFrame:
    t = tiles.withColumns({"y0": F.col("ty") * tile[0], "x0": F.col("tx") * tile[1]})
    t = t.withColumns({"y1": F.least(F.lit(grid.h), F.col("y0") + tile[0]), "x1": F.least(F.lit(grid.w), F.col("x0") + tile[1])})
    return t.withColumns({"h": F.col("y1") - F.col("y0"), "w": F.col("x1") - F.col("x0")})


def to_pixels(x: Column, y: Column, crs: str, grid: Grid) -> tuple[Column, Column]:
    """Coordinates in a projection as (col, row) of a grid."""
    if crs != grid.crs:
        x, y = projection(grid.crs).forward(*projection(crs).inverse(x, y))
    det = grid.a * grid.e - grid.b * grid.d
    x, y = x - F.lit(grid.c), y - F.lit(grid.f)
    return (grid.e * x - grid.b * y) / det, (grid.a * y - grid.d * x) / det


def footprint_pixels(rings: Column, crs: str, grid: Grid) -> Column:
    """A ring of (x, y) points as a ring in pixels of a grid, each edge cut in eight so that it may bend."""
    n = F.size(rings)
    pairs = F.zip_with(F.slice(rings, 1, n - 1), F.slice(rings, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    k = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i / 8.0)
    pts = F.flatten(F.transform(pairs, lambda p: F.transform(k, lambda t: F.struct((p["x0"] + (p["x1"] - p["x0"]) * t).alias("x"), (p["y0"] + (p["y1"] - p["y0"]) * t).alias("y")))))

    def move(p: Column) -> Column:
        px, py = to_pixels(p["x"], p["y"], crs, grid)
        return F.struct(px.alias("x"), py.alias("y"))

    return F.transform(pts, move)


def bin_items(items: DataFrame, grid: Grid, tile: tuple[int, int], *, exact: bool = True) -> DataFrame:
    """(…, ty, tx) for each tile of ``grid`` that the ``footprint`` of an item meets, once: a ring of points in pixels
    without its closing point, or an array of such rings. Touching edges do not count. With ``exact``, tiles in the
    corners of a slanted ring's box do not either: by the separating axes of the ring's edges, which decides convex
    rings and keeps others by their box or hull at worst. Rings that are their own box need no test."""
    fp = F.col("footprint")
    if not items.schema["footprint"].dataType.simpleString().startswith("array<array"):
        fp = F.when(fp.isNotNull(), F.array(fp))
    ny, nx = tile_count(grid, tile)
    lo = lambda v, size: F.greatest(F.lit(0), F.floor(F.array_min(v) / size + TOUCH)).cast("int")
    hi = lambda v, size, n: F.least(F.lit(n - 1), F.ceil(F.array_max(v) / size - TOUCH) - 1).cast("int")

    def numbers(r: Column) -> Column:
        xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
        return F.struct(lo(ys, tile[0]).alias("y0"), hi(ys, tile[0], ny).alias("y1"), lo(xs, tile[1]).alias("x0"), hi(xs, tile[1], nx).alias("x1"))

    def tiles_of(b: Column) -> Column:
        row = lambda y: F.transform(F.sequence(b["x0"], b["x1"]), lambda x: F.struct(y.alias("ty"), x.alias("tx")))
        return F.flatten(F.transform(F.sequence(b["y0"], b["y1"]), row))

    some = F.filter(fp, lambda r: F.size(r) > 0)
    boxes = F.filter(F.transform(some, numbers), lambda b: (b["y0"] <= b["y1"]) & (b["x0"] <= b["x1"]))
    t = items.withColumn("_rings", some).withColumn("_boxes", boxes).where("size(_boxes) > 0")
    met = F.flatten(F.transform("_boxes", tiles_of))
    t = t.withColumn("_t", F.explode(F.when(F.size("_boxes") > 1, F.array_distinct(met)).otherwise(met)))
    t = t.withColumns({"ty": F.col("_t.ty"), "tx": F.col("_t.tx")})
    if exact:
        edges = F.col("tx") * tile[1], F.col("ty") * tile[0], F.least(F.lit(grid.w), (F.col("tx") + 1) * tile[1]), F.least(F.lit(grid.h), (F.col("ty") + 1) * tile[0])
        one = upright(F.col("_rings")[0]) | convex_meets(F.col("_rings")[0], *edges)
        t = t.where(F.when(F.size("_rings") == 1, one).otherwise(F.exists("_rings", lambda r: box_meets(r, *edges) & convex_meets(r, *edges))))
    return t.drop("_rings", "_boxes", "_t")


def upright(r: Column) -> Column:
    """Whether a ring of four points is a rectangle along the axes."""
    side = lambda i, j: (r[i]["x"] == r[j]["x"]) | (r[i]["y"] == r[j]["y"])
    return (F.size(r) == 4) & side(0, 1) & side(1, 2) & side(2, 3) & side(3, 0)


def box_meets(r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return (F.array_min(xs) < x1) & (F.array_max(xs) > x0) & (F.array_min(ys) < y1) & (F.array_max(ys) > y0)


def convex_meets(r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a rectangle meets a ring: false if an edge of the ring has all of the ring on one side of it, and all of
    the rectangle on the other."""
    nxt = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    corners = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x in (x0, x1) for y in (y0, y1)])

    def side(p: Column, q: Column, c: Column) -> Column:
        return (q["x"] - p["x"]) * (c["y"] - p["y"]) - (q["y"] - p["y"]) * (c["x"] - p["x"])

    def apart(e: Column) -> Column:
        p, q = e["p"], e["q"]
        length = F.abs(q["x"] - p["x"]) + F.abs(q["y"] - p["y"])
        own = F.transform(r, lambda c: side(p, q, c))
        box = F.transform(corners, lambda c: side(p, q, c))
        tol = length * 1e-7
        left = (F.array_min(own) >= -tol) & (F.array_max(box) <= tol)
        right = (F.array_max(own) <= tol) & (F.array_min(box) >= -tol)
        return (length > 0) & (left | right)

    edges = F.zip_with(r, nxt, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return ~F.exists(edges, apart)


def tile_bins(binned: DataFrame) -> DataFrame:
    """(t_idx, ty, tx) with the items of each in order of ``prio``."""
    order = F.sort_array(F.collect_list(F.struct("prio", "item_seq")))
    return binned.groupBy("t_idx", "ty", "tx").agg(F.transform(order, lambda x: x["item_seq"]).alias("items"))


def dense_bins(bins: DataFrame, spine: DataFrame, t_indexes: DataFrame) -> DataFrame:
    """All planes by all tiles (the output itself, not pairs of rows), with empty lists where nothing falls."""
    full = t_indexes.select("t_idx").join(spine.select("ty", "tx"))
    return full.join(bins, ["t_idx", "ty", "tx"], "left").withColumn("items", F.coalesce("items", F.expr("cast(array() AS array<bigint>)")))
