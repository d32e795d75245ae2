"""Grouping of items into time planes.

Items are rows with ``item_seq`` (their input position), ``id``, ``ts`` (nominal time) and, for solar days, ``lon``.
A plane is a group; ``t_idx`` numbers planes by key and ``prio`` orders the items of a plane, the first being on top.

Planes are numbered over the distinct keys, by ranges: a window over all items or keys would be one task.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import solar_day

Key = str | Column | Callable[[], Column] | None


def group_key(groupby: Key, lon: float | Column | None = None) -> Column:
    """The column by which items are grouped.

    ``None`` and ``"id"``: each item is a plane, in input order. ``"time"``: equal nominal times. ``"solar_day"``: local
    solar dates, at one longitude if ``lon`` is given, else at each item's. Any other string: a property of that name
    in the ``properties`` VARIANT; lists and objects compare as JSON. A column, or a function that returns one: itself.
    """
    if groupby is None or (isinstance(groupby, str) and groupby == "id"):
        return F.col("item_seq")
    if isinstance(groupby, Column):
        return groupby
    if callable(groupby):
        return groupby() if not inspect.signature(groupby).parameters else called_key(groupby)
    if groupby == "time":
        return F.col("ts")
    if groupby == "solar_day":
        at = F.col("lon") if lon is None else lon if isinstance(lon, Column) else F.lit(float(lon))
        return solar_day("ts", at)
    return property_key(groupby)


def called_key(f: Callable) -> Column:
    """``f(item, parsed, idx)`` as a key: ``item`` is the item's row with ``properties`` as a dict, ``parsed`` the same, ``idx``
    its input position. Numbers come before texts, each in its own order."""

    @F.udf("struct<number:double,text:string>")
    def key(row, idx):
        item = {**row.asDict(), "properties": json.loads(row["properties"] or "{}")}
        got = f(item, item, idx)
        number = isinstance(got, int | float) and not isinstance(got, bool)
        return (float(got), None) if number else (None, None if got is None else str(got))

    row = F.struct("id", "collection_id", "ts", "lon", F.to_json("properties").alias("properties"))
    return key(row, F.col("item_seq"))


def property_key(name: str, properties: str = "properties") -> Column:
    """A property in a form that can be grouped and ordered: numbers before texts, each in its own order."""
    path = "$['" + name.replace("'", "\\'") + "']"
    number = F.try_variant_get(F.col(properties), path, "double")
    text = F.try_variant_get(F.col(properties), path, "string")
    return F.struct(number.alias("number"), F.when(number.isNull(), text).alias("text"))


def number_planes(items: DataFrame, key: Column) -> DataFrame:
    """``items`` with ``key`` and ``t_idx``: the rank of the key, nulls first, from 0.

    Ranks are over distinct keys, in two steps, as there may be as many as items: keys are dealt out by range, each task
    numbers its own, and the sizes of the ranges, one row a task, say where each begins."""
    keyed = items.withColumn("key", key)
    ranks = ranked(keyed.select("key").distinct(), F.col("key").asc_nulls_first())
    return keyed.join(ranks.withColumnRenamed("key", "_k"), keyed["key"].eqNullSafe(F.col("_k"))).drop("_k")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``t_idx``, their place in the order from 0. ``monotonically_increasing_id`` over sorted ranges has the
    range in its upper bits and the place inside it in the lower 33. The sorted rows are kept, as the sizes of the ranges
    and the rows must come of one sort: of two, ranges may differ, and the join would lose rows."""
    at = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", start.alias("_start"))  # a row a task
    return at.withColumn("_part", part).join(starts, "_part").withColumn("t_idx", F.col("_start") + place).drop("_at", "_part", "_start")


def group_items(items: DataFrame, groupby: Key = "time", lon: float | Column | None = None, preserve_order: bool = False) -> DataFrame:
    """``items`` with ``key``, ``t_idx`` and ``prio`` (from 0).

    Inside a plane items go by (time, id), ties by input position; with ``preserve_order`` by input position alone."""
    planes = number_planes(items, group_key(groupby, lon))
    order = ["item_seq"] if preserve_order else ["ts", "id", "item_seq"]
    return planes.withColumn("prio", (F.row_number().over(W.partitionBy("t_idx").orderBy(*order)) - 1).cast("long"))


def time_axis(grouped: DataFrame) -> DataFrame:
    """t_idx and time, the nominal time of the first item of each plane, without a time zone (UTC)."""
    return grouped.groupBy("t_idx").agg(F.min_by("ts", "prio").cast("timestamp_ntz").alias("time"), F.count("*").alias("n_items"))


def planes(grouped: DataFrame) -> DataFrame:
    """t_idx and the items of each plane in order."""
    return grouped.groupBy("t_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("prio", "item_seq"))), lambda x: x["item_seq"]).alias("items"))


def mid_longitude(rings: Column | str) -> Column:
    """Longitude of the centroid of polygons given as rings of (x, y) points, by the shoelace formula; for rings without
    area, the mean of their points; null without any."""
    rs = F.col(rings) if isinstance(rings, str) else rings

    def sums(r: Column) -> Column:
        n = F.size(r)
        pairs = F.zip_with(F.slice(r, 1, n - 1), F.slice(r, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
        turn = lambda p: p["x0"] * p["y1"] - p["x1"] * p["y0"]
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("c"))
        got = F.aggregate(F.when(n > 2, pairs).otherwise(F.slice(pairs, 1, 0)), zero, lambda s, p: F.struct((s["a"] + turn(p)).alias("a"), (s["c"] + (p["x0"] + p["x1"]) * turn(p)).alias("c")))
        # a ring's direction does not matter: both sums take its sign
        sign = F.when(got["a"] < 0, -1.0).otherwise(1.0)
        return F.struct((got["a"] * sign).alias("a"), (got["c"] * sign).alias("c"))

    each = F.transform(F.filter(rs, lambda r: F.size(r) > 0), sums)
    add = lambda k: F.aggregate(each, F.lit(0.0), lambda s, x: s + x[k])
    points = F.flatten(rs)
    mean = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(points)
    return F.when(F.size(points) > 0, F.when(F.abs(add("a")) > 1e-12, add("c") / (3 * add("a"))).otherwise(mean))
