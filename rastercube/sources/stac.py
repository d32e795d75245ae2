"""Metadata documents as tables: items, collections, feature collections, search, and the inverse for tests.

Documents are semi-structured: the raw text is kept beside a VARIANT, and assets are taken from a ``from_json`` map,
which keeps the order of keys that a VARIANT does not.

``items``  (item_seq, id, collection_id, datetime, start_datetime, end_datetime, ts, geometry (the outer rings of its
            polygons), lon, href, properties, has_proj_ext, has_raster_ext)
``assets`` (item_seq, collection_id, asset_pos, asset, doc VARIANT)
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.temporal import mid_longitude, ranked

#: Suffixes of files and media types, besides images, that are pixels.
RASTER_SUFFIX = ("tif", "tiff", "jpeg", "jpg", "jp2", "img", "hdf", "nc", "zarr")
RASTER_MEDIA = ("application/x-hdf", "application/x-hdf5", "application/hdf", "application/hdf5", "application/x-netcdf", "application/netcdf", "application/x-zarr", "application/zarr")
SAMPLE_TIME = "2020-01-01T00:00:00Z"


def read_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of one item a file, or of one feature collection a file, in order of file name and place: (item_seq,
    text)."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return sequenced(files, "file")


def read_item_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents one a line; the order is that of files and lines' text offsets is not kept by readers, so by file and id."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return sequenced(lines, "file")


def sequenced(docs: DataFrame, *order: str) -> DataFrame:
    """Number documents (value) by ``order``; feature collections give one row a feature, in order."""
    features = F.from_json("value", "struct<type string, features array<string>>")
    split = F.when(features["type"] == "FeatureCollection", features["features"]).otherwise(F.array("value"))
    rows = docs.withColumn("f", features).select(*order, "value", F.posexplode(split).alias("pos", "text"))
    # numbers by range of the order: no task holds all documents
    return ranked(rows, *map(F.col, order), F.col("pos"), F.col("text")).select(F.col("t_idx").alias("item_seq"), "text")


def items_from(spark: SparkSession, docs: Iterable[dict | str]) -> DataFrame:
    """Documents given as dicts or texts, numbered as given."""
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    return spark.createDataFrame(list(enumerate(texts)), "item_seq long, text string")


def extension(urls: Column, name: str) -> Column:
    """Whether an extension is declared, by its short name or by the URL of its schema."""
    return F.coalesce(F.exists(urls, lambda u: (u == name) | u.startswith(f"https://stac-extensions.github.io/{name}/")), F.lit(False))


def _stamp(x: Column) -> Column:
    return F.try_to_timestamp(x)


GEOMETRY = "struct<type:string,coordinates:array<array<array<double>>>>"
_ITEM = "id string, collection string, stac_extensions array<string>, geometry string, bbox array<double>, properties map<string,variant>, assets map<string,variant>, links array<struct<rel:string,href:string>>"


def parse_documents(texts: DataFrame) -> DataFrame:
    """(item_seq, text) with the document parsed once as ``d``; what is not JSON fails with its number."""
    d = F.from_json("text", _ITEM)
    bad = F.raise_error(F.concat(F.lit("Not a JSON document: item "), F.col("item_seq").cast("string"))).cast("variant")
    return texts.select("item_seq", "text", d.alias("d"), F.coalesce(F.try_parse_json("text"), bad).alias("doc"))


def items_table(parsed: DataFrame) -> DataFrame:
    prop = lambda k: F.try_variant_get("doc", f"$.properties['{k}']", "string")
    collection = F.coalesce("d.collection", prop("odc:product"), F.lit("_"))
    stamp = lambda k: _stamp(prop(k))
    polygon = F.from_json("d.geometry", GEOMETRY)
    multi = F.from_json("d.geometry", "struct<type:string,coordinates:array<array<array<array<double>>>>>")
    # the outer rings of all polygons
    outer = F.when(polygon["type"] == "Polygon", F.slice(polygon["coordinates"], 1, 1)).when(multi["type"] == "MultiPolygon", F.transform(multi["coordinates"], lambda p: F.get(p, F.lit(0))))
    rings = F.transform(F.filter(outer, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    rings = F.when(F.size(rings) > 0, rings)
    self_href = F.get(F.filter("d.links", lambda x: x["rel"] == "self"), F.lit(0))["href"]
    rows = parsed.select(
        "item_seq", F.col("d.id").alias("id"), collection.alias("collection_id"), stamp("datetime").alias("datetime"),
        stamp("start_datetime").alias("start_datetime"), stamp("end_datetime").alias("end_datetime"), rings.alias("geometry"),
        self_href.alias("href"), F.try_variant_get("doc", "$.properties", "variant").alias("properties"),
        extension(F.col("d.stac_extensions"), "projection").alias("has_proj_ext"), extension(F.col("d.stac_extensions"), "raster").alias("has_raster_ext"),
    )
    return rows.withColumns({"ts": F.coalesce("datetime", "start_datetime", "end_datetime"), "lon": mid_longitude("geometry")})


def assets_table(parsed: DataFrame) -> DataFrame:
    """One row an asset, in document order; projection metadata that an asset lacks comes from the item's properties."""
    collection = F.coalesce(F.try_variant_get("doc", "$.collection", "string"), F.try_variant_get("doc", "$.properties['odc:product']", "string"), F.lit("_"))
    self_href = F.get(F.filter(F.from_json(F.to_json(F.try_variant_get("doc", "$.links", "variant")), "array<struct<rel:string,href:string>>"), lambda x: x["rel"] == "self"), F.lit(0))["href"]
    kinds = {"shape": "array<int>", "transform": "array<double>", "epsg": "bigint", "code": "string", "wkt2": "string", "projjson": "variant"}
    # what the document says is read once, not once an asset
    whole = [F.try_variant_get("doc", f"$.properties['proj:{k}']", kind).alias(f"_{k}") for k, kind in kinds.items()]
    rows = parsed.select("item_seq", collection.alias("collection_id"), self_href.alias("item_href"), *whole, F.col("d.assets").alias("_assets"))
    # outer: else Spark tests before it whether there are assets, which parses each document once more
    rows = rows.select("item_seq", "collection_id", "item_href", *[f"_{k}" for k in kinds], F.posexplode_outer("_assets").alias("asset_pos", "asset", "a")).where("asset_pos IS NOT NULL")
    text = lambda k: F.try_variant_get("a", f"$['{k}']", "string")
    proj = lambda k: F.coalesce(F.try_variant_get("a", f"$['proj:{k}']", kinds[k]), f"_{k}")
    crs = F.coalesce(F.concat(F.lit("EPSG:"), proj("epsg").cast("string")), proj("code"), proj("wkt2"), F.to_json(proj("projjson")))
    return rows.select(
        "item_seq", "collection_id", "asset_pos", "asset", text("href").alias("href"), text("type").alias("media_type"), text("title").alias("title"),
        F.try_variant_get("a", "$.roles", "array<string>").alias("roles"), F.try_variant_get("a", "$.gsd", "double").alias("gsd"),
        proj("shape").alias("proj_shape"), proj("transform").alias("proj_transform"), crs.alias("proj_crs"),
        F.from_json(F.to_json(F.try_variant_get("a", "$['raster:bands']", "variant")), "array<struct<data_type:string,nodata:string,unit:string>>").alias("raster_bands"),
        F.from_json(F.to_json(F.try_variant_get("a", "$['eo:bands']", "variant")), "array<struct<name:string,common_name:string>>").alias("eo_bands"),
        "item_href",
    )


def collection_items(texts: DataFrame) -> DataFrame:
    """Collections (item_seq, text) as items with what ``item_assets`` says of each asset, an empty href and a fixed
    time; fails where that extension is missing."""
    d = F.from_json("text", "struct<id string, stac_extensions array<string>, item_assets map<string,string>>")
    has = d["item_assets"].isNotNull()
    bad = F.raise_error(F.concat(F.lit("No item_assets in collection "), F.coalesce(d["id"], F.lit("?")))).cast("string")
    assets = F.map_from_entries(F.transform(F.map_entries(d["item_assets"]), lambda e: F.struct(e["key"], F.concat(F.lit('{"href":"",'), F.regexp_replace(e["value"], r"^\s*\{\s*", "")))))
    body = F.transform(F.map_entries(assets), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.regexp_replace(e["value"], r',\}$', "}")))
    doc = F.concat(
        F.lit('{"type":"Feature","id":"sample","collection":'), F.to_json(F.array(d["id"])).substr(F.lit(2), F.length(F.to_json(F.array(d["id"]))) - 2),
        F.lit(',"stac_extensions":'), F.to_json(d["stac_extensions"]), F.lit(f',"geometry":null,"properties":{{"datetime":"{SAMPLE_TIME}"}},"links":[],"assets":{{'),
        F.array_join(body, ","), F.lit("}}"),
    )
    return texts.select("item_seq", F.when(has, doc).otherwise(bad).alias("text"))


# --- predicates


def is_raster(href="href", media_type="media_type", roles="roles", *, proj: Column | None = None, strip_query: bool = False) -> Column:
    """Whether an asset is pixels. With ``proj`` (a boolean column), those without projection data are not.

    Without a media type: role ``data`` is, role ``metadata`` is not, else the suffix of the href decides. Images are
    unless their role is thumbnail or overview; a few other types are; nothing else is."""
    h, m, r = (F.col(x) if isinstance(x, str) else x for x in (href, media_type, roles))
    if strip_query:
        h = F.regexp_replace(h, r"[?#].*$", "")
    has = lambda *names: F.coalesce(F.arrays_overlap(r, F.array(*map(F.lit, names))), F.lit(False))
    kind = F.lower(F.trim(F.split_part(m, F.lit(";"), F.lit(1))))
    suffix = F.lower(F.element_at(F.split(h, r"\."), -1))
    yes = (
        F.when(m.isNull() | (kind == ""), F.when(has("data"), True).when(has("metadata"), False).otherwise(F.coalesce(suffix.isin(*RASTER_SUFFIX), F.lit(False))))
        .when(kind.startswith("image/"), ~has("thumbnail", "overview"))
        .otherwise(kind.isin(*RASTER_MEDIA))
    )
    return yes if proj is None else proj & yes


def search(items: DataFrame, *, collections: list[str] | None = None, datetime: tuple[str | None, str | None] | None = None, bbox: tuple[float, float, float, float] | None = None, query: dict | None = None) -> DataFrame:
    """Catalog search: collections, a range of time (both ends in), a box in degrees, and properties compared by ``eq``,
    ``neq``, ``lt``, ``lte``, ``gt``, ``gte``, ``in``, ``startsWith``. Plain columns are pushed down to the scan."""
    if collections is not None:
        items = items.where(F.col("collection_id").isin(collections))
    if datetime is not None:
        lo, hi = datetime
        items = items.where(F.col("ts") >= F.lit(lo).cast("timestamp")) if lo else items
        items = items.where(F.col("ts") <= F.lit(hi).cast("timestamp")) if hi else items
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        edge = lambda r, k, end: end(F.transform(r, lambda p: p[k]))
        meets = lambda r: (edge(r, "x", F.array_max) >= x0) & (edge(r, "x", F.array_min) <= x1) & (edge(r, "y", F.array_max) >= y0) & (edge(r, "y", F.array_min) <= y1)
        items = items.where(F.exists("geometry", meets))  # any of its polygons
    ops = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}
    for name, tests in (query or {}).items():
        for op, value in tests.items():
            one = value[0] if op == "in" else value
            got = F.try_variant_get("properties", f"$['{name}']", "double" if isinstance(one, int | float) and not isinstance(one, bool) else "boolean" if isinstance(one, bool) else "string")
            items = items.where(got.isin(value) if op == "in" else got.startswith(value) if op == "startsWith" else ops[op](got, F.lit(value)))
    return items


def dump_items(texts: DataFrame, path: str, overwrite: bool = False) -> None:
    """Raw documents one a line; an existing folder stays unless ``overwrite``."""
    texts.select("text").write.mode("overwrite" if overwrite else "ignore").text(path)


# --- the inverse


def item_document(id: str, datetime: str | None, *, collection: str | None = None, rings=None, assets: dict | None = None, properties: dict | None = None, extensions: Iterable[str] = ("projection", "raster", "eo"), href: str | None = None) -> dict:
    """A document for tests and generated catalogs. ``assets``: name to dict; tuples of (Grid, dtype, nodata, uri) become
    an asset with projection and raster metadata."""
    from ..operators.grids import Grid

    out = {}
    for name, a in (assets or {}).items():
        if isinstance(a, tuple):
            grid, dtype, nodata, uri = a
            assert isinstance(grid, Grid)
            a = {
                "href": uri, "type": "image/tiff; application=geotiff", "roles": ["data"], "proj:epsg": int(grid.crs.split(":")[1]),
                "proj:shape": [grid.h, grid.w], "proj:transform": list(grid.transform), "raster:bands": [{"data_type": dtype, "nodata": "nan" if nodata != nodata else nodata}],
            }
        out[name] = a
    return {
        "type": "Feature", "stac_version": "1.0.0", "id": id, **({"collection": collection} if collection else {}),
        "stac_extensions": [f"https://stac-extensions.github.io/{e}/v1.0.0/schema.json" for e in extensions],
        "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in rings]]} if rings else None,
        "properties": {"datetime": datetime, **(properties or {})}, "links": [{"rel": "self", "href": href}] if href else [], "assets": out,
    }


def first_items(items: DataFrame) -> DataFrame:
    """The first item of each collection."""
    w = W.partitionBy("collection_id").orderBy("item_seq")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
