"""Product and dataset documents of a catalog, from schemas and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import col, is_uuid, uuid5, uuid_text
from ..operators.bands import band_aliases, merge_by_precedence
from ..operators.grids import one_pixel
from ..operators.infer import Collections, MDConfig, collections_of
from ..sources import stac

#: Property names of items, and what they are called in a dataset document.
RENAME = {
    "end_datetime": "dtr:end_datetime",
    "start_datetime": "dtr:start_datetime",
    "gsd": "eo:gsd",
    "instruments": "eo:instrument",
    "platform": "eo:platform",
    "constellation": "eo:constellation",
    "view:off_nadir": "eo:off_nadir",
    "view:azimuth": "eo:azimuth",
    "view:sun_azimuth": "eo:sun_azimuth",
    "view:sun_elevation": "eo:sun_elevation",
}
METADATA_TYPE, SCHEMA = "eo3", "https://schemas.opendatacube.org/dataset"


def rename_properties(properties: Column | str, names: dict[str, str] = RENAME) -> Column:
    """A map with keys renamed; other keys stay. Of two keys that become one the later wins."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    e = F.transform(F.map_entries(col(properties)), lambda e: F.struct(F.coalesce(F.element_at(table, e["key"]), e["key"]).alias("k"), e["value"].alias("v")))
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def extra_text(key: str, properties: str = "properties") -> Column:
    """A property as it is printed into an identifier: nothing if it is missing, ``None`` for null, ``True``, ``False``."""
    path = "$['" + key.replace("'", "\\'") + "']"
    v = F.try_variant_get(properties, path, "variant")
    text = F.try_variant_get(properties, path, "string")
    flag = F.try_variant_get(properties, path, "boolean")
    return F.when(v.isNull(), "").when(F.is_variant_null(v), "None").when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(flag.cast("string"))).otherwise(text)


def dataset_uuid(mode: str = "auto", id: str = "id", collection: str = "collection_id", extras: list[str] | None = None, properties: str = "properties") -> Column:
    """``native``: the id, which must be a UUID; ``random``: a new one; ``auto``: the id if it is a UUID, else version 5
    of the lines collection, id, and ``key=value`` for each property of ``extras`` in order of key."""
    if mode == "native":
        return F.when(is_uuid(id), uuid_text(id)).otherwise(F.raise_error(F.concat(F.lit("Not a UUID: "), F.col(id))))
    if mode == "random":
        return F.uuid()
    if mode != "auto":
        raise ValueError(f"Unknown way to make identifiers: {mode!r}")
    lines = [F.col(collection), F.col(id), *[F.concat(F.lit(f"{k}="), extra_text(k, properties)) for k in sorted(extras or ())]]
    return F.when(is_uuid(id), uuid_text(id)).otherwise(uuid5(F.concat_ws("\n", *lines, F.lit(""))))


def configured_uuid(config: MDConfig) -> Column:
    """The identifier by the settings: ``uuid: {mode, extras}`` of a collection, of ``*``, or of the whole."""

    def made(cfg: dict) -> Column:
        return dataset_uuid(cfg.get("mode", "auto"), extras=cfg.get("extras"))

    whole = config.cfg.get("uuid")
    rest = config.of("*").get("uuid") or (whole if isinstance(whole, dict) else {})
    out = made(rest)
    for c in config.known:
        if c != "uuid" and "uuid" in config.cfg[c]:
            out = F.when(F.col("collection_id") == c, made(config.cfg[c]["uuid"])).otherwise(out)
    return out


def _joined(base: Column, more: Column) -> Column:
    """Two JSON objects as one; the second may be empty."""
    return F.when(more == "{}", base).otherwise(F.concat(base.substr(F.lit(1), F.length(base) - 1), F.lit(","), more.substr(F.lit(2), F.length(more))))


def measurement_name(asset: str = "asset", idx: str = "idx") -> Column:
    """Band 1 is called by its asset, others have their number after it."""
    return F.when(F.col(idx) > 1, F.concat_ws("_", asset, F.col(idx).cast("string"))).otherwise(F.col(asset))


def products(found: Collections) -> DataFrame:
    """(collection_id, product, measurements): a JSON document with a measurement for each band, in order: its name, type,
    nodata (null if none), unit, the aliases it is first for, and the band's number if it is not 1."""
    b = found.bands.join(band_aliases(found.aliases, unique=True), ["collection_id", "asset", "idx"], "left")
    base = F.to_json(F.struct(measurement_name().alias("name"), F.col("data_type").alias("dtype"), "nodata", F.col("unit").alias("units")), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct("aliases", F.when(F.col("idx") > 1, F.col("idx")).alias("band")))
    m = b.select("collection_id", "band_pos", _joined(base, more).alias("m"))
    rows = m.groupBy("collection_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("band_pos", "m"))), lambda x: x["m"]).alias("measurements"))
    name = F.col("collection_id").alias("name")
    head = F.to_json(F.struct(name, F.lit(METADATA_TYPE).alias("metadata_type"), F.struct(F.struct(name).alias("product")).alias("metadata")))
    doc = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"measurements":['), F.array_join("measurements", ","), F.lit("]}"))
    return rows.select("collection_id", doc.alias("product"), "measurements")


def with_cached(found: Collections, cache: DataFrame | None = None) -> DataFrame:
    """Products of all collections; those of ``cache`` (collection_id, product) go before what items say."""
    made = products(found).select("collection_id", "product")
    return made if cache is None else merge_by_precedence(cache.select("collection_id", "product"), made, ["collection_id"])


def infer_product(spark: SparkSession, doc: dict | str, config: MDConfig | dict | None = None) -> str:
    """The product document of one item or one collection document."""
    if not isinstance(doc, dict | str):
        raise TypeError("Needs an item or a collection document")
    texts = stac.items_from(spark, [doc])
    kind = texts.select(F.get_json_object("text", "$.type")).first()[0]
    if kind == "Collection":
        texts = stac.collection_items(texts)
    elif kind != "Feature":
        raise TypeError("Needs an item or a collection document")
    parsed = stac.parse_documents(texts)
    return products(collections_of(stac.items_table(parsed), stac.assets_table(parsed), config)).first().product


def grid_shape(g: Column) -> Column:
    """A grid in a document: rows and columns, and six terms of the affine."""
    return F.struct(F.array(g["h"], g["w"]).alias("shape"), F.array(*[g[k] for k in "abcdef"]).alias("transform"))


def datasets(found: Collections, config: MDConfig | dict | None = None) -> DataFrame:
    """(item_seq, id, product, dataset): an item as a dataset document: identifier, grids by name, measurements with
    their paths, properties renamed. An item without any grid gets one of a single pixel over its geometry, or fails."""
    config = config if isinstance(config, MDConfig) else MDConfig(config or {})
    src = found.sources().join(found.grids, ["collection_id", "asset"], "left")
    grid_name = F.coalesce("grid_name", F.lit("default"))
    entry = F.struct(F.col("uri").alias("path"), F.when(F.col("idx") > 1, F.col("idx")).alias("band"), F.when(F.col("has_proj") & (grid_name != "default"), grid_name).alias("grid"))
    in_order = lambda key, value: F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("band_pos", key.alias("k"), value.alias("v")))), lambda x: F.struct(x["k"], x["v"])))
    ms = src.groupBy("item_seq").agg(in_order(measurement_name(), F.to_json(entry)).alias("measurements"))
    own = src.where("grid IS NOT NULL").groupBy("item_seq", grid_name.alias("g")).agg(F.min_by("grid", "band_pos").alias("grid"), F.min("band_pos").alias("band_pos"))
    own = own.groupBy("item_seq").agg(in_order(F.col("g"), grid_shape(F.col("grid"))).alias("grids"), F.min_by("grid.crs", "band_pos").alias("crs"))
    xs, ys = (F.transform(F.flatten("geometry"), lambda p: p[k]) for k in "xy")
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    single = F.create_map(F.lit("default"), grid_shape(one_pixel(box, F.lit("EPSG:4326"))))
    none = F.raise_error(F.concat(F.lit("Item without footprint: "), F.col("id")))
    x = found.items.join(ms, "item_seq", "left").join(own, "item_seq", "left")
    grids = F.coalesce("grids", F.when(F.col("geometry").isNotNull(), single).otherwise(none.cast("map<string,struct<shape:array<int>,transform:array<double>>>")))
    properties = rename_properties(F.from_json(F.to_json("properties"), "map<string,variant>"))
    # measurements are JSON already, so that each has the keys it needs and no others
    listed = F.array_join(F.transform(F.map_entries("measurements"), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ",")
    head = F.to_json(F.struct(F.col("uuid").alias("id"), F.lit(SCHEMA).alias("$schema"), F.coalesce("crs", F.lit("EPSG:4326")).alias("crs"), grids.alias("grids"), F.lit("").alias("location")))
    doc = F.concat(
        head.substr(F.lit(1), F.length(head) - 1), F.lit(',"measurements":{'), F.coalesce(listed, F.lit("")), F.lit('},"properties":'),
        F.to_json(properties), F.lit(',"lineage":{}}'),
    )
    return x.withColumn("uuid", configured_uuid(config)).select("item_seq", F.col("uuid").alias("id"), F.col("collection_id").alias("product"), doc.alias("dataset"))


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    one = F.to_json(F.array(text))
    return one.substr(F.lit(2), F.length(one) - 2)
