"""Queries over generated item documents: parsing, schemas, sources, products, loading; with their DuckDB SQL.

A part is an item document (JSON text made of its row): its brand is the collection, its key the input position. Assets
are ``red`` (10 m, one band), ``multi`` (60 m, two bands), ``thumb`` (no pixels), and in some items ``late`` (on the grid of
``red`` or on one of its own). Every query here goes through the engine's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crs as C
from .functions import scalar as S
from .operators import bands as B
from .operators import grids, infer
from .operators.grids import Grid
from .plans import cube, products, report
from .queries import query, table
from .sources import settings, stac

EXTENSIONS = [f"https://stac-extensions.github.io/{e}/v1.0.0/schema.json" for e in ("projection", "raster", "eo")]

#: Documents that a task makes and reads.
DOCUMENTS = 5000


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(item_seq, text) of each part."""
    n, s = F.col("p_partkey"), F.col("p_size")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    lon, lat = ((n * 7) % 300 - 150).cast("double"), ((n * 3) % 120 - 60).cast("double")
    box = lambda x, y: F.array(*[F.array(x + a, y + b) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0))])
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(box(lon, lat)).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(box(lon, lat)), F.array(box(lon + 4, lat))).alias("coordinates")))
    geometry = F.when(n % 11 == 0, "null").when(n % 5 == 0, multi).otherwise(polygon)

    def asset(href, kind, roles, *more):
        return F.to_json(F.struct(href.alias("href"), F.lit(kind).alias("type"), lit(*roles).alias("roles"), *more))

    shape = lambda h: F.array(F.lit(h) + (n % 2).cast("int"), F.lit(h)).alias("proj:shape")
    affine = lambda r: F.array(F.lit(r), F.lit(0.0), n * 1000.0, F.lit(0.0), F.lit(-r), F.lit(5000000.0)).alias("proj:transform")
    rb = lambda *bs: F.array(*[F.struct(F.lit(t).alias("data_type"), F.lit(v).cast("double").alias("nodata")) for t, v in bs]).alias("raster:bands")
    eo = lambda *bs: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(c).alias("common_name")) for a, c in bs]).alias("eo:bands")
    base = F.concat(F.lit("https://data.example.org/"), n.cast("string"))
    tiff = "image/tiff; application=geotiff"
    red = asset(F.concat(base, F.lit("/r.tif")), tiff, ["data"], shape(100), affine(10.0), rb(("uint16", 0)), eo(("B4", "crimson")))
    many = asset(F.concat(F.lit("./"), F.lit("m.tif")), tiff, ["data"], shape(20), affine(60.0), rb(("int16", -1), ("uint8", None)), eo(("b1", "nir"), ("b2", "swir")))
    thumb = asset(F.concat(base, F.lit("/t.jpg")), "image/jpeg", ["thumbnail"])
    own = F.when(s % 2 == 0, 10.0).otherwise(20.0)
    late = asset(
        F.concat(base, F.lit("/l.tif")), tiff, ["data"], shape(100), F.array(own, F.lit(0.0), n * 1000.0, F.lit(0.0), -own, F.lit(5000000.0)).alias("proj:transform"),
        rb(("float32", None)), eo(("b1", "aerosol")),
    )
    assets = F.concat(F.lit('{"red":'), red, F.lit(',"multi":'), many, F.lit(',"thumb":'), thumb, F.when(s % 5 == 0, F.concat(F.lit(',"late":'), late)).otherwise(""), F.lit("}"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.timestamp_seconds(F.lit(1577836800) + n * 3600)
    properties = F.to_json(F.struct(
        F.when(n % 3 != 0, stamp(at)).alias("datetime"), F.when(n % 3 == 0, stamp(at)).alias("start_datetime"), F.when(n % 3 == 0, stamp(at + F.expr("INTERVAL 1 DAY"))).alias("end_datetime"),
        F.when(n % 7 == 0, F.col("p_brand")).alias("odc:product"), F.lit(32633).alias("proj:epsg"), F.col("p_name").alias("platform"), s.alias("gsd"), (s % 2 == 0).alias("view:off_nadir"), F.col("p_type").alias("kind"),
    ))
    collection = F.when(n % 7 != 0, F.concat(F.lit(',"collection":"'), F.col("p_brand"), F.lit('"'))).otherwise("")
    text = F.concat(
        F.lit('{"type":"Feature","id":"i'), n.cast("string"), F.lit('"'), collection, F.lit(',"stac_extensions":'), F.lit(str(EXTENSIONS).replace("'", '"')),
        F.lit(',"geometry":'), geometry, F.lit(',"properties":'), properties, F.lit(',"links":[{"rel":"self","href":"'), base, F.lit('/item.json"}],"assets":'), assets, F.lit("}"),
    )
    # a row becomes a text fifty times as long, so a file that is read whole by a task or two is dealt out first
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    dealt = parts.repartition(parts.count() // DOCUMENTS + 1, "p_partkey")
    return dealt.select(n.alias("item_seq"), text.alias("text"))


def found(spark: SparkSession, d: str, config=None) -> infer.Collections:
    parsed = stac.parse_documents(documents(spark, d))
    return infer.collections_of(stac.items_table(parsed), stac.assets_table(parsed), config)


#: The same in SQL: items, and one row for each band of an item (a: asset, i: band, pos: order in the item).
ITEMS = """it AS (SELECT p_partkey AS item_seq, concat('i', p_partkey) AS id, p_brand AS collection_id, p_size AS s, p_name, p_type,
  TIMESTAMP '2020-01-01' + to_hours(p_partkey::BIGINT) AS ts, ((p_partkey * 7) % 300 - 150)::DOUBLE AS lon0, ((p_partkey * 3) % 120 - 60)::DOUBLE AS lat0 FROM part),
fs AS (SELECT collection_id, min(item_seq) AS first_seq FROM it GROUP BY 1), ls AS (SELECT collection_id, min(item_seq) AS late_seq FROM it WHERE s % 5 = 0 GROUP BY 1),
lt AS (SELECT ls.collection_id, late_seq, first_seq, s AS late_s FROM ls JOIN fs USING (collection_id) JOIN it ON it.collection_id = ls.collection_id AND it.item_seq = late_seq),
bd AS (SELECT * FROM (VALUES ('red', 1, 0, 'uint16', 0::DOUBLE), ('multi', 1, 1, 'int16', -1::DOUBLE), ('multi', 2, 2, 'uint8', NULL), ('late', 1, 3, 'float32', NULL)) t(a, i, pos, dt, nd)),
so AS (SELECT it.*, bd.*, CASE a WHEN 'red' THEN 'https://data.example.org/' || item_seq || '/r.tif' WHEN 'multi' THEN 'https://data.example.org/' || item_seq || '/m.tif'
  ELSE 'https://data.example.org/' || item_seq || '/l.tif' END AS uri FROM it, bd WHERE a <> 'late' OR s % 5 = 0)"""


@query(f"""WITH {ITEMS} SELECT item_seq, id, collection_id, ts, CASE WHEN item_seq % 11 = 0 THEN NULL WHEN item_seq % 5 = 0 THEN lon0 + 3 ELSE lon0 + 1 END AS lon, true AS has_proj_ext, true AS has_raster_ext FROM it""")
def parsed_items(spark, d):
    i = stac.items_table(stac.parse_documents(documents(spark, d)))
    return i.select("item_seq", "id", "collection_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("lon", 6).alias("lon"), "has_proj_ext", "has_raster_ext")


@query(f"""WITH {ITEMS} SELECT item_seq FROM it WHERE item_seq % 11 <> 0 AND ((lon0 + 2 >= 20 AND lon0 <= 30) OR (item_seq % 5 = 0 AND lon0 + 6 >= 20 AND lon0 + 4 <= 30)) AND lat0 + 1 >= -20 AND lat0 <= 20""")
def search_many_polygons(spark, d):
    return stac.search(stac.items_table(stac.parse_documents(documents(spark, d))), bbox=(20, -20, 30, 20)).select("item_seq")


@query(f"""WITH {ITEMS}, b AS (SELECT DISTINCT collection_id FROM it), x AS (SELECT b.collection_id, bd.* FROM b, bd WHERE a <> 'late' OR EXISTS (SELECT 1 FROM ls WHERE ls.collection_id = b.collection_id))
SELECT collection_id, a AS asset, i AS idx, dt AS data_type, nd AS nodata, '1' AS unit FROM x""")
def band_metadata(spark, d):
    return found(spark, d).bands.select("collection_id", "asset", "idx", "data_type", "nodata", "unit")


@query(f"""WITH {ITEMS}, b AS (SELECT DISTINCT collection_id FROM it), x AS (SELECT b.collection_id, bd.* FROM b, bd WHERE a <> 'late' OR EXISTS (SELECT 1 FROM ls WHERE ls.collection_id = b.collection_id))
SELECT collection_id, a AS asset, i AS idx, CASE WHEN a = 'red' THEN 'int8' WHEN a = 'late' THEN 'float32' ELSE dt END AS data_type, CASE WHEN a = 'red' THEN 5::DOUBLE WHEN a = 'multi' AND i = 1 THEN -1 ELSE 9 END AS nodata, CASE a WHEN 'red' THEN 'm' ELSE '1' END AS unit FROM x""")
def band_settings(spark, d):
    """What the settings say of an asset, the document, the settings' rest, in this order."""
    cfg = {"*": {"assets": {"red": {"data_type": "int8", "nodata": 5, "unit": "m"}, "*": {"nodata": 9, "data_type": "float64"}}, "aliases": {"rot": "red", "two": ["multi", 2]}}}
    return found(spark, d, cfg).bands.select("collection_id", "asset", "idx", "data_type", "nodata", "unit")


@query(f"""WITH {ITEMS} SELECT item_seq, a AS asset, i AS idx, uri, CASE a WHEN 'multi' THEN 20 ELSE 100 END + item_seq % 2 AS h,
CASE WHEN a = 'multi' THEN 60 WHEN a = 'late' AND s % 2 = 1 AND late_s % 2 = 1 THEN 20 ELSE 10 END::DOUBLE AS res FROM so LEFT JOIN lt USING (collection_id)""")
def item_sources(spark, d):
    """A source for each band that an item has; assets of one grid name share the grid of the first of them."""
    s = found(spark, d).sources()
    return s.select("item_seq", "asset", "idx", "uri", F.col("grid.h").cast("long").alias("h"), F.col("grid.a").alias("res"))


@query(f"""WITH {ITEMS} SELECT collection_id, 'red' AS asset, 'default' AS grid_name FROM fs UNION ALL SELECT collection_id, 'multi', 'g60' FROM fs
UNION ALL SELECT collection_id, 'late', CASE WHEN late_s % 2 = 0 THEN 'default' WHEN late_seq = first_seq THEN 'g20' ELSE 'grid-late' END FROM lt""")
def grid_names(spark, d):
    """Grids of a collection by name; an asset that turns up later has a known grid or one of its own."""
    return found(spark, d).grids


@query(f"WITH {ITEMS} SELECT collection_id, 'late' AS asset, late_seq AS item_seq FROM ls JOIN fs USING (collection_id) WHERE late_seq > first_seq")
def late_assets(spark, d):
    return infer.late_assets(found(spark, d).first).select("collection_id", "asset", "item_seq")


@query(f"""WITH {ITEMS}, c AS (SELECT fs.collection_id, late_seq IS NOT NULL AS has, late_seq > first_seq AS late FROM fs LEFT JOIN ls USING (collection_id)),
x AS (SELECT collection_id, alias, asset, idx FROM c, (VALUES ('B4', 'red', 1), ('crimson', 'red', 1), ('b2', 'multi', 2), ('nir', 'multi', 1), ('swir', 'multi', 2)) t(alias, asset, idx))
SELECT collection_id, alias, 0::BIGINT AS rank, asset, idx FROM x UNION ALL SELECT collection_id, 'aerosol', 0, 'late', 1 FROM c WHERE has
UNION ALL SELECT collection_id, 'b1', 0, CASE WHEN has THEN 'late' ELSE 'multi' END, 1 FROM c UNION ALL SELECT collection_id, 'b1', 1, 'multi', 1 FROM c WHERE has""")
def alias_table(spark, d):
    return found(spark, d).aliases.select("collection_id", "alias", "rank", "asset", "idx")


WANTED = ["red", "nir", "multi.2", "crimson"]
_W = "(VALUES (0, 'red', 'red', 1), (1, 'nir', 'multi', 1), (2, 'multi.2', 'multi', 2), (3, 'crimson', 'red', 1)) t(pos, query, asset, idx)"


@query(f"WITH {ITEMS} SELECT collection_id, t.pos, query, asset, idx, dt AS data_type FROM fs, {_W} JOIN bd ON bd.a = t.asset AND bd.i = t.idx")
def band_resolve(spark, d):
    """The strict form: a name that a collection does not know would fail."""
    f = found(spark, d)
    return B.resolve_bands(B.band_query(spark, WANTED), f.bands, f.aliases).select("collection_id", "pos", "query", "asset", "idx", "data_type")


@query(f"WITH {ITEMS}, q AS (SELECT * FROM (VALUES (0, 'crimson', 'red'), (1, 'late', 'late')) t(pos, query, a)) SELECT it.item_seq, q.pos, q.query, so.uri FROM it CROSS JOIN q LEFT JOIN so ON so.item_seq = it.item_seq AND so.a = q.a WHERE q.query <> 'late' OR it.collection_id IN (SELECT collection_id FROM ls)")
def item_bands(spark, d):
    """Bands of items by queried name, null where an item lacks one."""
    f = found(spark, d)
    r = B.resolve_bands(B.band_query(spark, ["crimson", "late"]), f.bands, f.aliases, outer=True).where("asset IS NOT NULL")
    return B.item_bands(r, f.items, B.strip_sources(f.sources()).drop("collection_id")).select("item_seq", "pos", "query", "uri")


@query(f"WITH {ITEMS} SELECT collection_id, query FROM fs, (VALUES ('red'), ('nir'), ('multi.2'), ('swir')) t(query) UNION ALL SELECT collection_id, query FROM ls, (VALUES ('late'), ('aerosol')) t(query)")
def band_contains(spark, d):
    f = found(spark, d)
    names = f.bands.select("collection_id").distinct().withColumn("query", F.explode(F.array(*map(F.lit, ("red", "nir", "multi.2", "swir", "late", "aerosol", "thumb", "multi.3", "x")))))
    return B.contains(names, f.bands, f.aliases)


@query(f"WITH {ITEMS} SELECT item_seq, a AS asset, i AS idx, CASE WHEN a = 'multi' THEN replace(uri, 'https://data.', 'https://mirror.') ELSE uri END AS uri FROM so")
def patched_urls(spark, d):
    """Edited links of chosen bands only."""
    f = found(spark, d)
    chosen = B.resolve_bands(B.band_query(spark, ["nir", "swir"]), f.bands, f.aliases)
    out = B.patch_urls(f.sources(), lambda u: F.replace(u, F.lit("https://data."), F.lit("https://mirror.")), chosen)
    return out.select("item_seq", "asset", "idx", "uri")


@query(f"WITH {ITEMS} SELECT item_seq, a AS asset, i AS idx, upper(uri) AS uri FROM so")
def patched_by_function(spark, d):
    return B.strip_sources(B.patch_urls(found(spark, d).sources(), str.upper)).select("item_seq", "asset", "idx", "uri")


@query(f"WITH {ITEMS} SELECT item_seq, a AS asset, string_agg(i || '=' || uri, ',' ORDER BY i) AS bands FROM so GROUP BY item_seq, a")
def item_assets(spark, d):
    x = B.assets_of(found(spark, d).sources())
    return x.select("item_seq", "asset", F.array_join(F.transform("bands", lambda b: F.concat_ws("=", b["idx"].cast("string"), b["uri"])), ",").alias("bands"))


@query(f"WITH {ITEMS}, c AS (SELECT collection_id, first_seq FROM fs) SELECT it.item_seq, it.id FROM it JOIN c ON c.collection_id = it.collection_id AND c.first_seq = it.item_seq")
def first_items(spark, d):
    return stac.first_items(stac.items_table(stac.parse_documents(documents(spark, d)))).select("item_seq", "id")


@query(f"WITH {ITEMS} SELECT DISTINCT dt AS data_type FROM so")
def distinct_dtypes(spark, d):
    return found(spark, d).bands.select("data_type").distinct()


# --- scans of collections of features, and of collections


@query("SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS item_seq, n_name AS id, concat('R', n_regionkey) AS collection_id FROM nation")
def feature_collections(spark, d):
    """A collection of features for each region, whose features become items in order."""
    f = F.concat(F.lit('{"type":"Feature","id":"'), F.col("n_name"), F.lit('","collection":"R'), F.col("n_regionkey").cast("string"), F.lit('","properties":{"datetime":"2020-01-01T00:00:00Z"},"assets":{}}'))
    n = table(spark, d, "nation").select("n_regionkey", F.struct(F.col("n_nationkey"), f.alias("f")).alias("x"))
    docs = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["f"]), ","), F.lit("]}")).alias("value"))
    return stac.items_table(stac.parse_documents(stac.sequenced(docs, "n_regionkey"))).select("item_seq", "id", "collection_id")


def _collections(spark, d) -> DataFrame:
    a = F.to_json(F.struct(F.lit("image/tiff").alias("type"), F.array(F.lit("data")).alias("roles"), F.lit(10).alias("gsd")))
    b = F.to_json(F.struct(F.lit("image/tiff").alias("type"), F.array(F.lit("data")).alias("roles"), (F.col("r_regionkey") + 20).alias("gsd")))
    text = F.concat(F.lit('{"type":"Collection","id":"'), F.col("r_name"), F.lit('","stac_extensions":["https://stac-extensions.github.io/item-assets/v1.0.0/schema.json"],"item_assets":{"fine":'), a, F.lit(',"coarse":'), b, F.lit(',"doc":{"type":"text/xml"}}}'))
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("item_seq"), text.alias("text"))


@query("""SELECT r_name AS collection_id, 'sample' AS id, TIMESTAMP '2020-01-01' AS ts, asset, '' AS href, (CASE asset WHEN 'fine' THEN 10 ELSE r_regionkey + 20 END)::DOUBLE AS gsd FROM region, (VALUES ('fine'), ('coarse')) t(asset)""")
def collection_scan(spark, d):
    """Collections as items of their own, with what they say of their items' assets."""
    p = stac.parse_documents(stac.collection_items(_collections(spark, d)))
    i = stac.items_table(p).select("item_seq", "id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    a = stac.assets_table(p)
    return a.where(stac.is_raster()).join(i, "item_seq").select("collection_id", "id", "ts", "asset", "href", "gsd")


@query("SELECT r_name AS collection_id, asset, CASE asset WHEN 'fine' THEN 'default' ELSE concat('g', r_regionkey + 20) END AS grid_name FROM region, (VALUES ('fine'), ('coarse')) t(asset)")
def collection_grids(spark, d):
    """Without projections, grids are told apart by resolution alone."""
    p = stac.parse_documents(stac.collection_items(_collections(spark, d)))
    return infer.collections_of(stac.items_table(p), stac.assets_table(p)).grids


# --- products and datasets

_M = "printf('{\"name\":\"%s\",\"dtype\":\"%s\",\"nodata\":%s,\"units\":\"1\"%s}', CASE WHEN i > 1 THEN a || '_' || i ELSE a END, dt, coalesce(printf('%.1f', nd), 'null'), more)"


@query(f"""WITH {ITEMS}, c AS (SELECT fs.collection_id, late_seq IS NOT NULL AS has FROM fs LEFT JOIN ls USING (collection_id)),
x AS (SELECT c.collection_id, bd.*, CASE WHEN a = 'red' THEN ',"aliases":["B4","crimson"]' WHEN a = 'late' THEN ',"aliases":["aerosol","b1"]' WHEN i = 2 THEN ',"aliases":["b2","swir"],"band":2'
  WHEN has THEN ',"aliases":["nir"]' ELSE ',"aliases":["b1","nir"]' END AS more FROM c, bd WHERE a <> 'late' OR has)
SELECT collection_id, '{{"name":"' || collection_id || '","metadata_type":"eo3","metadata":{{"product":{{"name":"' || collection_id || '"}}}},"measurements":[' || string_agg({_M}, ',' ORDER BY pos) || ']}}' AS product FROM x GROUP BY collection_id""")
def product_documents(spark, d):
    f = found(spark, d)
    doc = products.products(f)
    # alias lists are in order of appearance; by name here
    sorted_ = F.transform("measurements", lambda m: F.when(m.contains('"aliases":'), F.concat(F.substring_index(m, '"aliases":[', 1), F.lit('"aliases":['), F.array_join(F.array_sort(F.split(F.substring_index(F.substring_index(m, '"aliases":[', -1), "]", 1), ",")), ","), F.lit("]"), F.substring_index(m, "]", -1))).otherwise(m))
    head = F.substring_index("product", '"measurements":[', 1)
    return doc.select("collection_id", F.concat(head, F.lit('"measurements":['), F.array_join(sorted_, ","), F.lit("]}")).alias("product"))


@query(f"""WITH {ITEMS} SELECT collection_id, CASE WHEN collection_id LIKE '%1' THEN concat('{{"name":"', collection_id, '","own":true}}') ELSE 'made' END AS product FROM fs""")
def product_cache(spark, d):
    """Products that are given go before those that items tell."""
    f = found(spark, d)
    cache = f.bands.select("collection_id").distinct().where("collection_id LIKE '%1'").withColumn("product", F.concat(F.lit('{"name":"'), "collection_id", F.lit('","own":true}')))
    return products.with_cached(f, cache).select("collection_id", F.when(F.col("product").contains('"own"'), F.col("product")).otherwise("made").alias("product"))


_V5 = """lower(concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4) + 1, 1) || substr({h}, 18, 3), substr({h}, 21, 12)))"""


@query(f"""WITH {ITEMS}, u AS (SELECT *, sha1(unhex('{S.NAMESPACE.hex}') || encode(collection_id || chr(10) || id || chr(10) || 'gsd=' || s || chr(10) || 'nothing=' || chr(10) || 'view:off_nadir=' || CASE WHEN s % 2 = 0 THEN 'True' ELSE 'False' END || chr(10))) AS h FROM it)
SELECT item_seq, {_V5.format(h="h")} AS uuid FROM u""")
def uuid_with_extras(spark, d):
    """Properties in the identifier, in order of key; a missing one is empty."""
    i = stac.items_table(stac.parse_documents(documents(spark, d)))
    return i.select("item_seq", products.dataset_uuid("auto", extras=["view:off_nadir", "nothing", "gsd"]).alias("uuid"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN u WHEN 1 THEN u ELSE lower(u) END AS uuid FROM (SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events))""")
def uuid_native(spark, d):
    """Identifiers that are UUIDs already, in any of their forms."""
    h = F.md5(F.col("event_id").cast("string"))
    dashed = S.uuid_text(h)
    k = F.col("event_id") % 3
    x = table(spark, d, "events").select("event_id", F.lit("c").alias("collection_id"), F.when(k == 0, F.concat(F.lit("{"), dashed, F.lit("}"))).when(k == 1, h).otherwise(F.upper(dashed)).alias("id"))
    return x.select("event_id", F.when(k == 0, products.dataset_uuid("native")).otherwise(products.dataset_uuid("auto")).alias("uuid"))


_NAMES = list(products.RENAME)
_SQL_NAMES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate([*products.RENAME.items(), ("created", "created"), ("eo:cloud_cover", "eo:cloud_cover")]))


@query(f"SELECT event_id, b AS name, event_type AS value FROM events, (VALUES {_SQL_NAMES}) t(i, a, b) WHERE (event_id + i) % 4 <> 0")
def property_renames(spark, d):
    """All renamed properties, and two that keep their names."""
    keys = [*_NAMES, "created", "eo:cloud_cover"]
    e = F.array(*[F.when((F.col("event_id") + i) % 4 != 0, F.struct(F.lit(k).alias("k"), F.col("event_type").alias("v"))) for i, k in enumerate(keys)])
    p = F.map_from_entries(F.array_compact(e))
    return table(spark, d, "events").select("event_id", F.explode(products.rename_properties(p)).alias("name", "value"))


@query(f"""WITH {ITEMS}, n AS (SELECT so.*, CASE a WHEN 'red' THEN 'default' WHEN 'multi' THEN 'g60' ELSE CASE WHEN late_s % 2 = 0 THEN 'default' WHEN late_seq = first_seq THEN 'g20' ELSE 'grid-late' END END AS g FROM so LEFT JOIN lt USING (collection_id))
SELECT item_seq, collection_id AS product, '{{' || string_agg('"' || CASE WHEN i > 1 THEN a || '_' || i ELSE a END || '":{{"path":"' || uri || '"' || CASE WHEN i > 1 THEN ',"band":' || i ELSE '' END
  || CASE WHEN g <> 'default' THEN ',"grid":"' || g || '"' ELSE '' END || '}}', ',' ORDER BY pos) || '}}' AS measurements FROM n GROUP BY item_seq, collection_id""")
def dataset_measurements(spark, d):
    """The measurements of dataset documents: paths, bands, grids."""
    m = F.substring_index(F.substring_index("dataset", '"measurements":', -1), ',"properties":', 1)
    return products.datasets(found(spark, d)).select("item_seq", "product", m.alias("measurements"))


@query(f"""WITH {ITEMS}, u AS (SELECT *, sha1(unhex('{S.NAMESPACE.hex}') || encode(collection_id || chr(10) || id || chr(10))) AS h FROM it)
SELECT item_seq, {_V5.format(h="h")} AS id, '{products.SCHEMA}' AS schema, 'EPSG:32633' AS crs, '' AS location, '{{}}' AS lineage, p_name AS platform, s::VARCHAR AS gsd, CASE WHEN s % 2 = 0 THEN 'true' ELSE 'false' END AS off_nadir, p_type AS kind,
CASE WHEN item_seq % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS start FROM u""")
def dataset_documents(spark, d):
    """What else a dataset document has, with properties under their new names."""
    x = products.datasets(found(spark, d))
    get = lambda p: F.get_json_object("dataset", p)
    prop = lambda k: F.get_json_object("dataset", f"$.properties['{k}']")
    return x.select(
        "item_seq", get("$.id").alias("id"), get("$['$schema']").alias("schema"), get("$.crs").alias("crs"), get("$.location").alias("location"), get("$.lineage").alias("lineage"),
        prop("eo:platform").alias("platform"), prop("eo:gsd").alias("gsd"), prop("eo:off_nadir").alias("off_nadir"), prop("kind").alias("kind"), prop("dtr:start_datetime").alias("start"),
    )


@query(f"""WITH {ITEMS}, n AS (SELECT so.*, CASE a WHEN 'red' THEN 'default' WHEN 'multi' THEN 'g60' ELSE CASE WHEN late_s % 2 = 0 THEN 'default' WHEN late_seq = first_seq THEN 'g20' ELSE 'grid-late' END END AS g FROM so LEFT JOIN lt USING (collection_id)),
r AS (SELECT item_seq, g, arg_min(a, pos) AS a, any_value(s) AS s FROM n GROUP BY item_seq, g)
SELECT item_seq, g AS grid, CASE a WHEN 'multi' THEN 20 ELSE 100 END + item_seq % 2 AS h, CASE a WHEN 'multi' THEN 20 ELSE 100 END AS w, 6 AS terms,
CASE WHEN a = 'multi' THEN 60 WHEN a = 'red' OR s % 2 = 0 THEN 10 ELSE 20 END::DOUBLE AS res, (item_seq * 1000)::DOUBLE AS x0 FROM r""")
def dataset_grids(spark, d):
    """Grids of dataset documents: shape and six terms."""
    x = products.datasets(found(spark, d))
    g = F.from_json(F.get_json_object("dataset", "$.grids"), "map<string,struct<shape:array<int>,transform:array<double>>>")
    x = x.select("item_seq", F.explode(g).alias("grid", "g"))
    return x.select("item_seq", "grid", F.col("g.shape")[0].cast("long").alias("h"), F.col("g.shape")[1].alias("w"), F.size("g.transform").alias("terms"), F.col("g.transform")[0].alias("res"), F.col("g.transform")[2].alias("x0"))


@query(f"WITH {ITEMS} SELECT item_seq, 2.0::DOUBLE AS a, lon0 AS c, -1.0::DOUBLE AS e, lat0 + 1 AS f FROM it WHERE item_seq % 11 <> 0 AND item_seq % 5 <> 0")
def dataset_of_footprint(spark, d):
    """Items without a grid get one of a single pixel over their geometry."""
    texts = documents(spark, d).where("item_seq % 11 <> 0 AND item_seq % 5 <> 0").withColumn("text", F.replace(F.replace("text", F.lit('"proj:shape"'), F.lit('"x"')), F.lit('"proj:transform"'), F.lit('"y"')))
    p = stac.parse_documents(texts)
    x = products.datasets(infer.collections_of(stac.items_table(p), stac.assets_table(p)))
    t = F.from_json(F.get_json_object("dataset", "$.grids.default.transform"), "array<double>")
    return x.select("item_seq", *[F.round(t[i], 9).alias(k) for i, k in ((0, "a"), (2, "c"), (4, "e"), (5, "f"))])


# --- settings


_SETTINGS = [*settings.SECRETS, *settings.SESSION, *settings.S3A_SECRETS, "spark.hadoop.fs.s3a.secret.key", "fs.s3a.endpoint", "AWS_PROFILE", "GDAL_HTTP_MAX_RETRY", "azure_storage_account"]
_SETTINGS_SQL = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_SETTINGS))
_SECRET_SQL = ", ".join(f"'{x}'" for x in (
    "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN", "AZURE_STORAGE_CONNECTION_STRING", "AZURE_STORAGE_ACCESS_TOKEN", "AZURE_STORAGE_ACCESS_KEY", "AZURE_STORAGE_SAS_TOKEN", "AZURE_SAS",
    "GS_ACCESS_KEY_ID", "GS_SECRET_ACCESS_KEY", "OSS_ACCESS_KEY_ID", "OSS_SECRET_ACCESS_KEY", "SWIFT_AUTH_TOKEN", "fs.s3a.access.key", "fs.s3a.secret.key", "fs.s3a.session.token", "spark.hadoop.fs.s3a.secret.key",
))


@query(f"SELECT n_nationkey, name, CASE WHEN name IN ({_SECRET_SQL}) THEN 'xx..xx' ELSE n_name END AS value FROM nation, (VALUES {_SETTINGS_SQL}) t(i, name)")
def masked_settings(spark, d):
    """Secrets masked in a table of settings."""
    t = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value"), F.explode(F.array(*map(F.lit, _SETTINGS))).alias("name"))
    return settings.sanitized(t).select("n_nationkey", "name", "value")


@query("SELECT n_nationkey, name, n_name AS value FROM nation, (VALUES ('AWS_PROFILE'), ('GDAL_HTTP_MAX_RETRY')) t(name)")
def settings_without_session(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value"), F.explode(F.array(*map(F.lit, _SETTINGS))).alias("name"))
    return settings.sanitized(t, no_session_keys=True).select("n_nationkey", "name", "value")


# --- loading: scenes of 20 by 20 pixels in a row of overlapping squares, made up by a reader


OUT = Grid(40, 120, 10.0, 0.0, 600000.0, 0.0, -10.0, 5000000.0, "EPSG:32633")


def value_of(i: int, y, x):
    """The pixel of scene i at row y, column x: below zero where there is none."""
    return (i * 7 + y * 3 + x * 5) % 31 - 3


class MadeUp:
    """A reader of scenes whose pixels follow from their number; the last part of a link is that number."""

    def __init__(self, side: int = 20, nodata: float | None = -1.0, res: float = 10.0):
        self.side, self.nodata, self.res = side, nodata, res

    def grid(self, uri: str) -> Grid:
        i = int(uri.rsplit("/", 1)[-1])
        return Grid(self.side, self.side, self.res, 0.0, 600000.0 + (i * 13) % 110 * 10.0 - 50.0, 0.0, -self.res, 5000000.0 - (i * 5) % 30 * 10.0, "EPSG:32633")

    def describe(self, uri: str, band: int):
        return self.grid(uri), (self.side, self.side), self.nodata, []

    def read(self, uri: str, band: int, level, window):
        import numpy as np

        y0, y1, x0, x1 = window
        v = value_of(int(uri.rsplit("/", 1)[-1]), np.arange(y0, y1)[:, None], np.arange(x0, x1)[None, :])
        return np.where(v < 0, -1, v).astype("int16")


def scenes(spark: SparkSession, d: str, reader: MadeUp) -> DataFrame:
    """(item_seq, text): a scene for each supplier, one a day of a fortnight by its nation."""
    n = F.col("s_suppkey")
    r, side = reader.res, reader.side
    c, f = F.lit(600000.0) + (n * 13) % 110 * 10.0 - 50.0, F.lit(5000000.0) - (n * 5) % 30 * 10.0
    asset = F.struct(
        F.concat(F.lit("made://up/"), n.cast("string")).alias("href"), F.lit("image/tiff").alias("type"), F.array(F.lit("data")).alias("roles"), F.lit(32633).alias("proj:epsg"),
        F.array(F.lit(side), F.lit(side)).alias("proj:shape"), F.array(F.lit(r), F.lit(0.0), c, F.lit(0.0), F.lit(-r), f).alias("proj:transform"),
        F.array(F.struct(F.lit("int16").alias("data_type"), F.lit(-1.0).alias("nodata"))).alias("raster:bands") if reader.nodata is not None else F.array(F.struct(F.lit("int16").alias("data_type"))).alias("raster:bands"),
    )
    stamp = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("s_nationkey") * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.concat(F.lit("s"), F.lpad(n.cast("string"), 8, "0")).alias("id"), F.lit("made").alias("collection"), F.array(*map(F.lit, EXTENSIONS)).alias("stac_extensions"),
        F.struct(stamp.alias("datetime")).alias("properties"), F.struct(asset.alias("b")).alias("assets"),
    ))
    return table(spark, d, "supplier").select(n.alias("item_seq"), doc.alias("text"))


#: Every scene's pixels on the output's grid, before they are fused.
_PX = """sc AS (SELECT s_suppkey AS i, dense_rank() OVER (ORDER BY s_nationkey) - 1 AS t_idx, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS prio, (s_suppkey * 13) % 110 - 5 AS ox, (s_suppkey * 5) % 30 AS oy FROM supplier),
px AS (SELECT i, t_idx, prio, oy + y AS y, ox + x AS x, (i * 7 + y * 3 + x * 5) % 31 - 3 AS v FROM sc, range(0, 20) a(y), range(0, 20) b(x) WHERE oy + y < 40 AND ox + x BETWEEN 0 AND 119),
sp AS (SELECT t_idx, y, x FROM (SELECT DISTINCT t_idx FROM sc), range(0, 40) a(y), range(0, 120) b(x))"""


@query(f"WITH {_PX}, m AS (SELECT t_idx, y, x, arg_min(v, prio) AS v FROM px WHERE v >= 0 GROUP BY ALL) SELECT 'b' AS band, t_idx, y, x, coalesce(v, -1)::DOUBLE AS v FROM sp LEFT JOIN m USING (t_idx, y, x)")
def load_mosaic(spark, d):
    """A whole load: planes by time, tiles, windows read and pasted, first valid pixel, fill values."""
    plan = cube.load(scenes(spark, d, MadeUp()), "b", spark=spark, groupby="time", geobox=OUT, chunks={"y": 16, "x": 50}, reader=MadeUp())
    return plan.pixels().select("band", "t_idx", F.col("y").cast("long"), F.col("x").cast("long"), "v")


@query(f"""WITH {_PX}, bn AS (SELECT i, t_idx, prio, ty, tx FROM sc, range(0, 3) a(ty), range(0, 3) b(tx) WHERE oy < least(40, ty * 16 + 16) AND oy + 20 > ty * 16 AND ox < least(120, tx * 50 + 50) AND ox + 20 > tx * 50),
f AS (SELECT t_idx, ty, tx, arg_min(i, prio) AS i FROM bn GROUP BY ALL), m AS (SELECT px.t_idx, px.y, px.x, greatest(px.v, -1) AS v FROM px JOIN f ON f.i = px.i AND f.t_idx = px.t_idx AND f.ty = px.y // 16 AND f.tx = px.x // 50)
SELECT t_idx, y, x, coalesce(v, 0)::DOUBLE AS v FROM sp LEFT JOIN m USING (t_idx, y, x)""")
def load_without_nodata(spark, d):
    """Integers without nodata: only the first source of a tile counts."""
    r = MadeUp(nodata=None)
    plan = cube.load(scenes(spark, d, r), spark=spark, groupby="time", geobox=OUT, chunks={"y": 16, "x": 50}, reader=r)
    return plan.pixels().select("t_idx", F.col("y").cast("long"), F.col("x").cast("long"), "v")


def _blocks(agg: str, kind: str) -> str:
    return f"""WITH {_PX}, k AS (SELECT t_idx, prio, y // 2 AS y, x // 2 AS x, {agg} AS v FROM px WHERE v >= 0 GROUP BY ALL), m AS (SELECT t_idx, y, x, arg_min(v, prio) AS v FROM k GROUP BY ALL)
SELECT t_idx, y, x, round(v::DOUBLE, 4) AS v FROM m"""


def _load_coarse(spark, d, kind: str) -> DataFrame:
    half = Grid(20, 60, 20.0, 0.0, 600000.0, 0.0, -20.0, 5000000.0, "EPSG:32633")
    plan = cube.load(scenes(spark, d, MadeUp()), "b", spark=spark, groupby="time", geobox=half, chunks={"y": 8, "x": 25}, reader=MadeUp(), resampling=kind, dtype="float64", nodata=float("nan"))
    px = plan.pixels(dense=False).where(~F.isnan("v"))
    return px.select("t_idx", F.col("y").cast("long"), F.col("x").cast("long"), F.round("v", 4).alias("v"))


@query(_blocks("avg(v)", "average"))
def load_average(spark, d):
    """Packed tiles resampled by average of the source pixels whose centres lie in an output pixel."""
    return _load_coarse(spark, d, "average")


@query(_blocks("max(v)", "max"))
def load_max(spark, d):
    return _load_coarse(spark, d, "max")


@query(_blocks("sqrt(avg(v * v))", "rms"))
def load_rms(spark, d):
    return _load_coarse(spark, d, "rms")


@query(_blocks("quantile_disc(v, 0.25)", "q1"))
def load_quartile(spark, d):
    return _load_coarse(spark, d, "q1")


@query(f"WITH {_PX}, bn AS (SELECT t_idx, ty, tx, string_agg(i, ',' ORDER BY prio) AS items FROM sc, range(0, 3) a(ty), range(0, 3) b(tx) WHERE oy < least(40, ty * 16 + 16) AND oy + 20 > ty * 16 AND ox < least(120, tx * 50 + 50) AND ox + 20 > tx * 50 GROUP BY ALL) SELECT t_idx, ty, tx, items FROM bn")
def load_parts(spark, d):
    """Which sources a load will read for each tile, in order."""
    plan = cube.load(scenes(spark, d, MadeUp()), "b", spark=spark, groupby="time", geobox=OUT, chunks={"y": 16, "x": 50}, reader=MadeUp())
    x = plan.parts.groupBy("t_idx", "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("prio", "item_seq"))).alias("p"))
    return x.select("t_idx", F.col("ty").cast("long"), F.col("tx").cast("long"), F.array_join(F.transform("p", lambda p: p["item_seq"].cast("string")), ",").alias("items"))


@query("SELECT 'EPSG:32633' AS crs, 10.0::DOUBLE AS res, (600000 + min((s_suppkey * 13) % 110 * 10 - 50))::DOUBLE AS c, (5000000 - min((s_suppkey * 5) % 30 * 10))::DOUBLE AS f, ((max((s_suppkey * 13) % 110) - min((s_suppkey * 13) % 110)) + 20)::BIGINT AS w, ((max((s_suppkey * 5) % 30) - min((s_suppkey * 5) % 30)) + 20)::BIGINT AS h FROM supplier")
def load_auto_grid(spark, d):
    """The output grid when none is asked for: the items' own projection and resolution over all their outlines."""
    g = cube.load(scenes(spark, d, MadeUp()), "b", spark=spark, reader=MadeUp()).grid
    return spark.range(1).select(F.lit(g.crs).alias("crs"), F.lit(g.a).alias("res"), F.lit(g.c).alias("c"), F.lit(g.f).alias("f"), F.lit(g.w).cast("long").alias("w"), F.lit(g.h).cast("long").alias("h"))


# --- grids, projections, geometry


_REGIONS = {
    "bbox": {"bbox": (10.0, 20.0, 11.0, 22.0), "crs": 4326, "resolution": 0.5}, "lonlat": {"lon": (11.0, 10.0), "lat": (22.0, 20.0), "crs": 4326, "resolution": 0.5},
    "xy": {"x": (105.0, 1.0), "y": (7.0, 99.0), "crs": "EPSG:3857", "resolution": 10}, "center": {"x": (105.0, 1.0), "y": (7.0, 99.0), "crs": "EPSG:3857", "resolution": 10, "anchor": "center"},
    "tuple": {"bbox": (10.0, 20.0, 11.0, 22.0), "crs": 4326, "resolution": (0.25, -0.5)},
    "polygon": {"geopolygon": {"type": "Polygon", "coordinates": [[[10.2, 20.1], [10.9, 20.3], [10.5, 21.8], [10.2, 20.1]]]}, "crs": 4326, "resolution": 0.5},
    "geobox": {"geobox": OUT}, "like": {"like": OUT},
}


@query("""SELECT * FROM (VALUES ('bbox', 4, 2, 10.0::DOUBLE, 22.0::DOUBLE, 0.5::DOUBLE, -0.5::DOUBLE), ('lonlat', 4, 2, 10.0, 22.0, 0.5, -0.5), ('xy', 10, 11, 0.0, 100.0, 10.0, -10.0), ('center', 10, 11, -5.0, 105.0, 10.0, -10.0),
('tuple', 4, 4, 10.0, 22.0, 0.25, -0.5), ('polygon', 4, 2, 10.0, 22.0, 0.5, -0.5), ('geobox', 40, 120, 600000.0, 5000000.0, 10.0, -10.0), ('like', 40, 120, 600000.0, 5000000.0, 10.0, -10.0)) t(name, h, w, c, f, a, e)""")
def output_grids(spark, d):
    """The planner's grid for each way to ask for one."""
    rows, none = [], spark.createDataFrame([], f"item_seq long, band_pos int, grid {grids.GRID}")
    for name, args in _REGIONS.items():
        g = cube.output_grid(spark, none, none, **args)
        rows.append((name, g.h, g.w, g.c, g.f, g.a, g.e))
    return spark.createDataFrame(rows, "name string, h int, w int, c double, f double, a double, e double")


@query("SELECT s_suppkey, round(6378137.0::DOUBLE * ((s_suppkey * 37) % 360 - 180) * (pi() / 180), 3) AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + ((s_suppkey * 17) % 160 - 80) * (pi() / 360))), 3) AS y FROM supplier")
def mercator(spark, d):
    """Degrees to a spherical Mercator projection."""
    n = F.col("s_suppkey")
    x, y = C.transform(((n * 37) % 360 - 180).cast("double"), ((n * 17) % 160 - 80).cast("double"), "EPSG:4326", "EPSG:3857")
    return table(spark, d, "supplier").select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT s_suppkey, code, ((s_suppkey * 7) % 40 + 110)::DOUBLE AS lon, (-((s_suppkey * 3) % 30) - 10)::DOUBLE AS lat FROM supplier, (VALUES (3857), (32750), (3577), (6933), (3031)) t(code)")
def projections_there_and_back(spark, d):
    """Each projection and its inverse return the place: in numpy, as series make huge expressions of columns."""
    import pyarrow as pa

    codes = (3857, 32750, 3577, 6933, 3031)

    def run(batches):
        for b in batches:
            lon, lat = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
            for code in codes:
                x, y = C.projection(code).inverse(*C.projection(code).forward(lon, lat))
                yield pa.RecordBatch.from_arrays([b.column("s_suppkey"), pa.array([code] * len(lon), pa.int32()), pa.array(x.round(6)), pa.array(y.round(6))], names=["s_suppkey", "code", "lon", "lat"])

    n = F.col("s_suppkey")
    at = table(spark, d, "supplier").select(n, ((n * 7) % 40 + 110).cast("double").alias("lon"), (-((n * 3) % 30) - 10).cast("double").alias("lat"))
    return at.mapInArrow(run, "s_suppkey long, code int, lon double, lat double")


@query("SELECT i AS id, concat('EPSG:', CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INT + 1) AS crs FROM (SELECT i, (i * 6 - 177)::DOUBLE AS lon, (i % 7 - 3)::DOUBLE AS lat FROM range(0, 60) t(i))")
def utm_zones(spark, d):
    """Symbolic projections become the zone of a box."""
    rows = [(i, C.pick_crs("utm", (i * 6 - 178.0, i % 7 - 4.0, i * 6 - 176.0, i % 7 - 2.0))) for i in range(60)]
    return spark.createDataFrame(rows, "id long, crs string")


@query(f"WITH {ITEMS} SELECT item_seq, 2.0::DOUBLE AS area FROM it WHERE item_seq % 11 <> 0 AND item_seq % 5 <> 0")
def outline_areas(spark, d):
    """Outlines of geometries, in degrees, and their areas."""
    i = stac.items_table(stac.parse_documents(documents(spark, d))).where("item_seq % 5 <> 0")
    none = spark.createDataFrame([], f"item_seq long, band_pos int, grid {grids.GRID}")
    g = cube.safe_geometry(i, none, "EPSG:4326").where("footprint IS NOT NULL")
    r = F.col("footprint")[0]
    nxt = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    area = F.abs(F.aggregate(F.zip_with(r, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
    return g.select("item_seq", F.round(area, 6).alias("area"))


@query(f"WITH {ITEMS} SELECT item_seq, (item_seq * 1000)::DOUBLE AS x0, 5000000.0 - 10 * (100 + item_seq % 2)::DOUBLE AS y0, (item_seq * 1000 + 1000)::DOUBLE AS x1, 5000000.0::DOUBLE AS y1 FROM it")
def image_outlines(spark, d):
    """The outline of each item's finest grid."""
    f = found(spark, d)
    g = cube.image_geometry(f.items, f.sources().where("asset = 'red'"), "EPSG:32633")
    xs, ys = (F.transform(F.col("footprint")[0], lambda p: p[k]) for k in "xy")
    return g.select("item_seq", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


@query("SELECT p_partkey, (p_partkey % 100)::DOUBLE AS x0, (p_size)::DOUBLE AS y0, 1 AS h, 1 AS w, (p_size + 1)::DOUBLE AS a, -(2.0 + p_size % 3)::DOUBLE AS e FROM part")
def one_pixel_grids(spark, d):
    n, s = F.col("p_partkey"), F.col("p_size")
    x, y = (n % 100).cast("double"), s.cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + s + 1).alias("x1"), (y + 2.0 + s % 3).alias("y1"))
    g = grids.one_pixel(box, F.lit("EPSG:4326"))
    return table(spark, d, "part").select("p_partkey", g["c"].alias("x0"), (g["f"] + g["e"]).alias("y0"), g["h"].alias("h"), g["w"].alias("w"), g["a"].alias("a"), g["e"].alias("e"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 255 WHEN p_size % 3 = 1 THEN 0 ELSE CASE WHEN p_size % 2 = 0 THEN -5 END END::DOUBLE AS source, coalesce(CASE WHEN p_size % 5 = 0 THEN 7 END, CASE WHEN p_size % 3 <> 2 THEN 0 END, -1)::DOUBLE AS target_int, CASE WHEN p_size % 5 = 0 THEN 7 ELSE 1e300 END::DOUBLE AS target_float FROM part")
def nodata_rules(spark, d):
    """Which nodata a source has, and which its output."""
    s = F.col("p_size")
    file, override, fallback = F.when(s % 3 == 1, 0.0), F.when(s % 3 == 0, 255.0), F.when(s % 2 == 0, -5.0)
    fill = F.when(s % 5 == 0, 7.0)
    src = S.source_nodata(file, fallback, override)
    as_int = F.coalesce(S.output_nodata("int16", fill, F.when(s % 3 != 2, 0.0)), F.lit(-1.0))
    as_float = S.output_nodata("float32", fill, src)
    return table(spark, d, "part").select("p_partkey", src.alias("source"), as_int.alias("target_int"), F.when(F.isnan(as_float), 1e300).otherwise(as_float).alias("target_float"))


_TIF = Grid(8, 8, 30.0, 0.0, 1000.0, 0.0, -30.0, 2000.0, "EPSG:32755")


@query("SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, floor(embedding[i] * 100)::INT AS v, 30.0::DOUBLE AS res, 'EPSG:32755' AS crs, -999.0::DOUBLE AS nodata FROM embeddings, range(1, 65) t(i) WHERE (i - 1) // 8 BETWEEN 2 AND 6 AND (i - 1) % 8 BETWEEN 1 AND 7")
def tiff_windows(spark, d):
    """Rasters written as TIFF files into a binary column, and a window of each read back."""
    import io

    import numpy as np
    import pyarrow as pa

    from .sources import tiff

    class Bytes(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    def write(batches):
        for b in batches:
            out = []
            for k, e in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                x = np.floor(np.array(e, np.float32) * np.float32(100)).astype("int16").reshape(8, 8)
                out.append(tiff.encode([x[::-1], x], _TIF, -999.0, tile=16 if k % 2 else None, predictor=2 if k % 3 else 1, compression=tiff.DEFLATE if k % 5 else tiff.NONE, planar=bool(k % 7)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "media"])

    def read(batches):
        for b in batches:
            rows = []
            for k, m in zip(b.column("vec_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                f = Bytes(m)
                r = tiff.describe(f)
                x = tiff.read_window(f, r, 2, None, (2, 7, 1, 8))
                rows += [(k, y + 2, c + 1, int(x[y, c]), r.grid.a, r.grid.crs, r.nodata) for y in range(5) for c in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.float64()), strict=True)], names=["vec_id", "y", "x", "v", "res", "crs", "nodata"])

    files = table(spark, d, "embeddings").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(write, "vec_id long, media binary")
    return files.mapInArrow(read, "vec_id long, y long, x long, v int, res double, crs string, nodata double")


@query("SELECT o_orderkey, 1.0 * o_totalprice AS elapsed, round(46.0 / o_totalprice, 9) AS mps, round(46.0 / o_totalprice / 4, 9) AS per_thread FROM orders")
def bench_samples(spark, d):
    """Timed runs with what follows from their times."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit(46_000_000).alias("npix"), F.lit(4).alias("n_threads"), F.lit(0.0).alias("t0"), F.lit(0.5).alias("t1"), F.col("o_totalprice").alias("t2"))
    r = report.collate(o)
    return r.select("o_orderkey", "elapsed", F.round("throughput_mps", 9).alias("mps"), F.round("throughput_mps_per_thread", 9).alias("per_thread"))


@query("SELECT t_idx, prio, item_seq FROM (SELECT event_id AS item_seq, dense_rank() OVER (ORDER BY event_type) - 1 AS t_idx, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR, event_id) - 1 AS prio FROM events)")
def group_by_function(spark, d):
    """Groups by what a function of an item and its place returns."""
    from .operators import temporal
    from .queries import scenes as event_scenes

    x = event_scenes(spark, d).withColumn("properties", F.parse_json("props"))
    return temporal.group_items(x, lambda item, parsed, idx: item["collection_id"]).select("t_idx", "prio", "item_seq")
