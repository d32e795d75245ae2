"""Queries over the test tables, one for each group of operators, and the same in DuckDB SQL.

Views: *scenes* are ``events`` (an item each, with a place made of user_id), *rasters* are ``embeddings`` (64 values are a
tile of 8 by 8 pixels; below zero is no data; label is the plane, vec_id the priority), *assets* are ``part`` and
``pages``. Times are without a zone; longitudes are whole degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import bands as B
from .operators import binning, grids, infer, pixels, temporal
from .operators.grids import Grid
from .plans import products, report
from .sources import stac

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scenes(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("item_seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("collection_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        ((F.col("user_id") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("user_id") * 17) % 160 - 80).cast("double").alias("lat"), "value", "props", "user_id",
    )


SCENES = """scenes AS (SELECT event_id AS item_seq, CAST(event_id AS VARCHAR) AS id, event_type AS collection_id, ts::TIMESTAMP AS ts,
  ((user_id * 37) % 360 - 180)::DOUBLE AS lon, ((user_id * 17) % 160 - 80)::DOUBLE AS lat, value, props, user_id FROM events)"""
HOUR = "date_trunc('hour', ts)::TIMESTAMP"
SOLAR = "CAST(ts + to_hours(trunc({lon} / 15)::BIGINT) AS DATE)"


def hour():
    return F.date_trunc("hour", "ts").cast("timestamp_ntz")


def _groups(x: DataFrame) -> DataFrame:
    return x.select("item_seq", "t_idx", "prio")


def _groups_sql(key: str, order: str = "ts, id, item_seq") -> str:
    return f"""WITH {SCENES}, k AS (SELECT *, {key} AS key FROM scenes)
SELECT item_seq, dense_rank() OVER (ORDER BY key NULLS FIRST) - 1 AS t_idx, row_number() OVER (PARTITION BY key ORDER BY {order}) - 1 AS prio FROM k"""


@query(_groups_sql(HOUR))
def group_time(spark, d):
    return _groups(temporal.group_items(scenes(spark, d).withColumn("full_ts", F.col("ts")), hour))


@query(_groups_sql(SOLAR.format(lon="lon")))
def group_solar_day(spark, d):
    return _groups(temporal.group_items(scenes(spark, d), "solar_day"))


@query(_groups_sql(SOLAR.format(lon="151")))
def group_solar_day_fixed_lon(spark, d):
    return _groups(temporal.group_items(scenes(spark, d), "solar_day", lon=151))


@query(_groups_sql("item_seq"))
def group_id(spark, d):
    return _groups(temporal.group_items(scenes(spark, d), None))


@query(_groups_sql("CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END"))
def group_property(spark, d):
    x = scenes(spark, d).withColumn("properties", F.when(F.col("user_id") % 5 == 0, F.parse_json(F.lit("{}"))).otherwise(F.parse_json("props")))
    return _groups(temporal.group_items(x, "k"))


@query(_groups_sql("item_seq % 7"))
def group_custom(spark, d):
    return _groups(temporal.group_items(scenes(spark, d), lambda: F.col("item_seq") % 7))


@query(_groups_sql(SOLAR.format(lon="lon"), "item_seq"))
def group_preserve_order(spark, d):
    return _groups(temporal.group_items(scenes(spark, d), "solar_day", preserve_order=True))


@query(f"""WITH {SCENES}, k AS (SELECT *, {SOLAR.format(lon="lon")} AS key FROM scenes),
g AS (SELECT *, dense_rank() OVER (ORDER BY key) - 1 AS t_idx, row_number() OVER (PARTITION BY key ORDER BY ts, id, item_seq) AS prio FROM k)
SELECT t_idx, arg_min(ts, prio) AS time, count(*) AS n_items FROM g GROUP BY t_idx""")
def time_axis(spark, d):
    return temporal.time_axis(temporal.group_items(scenes(spark, d), "solar_day"))


@query(f"""WITH {SCENES}, s AS (SELECT item_seq, CASE WHEN item_seq % 3 = 0 THEN NULL ELSE ts END AS a, CASE WHEN item_seq % 6 = 0 THEN NULL ELSE ts - INTERVAL 1 DAY END AS b, ts AS c FROM scenes)
SELECT item_seq, coalesce(a, b, c) AS nominal FROM s""")
def nominal_datetime(spark, d):
    s = scenes(spark, d)
    a, b = F.when(F.col("item_seq") % 3 != 0, F.col("ts")), F.when(F.col("item_seq") % 6 != 0, F.col("ts") - F.expr("INTERVAL 1 DAY"))
    return s.select("item_seq", S.nominal_time(a, b, F.col("ts")).alias("nominal"))


@query(f"WITH {SCENES} SELECT item_seq, {SOLAR.format(lon='lon')} AS solar_date, ts + to_hours(trunc(lon / 15)::BIGINT) AS solar FROM scenes")
def solar_date(spark, d):
    return scenes(spark, d).select("item_seq", S.solar_day("ts", "lon").alias("solar_date"), S.solar_time("ts", "lon").alias("solar"))


def ring(x0, y0, x1, y1):
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])


@query(f"WITH {SCENES} SELECT item_seq, round(lon + 1.5, 6) AS mid FROM scenes")
def mid_longitude(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    return scenes(spark, d).select("item_seq", F.round(temporal.mid_longitude(F.array(ring(lon, lat, lon + 3, lat + 1))), 6).alias("mid"))


@query(f"""WITH {SCENES} SELECT item_seq, collection_id, ts, lon, lat FROM scenes
WHERE collection_id IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
  AND lon + 1 >= -60 AND lon <= 120 AND lat + 1 >= -50 AND lat <= 50 AND CAST(json_extract(props, '$.k') AS DOUBLE) < 50""")
def search_filter(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    x = scenes(spark, d).withColumns({"geometry": F.array(ring(lon, lat, lon + 1, lat + 1)), "properties": F.parse_json("props")})
    found = stac.search(x, collections=["click", "view", "purchase"], datetime=("2024-01-05", "2024-01-20 12:00:00"), bbox=(-60, -50, 120, 50), query={"k": {"lt": 50}})
    return found.select("item_seq", "collection_id", "ts", "lon", "lat")


# --- assets

PAGES = """p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat(url, '.TIF') WHEN 1 THEN concat(url, '.jp2') ELSE url END AS href,
  list_extract([NULL, 'image/jpeg', 'IMAGE/tiff; profile=x', 'text/html', 'application/x-hdf', 'application/x-hdf5', 'application/hdf', 'application/hdf5', 'application/x-netcdf', 'application/netcdf', 'application/x-zarr', 'application/zarr', 'application/vnd+zarr'], (page_id % 13 + 1)::INT) AS media_type,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['data'] WHEN 2 THEN ['thumbnail', 'x'] ELSE ['metadata'] END AS roles FROM pages)"""
MEDIA = ["image/jpeg", "IMAGE/tiff; profile=x", "text/html", "application/x-hdf", "application/x-hdf5", "application/hdf", "application/hdf5", "application/x-netcdf", "application/netcdf", "application/x-zarr", "application/zarr", "application/vnd+zarr"]
IS_RASTER = """CASE WHEN media_type IS NULL THEN CASE WHEN coalesce(list_contains(roles, 'data'), false) THEN true WHEN coalesce(list_contains(roles, 'metadata'), false) THEN false
  ELSE lower(list_extract(string_split(href, '.'), -1)) IN ('tif', 'tiff', 'jpeg', 'jpg', 'jp2', 'img', 'hdf', 'nc', 'zarr') END
  WHEN lower(trim(split_part(media_type, ';', 1))) LIKE 'image/%' THEN NOT coalesce(list_has_any(roles, ['thumbnail', 'overview']), false)
  ELSE lower(trim(split_part(media_type, ';', 1))) IN ('application/x-hdf', 'application/x-hdf5', 'application/hdf', 'application/hdf5', 'application/x-netcdf', 'application/netcdf', 'application/x-zarr', 'application/zarr') END"""


def page_assets(spark, d) -> DataFrame:
    n = F.col("page_id")
    pick = lambda k, *v: F.element_at(F.array(*v), (n % k + 1).cast("int"))
    arr = lambda *v: F.array(*map(F.lit, v))
    return table(spark, d, "pages").select(
        n, pick(3, F.concat("url", F.lit(".TIF")), F.concat("url", F.lit(".jp2")), F.col("url")).alias("href"),
        pick(13, F.lit(None).cast("string"), *map(F.lit, MEDIA)).alias("media_type"),
        F.when(n % 4 == 1, arr("data")).when(n % 4 == 2, arr("thumbnail", "x")).when(n % 4 == 3, arr("metadata")).alias("roles"),
    )


@query(f"WITH {PAGES} SELECT page_id, {IS_RASTER} AS is_raster FROM p")
def raster_predicate(spark, d):
    return page_assets(spark, d).select("page_id", stac.is_raster().alias("is_raster"))


def part_assets(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts as assets: a brand is a collection with one item, a part an asset."""
    p = table(spark, d, "part")
    none = lambda t: F.lit(None).cast(t)
    shaped = F.col("p_size") > 45
    kind = F.when(F.col("p_size") % 3 == 0, "image/tiff").when(F.col("p_size") % 3 == 1, "text/xml")
    a = p.select(
        F.lit(0).cast("long").alias("item_seq"), F.col("p_brand").alias("collection_id"), F.col("p_partkey").cast("int").alias("asset_pos"), F.concat(F.lit("a"), "p_partkey").alias("asset"),
        F.concat(F.lit("x."), F.when(F.col("p_partkey") % 2 == 0, "tif").otherwise("txt")).alias("href"), kind.alias("media_type"), none("array<string>").alias("roles"),
        F.when(shaped, F.array(F.lit(10), F.lit(10))).alias("proj_shape"), F.when(shaped, F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, -1, 0)])).alias("proj_transform"), F.lit("EPSG:4326").alias("proj_crs"),
        F.col("p_size").cast("double").alias("gsd"),
    )
    i = p.select(F.col("p_brand").alias("collection_id")).distinct().select("collection_id", F.lit(0).cast("long").alias("item_seq"), F.lit(True).alias("has_proj_ext"))
    return a, i


@query("""WITH a AS (SELECT *, coalesce(CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false ELSE p_partkey % 2 = 0 END, false) AS pixels, p_size > 45 AS shaped FROM part),
f AS (SELECT p_brand, bool_or(pixels AND shaped) AS has_proj FROM a GROUP BY p_brand)
SELECT p_brand AS collection_id, concat('a', p_partkey) AS asset, has_proj FROM a JOIN f USING (p_brand) WHERE pixels AND (shaped OR NOT has_proj)""")
def proj_fallback(spark, d):
    a, i = part_assets(spark, d)
    return infer.keep_raster(a, i, infer.MDConfig()).select("collection_id", "asset", "has_proj")


# bands: parts of a brand are assets with p_size % 3 + 1 bands; the type is an alias

BANDS = """b AS (SELECT p_brand AS collection_id, concat('a', p_partkey) AS asset, i AS idx, p_partkey * 4 + i AS band_pos FROM part, range(1, 4) t(i) WHERE i <= p_size % 3 + 1),
c AS (SELECT p_brand AS collection_id, p_type AS alias, concat('a', p_partkey) AS asset, p_partkey AS asset_pos, i AS idx, p_size % 3 + 1 AS n FROM part, range(1, 4) t(i) WHERE i <= p_size % 3 + 1),
al AS (SELECT collection_id, alias, asset, idx, row_number() OVER (PARTITION BY collection_id, alias ORDER BY n, asset, asset_pos, idx) - 1 AS rank FROM c)"""


def part_bands(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select("*", F.explode(F.sequence(F.lit(1), (F.col("p_size") % 3 + 1).cast("int"))).alias("idx"))
    p = p.select(F.col("p_brand").alias("collection_id"), F.concat(F.lit("a"), "p_partkey").alias("asset"), "idx", F.col("p_partkey").alias("asset_pos"), (F.col("p_partkey") * 4 + F.col("idx")).alias("band_pos"), "p_type")
    bands = p.select("collection_id", "asset", "idx", "band_pos", F.lit("uint16").alias("data_type"), F.lit(0.0).alias("nodata"), F.lit("1").alias("unit"))
    aliases = B.alias_choices(p.select("collection_id", "asset", "asset_pos", "idx", F.col("p_type").alias("name"), F.lit(None).cast("string").alias("common_name")))
    return bands, aliases


@query(f"WITH {BANDS} SELECT collection_id, alias, asset, idx::BIGINT AS idx, rank::BIGINT AS rank FROM al")
def alias_rank(spark, d):
    return part_bands(spark, d)[1].select("collection_id", "alias", "asset", F.col("idx").cast("long"), "rank")


@query(f"WITH {BANDS} SELECT collection_id, asset, idx::BIGINT AS idx, string_agg(alias, ',' ORDER BY alias) AS aliases FROM al WHERE rank = 0 GROUP BY ALL")
def alias_invert(spark, d):
    x = B.band_aliases(part_bands(spark, d)[1], unique=True)
    return x.select("collection_id", "asset", F.col("idx").cast("long"), F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query(f"""WITH {BANDS}, n AS (SELECT *, count(*) OVER (PARTITION BY collection_id, asset) AS n FROM b), f AS (SELECT collection_id, asset, idx, min(alias) AS alias FROM al WHERE rank = 0 GROUP BY ALL)
SELECT n.collection_id, n.asset, n.idx::BIGINT AS idx, CASE WHEN n = 1 THEN n.asset ELSE coalesce(alias, concat(n.asset, '.', n.idx)) END AS name FROM n LEFT JOIN f ON n.collection_id = f.collection_id AND n.asset = f.asset AND n.idx = f.idx""")
def canonical_name(spark, d):
    bands, aliases = part_bands(spark, d)
    return B.canonical_names(bands, aliases).select("collection_id", "asset", F.col("idx").cast("long"), "name")


ASKED = ["a1", "a2.2", "a3.1", "ECONOMY", "STANDARD", "a5"]
Q_SQL = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))


@query(f"""WITH {BANDS}, q AS (SELECT * FROM (VALUES {Q_SQL}) t(pos, query)), ids AS (SELECT DISTINCT collection_id FROM b),
k AS (SELECT ids.collection_id, pos, query, EXISTS (SELECT 1 FROM b WHERE b.collection_id = ids.collection_id AND b.asset = query) AS whole,
  (SELECT min(a.asset) FROM al a WHERE a.collection_id = ids.collection_id AND a.alias = query AND a.rank = 0) AS fa, (SELECT min(a.idx) FROM al a WHERE a.collection_id = ids.collection_id AND a.alias = query AND a.rank = 0) AS fi FROM ids, q),
r AS (SELECT collection_id, pos, query, CASE WHEN whole THEN query WHEN fa IS NOT NULL THEN fa ELSE split_part(query, '.', 1) END AS asset,
  CASE WHEN whole THEN 1 WHEN fa IS NOT NULL THEN fi WHEN contains(query, '.') THEN CAST(split_part(query, '.', 2) AS BIGINT) ELSE 1 END AS idx FROM k)
SELECT r.collection_id, r.pos::BIGINT AS pos, r.query, b.asset, b.idx::BIGINT AS idx FROM r LEFT JOIN b ON r.collection_id = b.collection_id AND r.asset = b.asset AND r.idx = b.idx""")
def band_resolve_outer(spark, d):
    bands, aliases = part_bands(spark, d)
    got = B.resolve_bands(B.band_query(spark, ASKED), bands, aliases, outer=True)
    return got.select("collection_id", F.col("pos").cast("long"), "query", "asset", F.col("idx").cast("long"))


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'mode' WHEN 'Brand#12' THEN 'sum' ELSE 'nearest' END AS resampling,
CASE p_brand WHEN 'Brand#13' THEN 'int16' WHEN 'Brand#14' THEN 'float64' ELSE 'uint16' END AS dtype, CASE WHEN p_brand = 'Brand#11' THEN -1 ELSE 7 END::DOUBLE AS fill_value FROM part""")
def wildcard_cfg(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("band"))
    b = p.select(F.col("band").alias("query"), F.lit("uint16").alias("data_type"), F.lit(7.0).alias("nodata")).distinct()
    c = B.load_config(b, resampling={"*": "nearest", "Brand#11": "mode", "Brand#12": "sum"}, dtype={"Brand#13": "int16", "Brand#14": "float64"}, nodata={"Brand#11": -1})
    return p.join(c, "band").select("p_partkey", "resampling", "dtype", "fill_value")


# --- grids


@query("""WITH g AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS pos FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size, pos) AS rank FROM g)
SELECT p.p_brand AS collection_id, concat('a', p.p_partkey) AS asset, CASE WHEN rank = 1 THEN 'default' ELSE concat('g', p.p_size) END AS grid_name FROM part p JOIN r ON p.p_brand = r.p_brand AND p.p_size = r.p_size""")
def grid_group_gsd(spark, d):
    x = part_assets(spark, d)[0].select("collection_id", "asset", "asset_pos", F.col("gsd").alias("grid"))
    return grids.name_grids(x).select("collection_id", "asset", "grid_name")


def _part_grid():
    """A grid of each part: one of four shapes and three resolutions, so that names clash."""
    n, r = F.col("p_partkey"), F.element_at(F.array(F.lit(10.0), F.lit(20.0), F.lit(60.0)), (F.col("p_size") % 3 + 1).cast("int"))
    z = F.lit(0.0)
    return grids.grid_of(F.lit(100) + n % 4, F.lit(100), r, z, F.lit(300000.0), z, -r, F.lit(6000000.0), F.lit("EPSG:32633"))


@query("""WITH a AS (SELECT p_brand, p_partkey, 100 + p_partkey % 4 AS h, CASE p_size % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 60 END AS r FROM part),
g AS (SELECT p_brand, h, r, count(*) AS n, min(p_partkey) AS pos FROM a GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, r, pos) AS rank FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, r, rank = 1 ORDER BY pos) AS taken FROM k)
SELECT a.p_brand AS collection_id, concat('a', p_partkey) AS asset, CASE WHEN rank = 1 THEN 'default' WHEN taken = 1 THEN concat('g', a.r) ELSE concat('g', a.r, '-a', pos) END AS grid_name
FROM a JOIN t ON a.p_brand = t.p_brand AND a.h = t.h AND a.r = t.r""")
def grid_group_default(spark, d):
    p = table(spark, d, "part")
    x = p.select(F.col("p_brand").alias("collection_id"), F.concat(F.lit("a"), "p_partkey").alias("asset"), F.col("p_partkey").alias("asset_pos"), _part_grid().alias("grid"))
    return grids.name_grids(x).select("collection_id", "asset", "grid_name")


@query("""WITH a AS (SELECT p_partkey AS seq, CASE p_size % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 60 END::DOUBLE AS r FROM part), f AS (SELECT r, count(*) AS n, min(seq) AS s FROM a GROUP BY r)
SELECT 'EPSG:32633' AS crs, r AS res_x, -r AS res_y, 0.0::DOUBLE AS anchor_x, 0.0::DOUBLE AS anchor_y FROM f ORDER BY n DESC, s LIMIT 1""")
def most_common_grid(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("item_seq"), _part_grid().alias("grid"))
    return grids.most_common_grid(x).drop("grid")


@query("""WITH a AS (SELECT p_partkey % 50 AS item_seq, p_partkey, 100 + p_partkey % 4 AS h, CASE p_size % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 60 END::DOUBLE AS r FROM part)
SELECT item_seq, arg_min(h, (r, p_partkey))::BIGINT AS h, min(r) AS r FROM a GROUP BY item_seq""")
def finest_grid(spark, d):
    x = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("item_seq"), F.col("p_partkey").alias("band_pos"), _part_grid().alias("grid"))
    return grids.finest_grids(x).select("item_seq", F.col("grid.h").cast("long").alias("h"), F.col("grid.a").alias("r"))


@query(f"WITH {SCENES} SELECT collection_id, min(lon) AS x0, min(lat) AS y0, max(lon + 2) AS x1, max(lat + 1) AS y1 FROM scenes GROUP BY collection_id")
def bbox_union(spark, d):
    x = scenes(spark, d).select("collection_id", F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 2).alias("x1"), (F.col("lat") + 1).alias("y1"))
    return grids.union_bbox(x, ["collection_id"])


@query("""SELECT p_partkey, CASE WHEN f < 1e-3 OR 1 - f < 1e-3 THEN 0.0 WHEN abs(f - 0.5) < 1e-3 THEN 0.5 ELSE round(f, 6) END::DOUBLE AS anchor
FROM (SELECT p_partkey, (-(p_size / 8.0::DOUBLE)) - floor(-(p_size / 8.0::DOUBLE)) AS f FROM part)""")
def grid_anchor(spark, d):
    z = F.lit(0.0)
    g = grids.grid_of(F.lit(5), F.lit(5), F.lit(1.0), z, F.col("p_size") / 8.0, z, F.lit(-1.0), z, F.lit("EPSG:3857"))
    return table(spark, d, "part").select("p_partkey", F.round(grids.grid_anchor(g)["x"], 6).alias("anchor"))


WORLD = Grid(160, 360, 1.0, 0.0, -180.0, 0.0, -1.0, 80.0, "EPSG:4326")
TILE = (16, 20)
SPINE = "spine AS (SELECT ty, tx FROM range(0, 10) a(ty), range(0, 18) b(tx))"


@query(f"WITH {SPINE} SELECT ty, tx, ty * 16 AS y0, least(160, ty * 16 + 16) AS y1, tx * 20 AS x0, least(360, tx * 20 + 20) AS x1 FROM spine")
def tile_spine(spark, d):
    x = binning.tile_spine(spark, WORLD, TILE)
    return x.select(*[F.col(c).cast("long") for c in ("ty", "tx", "y0", "y1", "x0", "x1")])


def placed(spark, d) -> DataFrame:
    """Scenes in planes by solar day with footprints of 3 by 2 degrees in pixels of WORLD."""
    x = temporal.group_items(scenes(spark, d), "solar_day")
    px, py = F.col("lon") + 180, 80 - F.col("lat")
    box = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((px, py), (px + 3, py), (px + 3, py + 2), (px, py + 2))])
    return binning.bin_items(x.withColumn("footprint", box), WORLD, TILE)


BINS = f"""{SCENES}, k AS (SELECT *, {SOLAR.format(lon="lon")} AS key FROM scenes),
g AS (SELECT *, dense_rank() OVER (ORDER BY key) - 1 AS t_idx, row_number() OVER (PARTITION BY key ORDER BY ts, id, item_seq) - 1 AS prio FROM k), {SPINE},
bins AS (SELECT t_idx, ty, tx, string_agg(item_seq, ',' ORDER BY prio) AS items FROM g JOIN spine ON lon + 180 < tx * 20 + 20 AND lon + 183 > tx * 20 AND 80 - lat < ty * 16 + 16 AND 82 - lat > ty * 16
  GROUP BY t_idx, ty, tx)"""


@query(f"WITH {BINS} SELECT * FROM bins")
def tile_bins(spark, d):
    b = binning.tile_bins(placed(spark, d))
    return b.select("t_idx", F.col("ty").cast("long"), F.col("tx").cast("long"), F.array_join("items", ",").alias("items"))


@query(f"WITH {BINS} SELECT t.t_idx, s.ty, s.tx, coalesce(items, '') AS items FROM (SELECT DISTINCT t_idx FROM g) t CROSS JOIN spine s LEFT JOIN bins b ON t.t_idx = b.t_idx AND s.ty = b.ty AND s.tx = b.tx")
def tile_bins_dense(spark, d):
    p = placed(spark, d)
    planes = temporal.number_planes(scenes(spark, d), temporal.group_key("solar_day")).select("t_idx").distinct()
    b = binning.dense_bins(binning.tile_bins(p), binning.tile_spine(spark, WORLD, TILE), planes)
    return b.select("t_idx", F.col("ty").cast("long"), F.col("tx").cast("long"), F.array_join("items", ",").alias("items"))


# --- pixels

PIXELS = """px AS (SELECT label::BIGINT AS t_idx, vec_id AS prio, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, floor(embedding[i] * 100)::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"""
ND = -999.0


def raster_rows(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("t_idx"), F.col("vec_id").alias("prio"), "embedding")
    p = pixels.tiles_to_rows(e, "embedding", 8, "t_idx", "prio")
    return p.select("t_idx", "prio", F.col("y").cast("long"), F.col("x").cast("long"), F.floor(F.col("v") * F.lit(100).cast("float")).cast("double").alias("v"))


def masked(spark, d) -> DataFrame:
    return raster_rows(spark, d).withColumn("v", F.when(F.col("v") < 0, ND).otherwise(F.col("v")))


@query(f"WITH {PIXELS} SELECT t_idx, y, x, arg_min(v, prio) AS v FROM px WHERE v >= 0 GROUP BY t_idx, y, x")
def mosaic_first_valid(spark, d):
    return pixels.fuse_rows(masked(spark, d), "float32", ND, keys=("t_idx",))


@query(f"WITH {PIXELS}, f AS (SELECT t_idx, min(prio) AS prio FROM px GROUP BY t_idx) SELECT t_idx, y, x, v FROM px JOIN f USING (t_idx, prio)")
def mosaic_no_nodata(spark, d):
    return pixels.fuse_rows(raster_rows(spark, d), "int16", None, keys=("t_idx",))


@query(f"""WITH {PIXELS}, m AS (SELECT t_idx, y, x, arg_min(v, prio) AS v FROM px WHERE v >= 30 GROUP BY ALL), s AS (SELECT t_idx, y, x FROM (SELECT DISTINCT t_idx FROM px), range(0, 9) a(y), range(0, 9) b(x))
SELECT s.t_idx, s.y, s.x, coalesce(v, -999)::BIGINT AS v FROM s LEFT JOIN m ON s.t_idx = m.t_idx AND s.y = m.y AND s.x = m.x""")
def mosaic_dense_fill(spark, d):
    r = raster_rows(spark, d).withColumn("v", F.when(F.col("v") < 30, ND).otherwise(F.col("v")))
    at = spark.range(81).select(F.floor(F.col("id") / 9).alias("y"), (F.col("id") % 9).alias("x"))
    spine = r.select("t_idx").distinct().join(F.broadcast(at))  # the output's own pixels
    got = pixels.dense(pixels.fuse_rows(r, "int16", ND, keys=("t_idx",)), spine, "int16", ND, ("t_idx",))
    return got.select("t_idx", "y", "x", F.col("v").cast("long"))


@query(f"WITH {PIXELS} SELECT t_idx, prio, y, x, first_value(CASE WHEN v >= 0 THEN v END IGNORE NULLS) OVER (PARTITION BY t_idx, y, x ORDER BY prio ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fused FROM px")
def mosaic_window(spark, d):
    return pixels.first_valid_window(masked(spark, d), "float32", ND, ("t_idx",)).drop("v")


@query(f"WITH {PIXELS} SELECT t_idx, prio, y, x, CASE WHEN v < 0 THEN -1 ELSE least(v, 255) END::DOUBLE AS v FROM px")
def nodata_remap(spark, d):
    return masked(spark, d).withColumn("v", pixels.remap("v", ND, -1, "float32", "uint8"))


@query(f"WITH {PIXELS} SELECT t_idx, prio, y, x, greatest(0, least(255, trunc(v * 3.7)))::BIGINT AS u8, greatest(-128, least(127, trunc(v * 3.7)))::BIGINT AS i8 FROM px")
def dtype_cast(spark, d):
    r = raster_rows(spark, d)
    return r.select("t_idx", "prio", "y", "x", S.to_dtype(F.col("v") * 3.7, "uint8").cast("long").alias("u8"), S.to_dtype(F.col("v") * 3.7, "int8").cast("long").alias("i8"))


@query("""WITH n AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 0 ELSE -1 END AS v FROM nation)
SELECT a.k::BIGINT AS a, b.k::BIGINT AS b, a.v IS NOT DISTINCT FROM b.v AS same FROM n a JOIN n b ON b.k = (a.k * 7 + 3) % 25""")
def same_nodata(spark, d):
    k = F.col("n_nationkey").cast("long")
    n = table(spark, d, "nation").select(k.alias("k"), F.when(k % 4 == 1, float("nan")).when(k % 4 == 2, 0.0).when(k % 4 == 3, -1.0).alias("v"))
    b = n.select(F.col("k").alias("b"), F.col("v").alias("w"))
    return n.join(b, F.col("b") == (F.col("k") * 7 + 3) % 25).select(F.col("k").alias("a"), "b", S.same_nodata("v", "w").alias("same"))


def _resample(kind: str, agg: str):
    def f(spark, d):
        x = masked(spark, d).withColumn("vec_id", F.col("prio"))
        out = pixels.resample_rows(x, 2, 2, kind, "float32", ND, ("vec_id",))
        return out.select("vec_id", F.col("y").cast("long"), F.col("x").cast("long"), F.round(F.col("v").cast("double"), 6).alias("v"))

    f.__name__ = f"resample_{kind}"
    query(f"WITH {PIXELS} SELECT prio AS vec_id, y // 2 AS y, x // 2 AS x, round(({agg})::DOUBLE, 6) AS v FROM px WHERE v >= 0 GROUP BY ALL")(f)


for _kind, _agg in (("average", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("sum", "sum(v)"), ("rms", "sqrt(avg(v * v))"), ("med", "quantile_disc(v, 0.5)"), ("q1", "quantile_disc(v, 0.25)"), ("q3", "quantile_disc(v, 0.75)")):
    _resample(_kind, _agg)


@query(f"WITH {PIXELS}, c AS (SELECT prio AS vec_id, y // 4 AS y, x // 4 AS x, v, count(*) AS n FROM px WHERE v >= 0 GROUP BY ALL) SELECT vec_id, y, x, arg_max(v, (n, -v)) AS v FROM c GROUP BY ALL")
def resample_mode(spark, d):
    out = pixels.resample_rows(masked(spark, d).withColumn("vec_id", F.col("prio")), 4, 4, "mode", "float32", ND, ("vec_id",))
    return out.select("vec_id", F.col("y").cast("long"), F.col("x").cast("long"), "v")


@query(f"WITH {PIXELS} SELECT prio AS vec_id, y // 2 AS y, x // 2 AS x, v FROM px WHERE y % 2 = 1 AND x % 2 = 1")
def resample_nearest(spark, d):
    out = pixels.resample_rows(raster_rows(spark, d).withColumn("vec_id", F.col("prio")), 2, 2, "nearest", "float32", ND, ("vec_id",))
    return out.select("vec_id", F.col("y").cast("long"), F.col("x").cast("long"), "v")


@query(f"WITH {PIXELS} SELECT prio, y + 3 - prio % 4 AS y, x - 2 + prio % 3 AS x, v FROM px WHERE y + 3 - prio % 4 BETWEEN 0 AND 7 AND x - 2 + prio % 3 BETWEEN 0 AND 7")
def paste_shift(spark, d):
    r = raster_rows(spark, d)
    return pixels.paste(r, 3 - F.col("prio") % 4, F.col("prio") % 3 - 2, 8, 8).select("prio", "y", "x", "v")


@query("SELECT p_partkey, (SELECT max(CASE o WHEN 2 THEN 0 WHEN 4 THEN 1 ELSE 2 END) FROM (VALUES (2), (4), (8)) t(o) WHERE o <= p_size)::BIGINT AS level FROM part")
def overview_pick(spark, d):
    return table(spark, d, "part").select("p_partkey", S.pick_overview("p_size", F.array(F.lit(2), F.lit(4), F.lit(8))).cast("long").alias("level"))


@query("SELECT p_partkey, (SELECT string_agg(least(7, p_size - o), ',' ORDER BY o) FROM range(0, p_size, 7) t(o)) AS chunks FROM part WHERE p_size > 0")
def chunk_unpack(spark, d):
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.array_join(F.transform(S.chunk_sizes("p_size", F.lit(7)), lambda v: v.cast("string")), ",").alias("chunks"))


@query(f"WITH {PIXELS}, b AS (SELECT t_idx, y, x, max(CASE WHEN prio % 2 = 0 THEN v END) AS red, max(CASE WHEN prio % 2 = 1 THEN v END) AS nir FROM px GROUP BY ALL) SELECT t_idx, y, x, round((nir - red) / nullif(nir + red, 0), 9) AS ndvi FROM b")
def ndvi(spark, d):
    even = F.col("prio") % 2 == 0
    b = raster_rows(spark, d).groupBy("t_idx", "y", "x").agg(F.max(F.when(even, F.col("v"))).alias("red"), F.max(F.when(~even, F.col("v"))).alias("nir"))
    return b.select("t_idx", "y", "x", F.round(S.normalized_difference("nir", "red"), 9).alias("ndvi"))


@query(f"WITH {PIXELS} SELECT prio, y, x, ['black', 'brown', 'yellow', 'green'][1 + greatest(0, least(3, floor((v + 100) / 200 * 4)::INT))] AS color FROM px")
def colormap(spark, d):
    return raster_rows(spark, d).select("prio", "y", "x", S.color_of("v", -100, 100, ["black", "brown", "yellow", "green"]).alias("color"))


# --- documents

_V5 = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(f"WITH s AS (SELECT event_id, sha1(unhex('{S.NAMESPACE.hex}') || encode(event_type || chr(10) || event_id || chr(10))) AS h FROM events) SELECT event_id, {_V5.format(h='h')} AS uuid FROM s")
def dataset_uuid5(spark, d):
    x = table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("collection_id"))
    return x.select("event_id", products.dataset_uuid("auto").alias("uuid"))


@query("SELECT c_nationkey::BIGINT AS k, printf('%g', sum(c_acctbal)) AS g, printf('%g', count(*) * 10.0::DOUBLE) AS n FROM customer GROUP BY c_nationkey")
def short_numbers(spark, d):
    x = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("c"))
    return x.select("k", S.short_number("s").alias("g"), S.short_number(F.col("c") * 10.0).alias("n"))


@query("""SELECT o_orderstatus AS scenario, count(*) AS n, min(o_totalprice) AS best, max(round(1e6 / o_totalprice, 6)) AS throughput FROM orders GROUP BY o_orderstatus""")
def bench_report(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), F.lit("").alias("data"), F.lit("").alias("chunks"), F.lit(10**12).alias("npix"), F.lit(4).alias("n_threads"), F.lit(0.0).alias("t0"), F.lit(0.0).alias("t1"), F.col("o_totalprice").alias("t2"))
    return report.summary(report.collate(o)).select("scenario", "n", "best", F.round("throughput_mps", 6).alias("throughput"))


# --- the flagship: a mosaic for each solar day of a large table of scenes

BIG_SQL = """WITH s AS (SELECT l_returnflag AS collection_id, l_orderkey * 8 + l_linenumber AS item_seq, l_shipdate::TIMESTAMP AS ts, ((l_suppkey * 37) % 360 - 180)::DOUBLE AS lon, l_partkey % 64 AS cell, floor(l_quantity) AS v FROM lineitem),
k AS (SELECT *, CAST(ts + to_hours(trunc(lon / 15)::BIGINT) AS DATE) AS day FROM s)
SELECT collection_id, day, (cell // 8)::BIGINT AS y, (cell % 8)::BIGINT AS x, arg_min(v, item_seq) AS v, count(*) AS n_sources FROM k WHERE v <> 1 GROUP BY ALL"""


@query(BIG_SQL)
def solar_day_mosaic(spark, d):
    """First valid pixel by collection, solar day and cell: grouping and fusing in one partial and one final step."""
    li = table(spark, d, "lineitem")
    s = li.select(
        F.col("l_returnflag").alias("collection_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_seq"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        ((F.col("l_suppkey") * 37) % 360 - 180).cast("double").alias("lon"), (F.col("l_partkey") % 64).alias("cell"), F.floor("l_quantity").cast("double").alias("v"),
    )
    good = s.where(~S.missing("v", 1.0, "float32")).withColumn("day", S.solar_day("ts", "lon"))
    out = good.groupBy("collection_id", "day", "cell").agg(F.min_by("v", "item_seq").alias("v"), F.count("*").alias("n_sources"))
    return out.select("collection_id", "day", F.floor(F.col("cell") / 8).alias("y"), (F.col("cell") % 8).alias("x"), "v", "n_sources")

