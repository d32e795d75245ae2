"""Names of bands: aliases, resolution, canonical names, and what an item has of them.

Tables, one row each: ``bands`` (collection_id, asset, idx, band_pos, data_type, nodata, unit), ``aliases``
(collection_id, alias, alias_pos, rank, asset, idx); rank 0 is an alias's first choice. They have as many rows as a
collection has bands, so joins with them are broadcast by Spark where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import band_of


def band_query(spark: SparkSession, names: str | list[str] | None) -> DataFrame | None:
    """A query as rows (pos, query); None asks for all bands."""
    if names is None:
        return None
    names = [names] if isinstance(names, str) else list(names)
    return spark.createDataFrame(list(enumerate(names)), "pos int, query string")


def canonical_names(bands: DataFrame, aliases: DataFrame) -> DataFrame:
    """``bands`` with ``name``: the asset of a single-band asset, else the first alias whose first choice is the band,
    else ``asset.idx``."""
    first = aliases.where("rank = 0").groupBy("collection_id", "asset", "idx").agg(F.min_by("alias", "alias_pos").alias("alias"))
    many = F.count("*").over(W.partitionBy("collection_id", "asset"))
    x = bands.withColumn("n", many).join(first, ["collection_id", "asset", "idx"], "left")
    name = F.when(F.col("n") == 1, F.col("asset")).otherwise(F.coalesce("alias", F.concat_ws(".", "asset", F.col("idx").cast("string"))))
    return x.withColumn("name", name).drop("n", "alias")


def resolve_bands(query: DataFrame | None, bands: DataFrame, aliases: DataFrame, *, outer: bool = False) -> DataFrame:
    """(collection_id, pos, query, asset, idx, data_type, nodata, unit) in the order of the query.

    A name is an asset (its band 1), else an alias (its first choice), else ``asset.idx``. What a collection does not
    have fails, or with ``outer`` comes with nulls."""
    if query is None:
        named = canonical_names(bands, aliases)
        return named.select("collection_id", (F.row_number().over(W.partitionBy("collection_id").orderBy("band_pos")) - 1).alias("pos"), F.col("name").alias("query"), "asset", "idx", "data_type", "nodata", "unit")
    q = bands.select("collection_id").distinct().crossJoin(F.broadcast(query))  # names of one call by collections
    as_asset = bands.groupBy("collection_id", F.col("asset").alias("query")).agg(F.min("idx").alias("has"))
    as_alias = aliases.where("rank = 0").select("collection_id", F.col("alias").alias("query"), F.struct("asset", "idx").alias("first"))
    x = q.join(as_asset, ["collection_id", "query"], "left").join(as_alias, ["collection_id", "query"], "left")
    whole = F.struct(F.col("query").alias("asset"), F.lit(1).alias("idx"))
    x = x.withColumn("key", F.when(F.col("has").isNotNull(), whole).otherwise(F.coalesce("first", band_of("query"))))
    x = x.select("collection_id", "pos", "query", "key.*").join(bands, ["collection_id", "asset", "idx"], "left")
    have = F.col("band_pos").isNotNull()
    none = F.lit(None) if outer else F.raise_error(F.concat(F.lit("No such band: "), F.col("query")))
    return x.select("collection_id", "pos", "query", F.when(have, F.col("asset")).otherwise(none.cast("string")).alias("asset"), F.when(have, F.col("idx")).alias("idx"), "data_type", "nodata", "unit")


def item_bands(resolved: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of each item for each queried band; nulls where the item lacks it."""
    want = items.select("item_seq", "collection_id").join(resolved.select("collection_id", "pos", "query", "asset", "idx"), "collection_id")
    return want.join(sources, ["item_seq", "asset", "idx"], "left")


def strip_sources(sources: DataFrame) -> DataFrame:
    """Sources without their grids and metadata: what a task needs to open them."""
    return sources.select("item_seq", "collection_id", "asset", "idx", "uri")


def assets_of(sources: DataFrame) -> DataFrame:
    """(item_seq, asset, bands): the sources of each asset of an item, in order of their band."""
    each = F.struct("idx", "uri")
    return sources.groupBy("item_seq", "asset").agg(F.sort_array(F.collect_list(each)).alias("bands"))


def patch_urls(sources: DataFrame, edit, bands: DataFrame | None = None) -> DataFrame:
    """``sources`` with ``uri`` edited by a column, a function from column to column, or one from text to text; with
    ``bands`` (rows of ``resolve_bands``) only those of these bands."""
    uri = F.col("uri")
    if isinstance(edit, Column):
        new = edit
    else:
        try:
            new = edit(uri)
        except Exception:  # a function of texts
            new = None
        new = new if isinstance(new, Column) else F.udf(edit)(uri)
    if bands is None:
        return sources.withColumn("uri", new)
    chosen = bands.where("asset IS NOT NULL").select("collection_id", "asset", "idx").distinct().withColumn("_hit", F.lit(True))
    out = sources.join(chosen, ["collection_id", "asset", "idx"], "left")
    return out.withColumn("uri", F.when(F.col("_hit"), new).otherwise(uri)).drop("_hit")


def alias_choices(eo_bands: DataFrame) -> DataFrame:
    """``aliases`` from (collection_id, asset, asset_pos, idx, name, common_name), the ``eo:bands`` of raster assets.

    An alias is a name or a common name that is no asset's name. Of several bands with one alias, those of assets with
    fewer bands come first, then by asset, then in order. With a column ``late`` (the item in which an asset turned up
    after its collection's first item, else null), late assets of one band go before all others, the latest first, and
    late assets of several bands behind."""
    n = F.count("*").over(W.partitionBy("collection_id", "asset"))
    late = F.col("late") if "late" in eo_bands.columns else F.lit(None).cast("long")
    x = eo_bands.withColumns({"n": n, "late": late}).withColumn("a", F.explode(F.array_distinct(F.array_compact(F.array("name", "common_name")))))
    assets = eo_bands.select("collection_id", F.col("asset").alias("a")).distinct()
    x = x.join(assets, ["collection_id", "a"], "left_anti")
    single = F.col("late").isNotNull() & (F.col("n") == 1)
    group = F.when(single, 0).when(F.col("late").isNull(), 1).otherwise(2)
    turn = F.when(single, -F.col("late")).otherwise(F.coalesce("late", F.lit(0)))
    order = W.partitionBy("collection_id", "a").orderBy(group, turn, F.when(single, -F.col("asset_pos")), "n", "asset", "asset_pos", "idx")
    first = F.min(F.struct(F.coalesce("late", F.lit(-1)).alias("late"), "asset_pos", "idx")).over(W.partitionBy("collection_id", "a"))
    x = x.withColumns({"rank": (F.row_number().over(order) - 1).cast("long"), "first": first})
    pos = F.dense_rank().over(W.partitionBy("collection_id").orderBy("first", "a")) - 1
    return x.select("collection_id", F.col("a").alias("alias"), pos.cast("long").alias("alias_pos"), "rank", "asset", "idx")


def band_aliases(aliases: DataFrame, unique: bool = False) -> DataFrame:
    """Aliases of each band in order; with ``unique`` only those whose first choice it is."""
    x = aliases.where("rank = 0") if unique else aliases
    names = F.transform(F.sort_array(F.collect_list(F.struct("alias_pos", "alias"))), lambda a: a["alias"])
    return x.groupBy("collection_id", "asset", "idx").agg(names.alias("aliases"))


def contains(names: DataFrame, bands: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows of ``names`` (collection_id, query) that a collection knows: asset, alias, or ``asset.idx``."""
    known = bands.select("collection_id", F.col("asset").alias("query")).union(aliases.select("collection_id", "alias"))
    known = known.union(bands.select("collection_id", F.concat_ws(".", "asset", F.col("idx").cast("string"))))
    return names.join(known.distinct(), ["collection_id", "query"], "left_semi")


def merge_by_precedence(high: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which rows of ``high`` replace rows of ``low`` with the same keys."""
    return high.unionByName(low.join(high, keys, "left_anti"))


def load_config(bands: DataFrame, *, resampling=None, dtype=None, nodata=None, use_overviews: bool = True, fail_on_error: bool = True) -> DataFrame:
    """What each band (query, data_type, nodata) is loaded with. Options are one value, or a dict by band with ``*``
    for the rest; what no option says comes from the band's metadata: its type (float32 if not known), its nodata."""

    def pick(option, kind):
        if not isinstance(option, dict):
            return F.lit(option).cast(kind)
        got = F.lit(None).cast(kind)
        if named := [x for k, v in option.items() if k != "*" for x in (F.lit(k), F.lit(v).cast(kind))]:
            got = F.element_at(F.create_map(*named), F.col("query"))
        return F.coalesce(got, F.lit(option.get("*")).cast(kind))

    return bands.select(
        F.col("query").alias("band"),
        F.coalesce(pick(dtype, "string"), "data_type", F.lit("float32")).alias("dtype"),
        F.coalesce(pick(nodata, "double"), "nodata").alias("fill_value"),
        F.coalesce(pick(resampling, "string"), F.lit("nearest")).alias("resampling"),
        F.lit(use_overviews).alias("use_overviews"),
        F.lit(fail_on_error).alias("fail_on_error"),
    )


def band_config(band: str, data_type: str | None, nodata_of: float | None, *, resampling=None, dtype=None, nodata=None, use_overviews: bool = True, fail_on_error: bool = True) -> dict:
    """A row of ``load_config`` for the planner, which has the band's metadata at hand."""

    def pick(option):
        return option.get(band, option.get("*")) if isinstance(option, dict) else option

    fill = pick(nodata)
    fill = nodata_of if fill is None else float(fill)
    return {"band": band, "dtype": pick(dtype) or data_type or "float32", "fill_value": fill, "resampling": pick(resampling) or "nearest", "use_overviews": use_overviews, "fail_on_error": fail_on_error}
