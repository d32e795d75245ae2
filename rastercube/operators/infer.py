"""Schemas of collections from their items: bands, aliases, grids, as tables.

A collection's schema is that of the first item in which each asset appears; later items add assets and change nothing.
``MDConfig`` holds what the user says about a collection; it goes before what documents say.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import remove, shared_dir
from ..sources import stac
from ..sources.stac import is_raster
from .bands import alias_choices, merge_by_precedence
from .grids import GRID, asset_grid


@dataclass
class MDConfig:
    """Settings by collection id, ``*`` for the rest: ``assets`` (by name, ``*`` for the rest: data_type, nodata, unit),
    ``aliases`` (alias to asset or [asset, idx]), ``ignore_proj``. A collection's ``assets`` replace those of ``*``."""

    cfg: dict = field(default_factory=dict)

    def of(self, collection: str) -> dict:
        return {**self.cfg.get("*", {}), **self.cfg.get(collection, {})}

    @property
    def known(self) -> list[str]:
        return [c for c in self.cfg if c != "*" and isinstance(self.cfg[c], dict)]

    def names_assets(self) -> bool:
        return any(self.of(c).get("assets") for c in ["*", *self.known])

    def asset_table(self, spark: SparkSession) -> DataFrame:
        """(collection_id or null for the rest, asset or ``*``, data_type, nodata, unit)"""
        rows = []
        for c in ["*", *self.known]:
            for asset, m in self.of(c).get("assets", {}).items():
                nodata = m.get("nodata")
                rows.append((None if c == "*" else c, asset, m.get("data_type"), None if nodata is None else float(nodata), m.get("unit")))
        return spark.createDataFrame(rows, "collection_id string, asset string, data_type string, nodata double, unit string")

    def alias_table(self, spark: SparkSession) -> DataFrame:
        """(collection_id or null, alias, asset, idx)"""
        rows = []
        for c in ["*", *self.known]:
            for alias, to in self.of(c).get("aliases", {}).items():
                asset, idx = to if isinstance(to, list | tuple) else (to, 1)
                rows.append((None if c == "*" else c, alias, asset, int(idx)))
        return spark.createDataFrame(rows, "collection_id string, alias string, asset string, idx int")

    def ignore_proj(self, collection: Column) -> Column:
        out = F.lit(bool(self.cfg.get("*", {}).get("ignore_proj", False)))
        for c in self.known:
            out = F.when(collection == c, F.lit(bool(self.of(c).get("ignore_proj", False)))).otherwise(out)
        return out


def _configured(table: DataFrame, known: list[str], x: DataFrame, name: str) -> DataFrame:
    """Join settings on the collection, or on the rest where the collection has none of its own. The settings are an
    argument: as many rows as the user wrote."""
    own = F.when(F.col("collection_id").isin(known), F.col("collection_id")) if known else F.lit(None).cast("string")
    t = table.select(F.col("collection_id").alias("_c"), F.col("asset").alias("_a"), F.struct("data_type", "nodata", "unit").alias(name))
    return x.withColumn("_own", own).join(F.broadcast(t), F.col("_own").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_a")), "left").drop("_c", "_a", "_own")


def measured(table: DataFrame) -> DataFrame:
    """A table of a few rows a collection, kept and counted: once its size is known, Spark broadcasts it if it is small.
    By an estimate it would deal the rows of all items by collection, so that one task had all those of a large one."""
    table = table.persist()
    table.count()
    return table


def candidates(assets: DataFrame, config: MDConfig) -> DataFrame:
    """The assets that are pixels or named in the settings, with ``named``, ``pixels`` and ``shaped``."""
    x = assets.withColumn("named", F.lit(False))
    if config.names_assets():
        own = config.asset_table(assets.sparkSession).where("asset <> '*'").select("collection_id", F.col("asset").alias("_named"))
        known = config.known
        mine = F.when(F.col("collection_id").isin(known), F.col("collection_id")) if known else F.lit(None).cast("string")
        named = own.select(F.col("collection_id").alias("_c"), "_named", F.lit(True).alias("_hit"))
        x = x.withColumn("_own", mine).join(F.broadcast(named), F.col("_own").eqNullSafe(F.col("_c")) & (F.col("asset") == F.col("_named")), "left")
        x = x.withColumn("named", F.coalesce("_hit", F.lit(False))).drop("_own", "_c", "_named", "_hit")
    x = x.withColumns({"pixels": is_raster(), "shaped": F.col("proj_shape").isNotNull() & F.col("proj_transform").isNotNull()})
    return x.where("named OR pixels")


def projections(some: DataFrame, items: DataFrame, config: MDConfig) -> DataFrame:
    """(collection_id, first_seq, has_proj) from ``candidates`` and items: the first item of each collection, and whether
    that declares the projection extension and has a candidate with a shape. Longs only, summed up before the shuffle."""
    declared = items.groupBy("collection_id").agg(F.min_by("has_proj_ext", "item_seq").alias("declared"), F.min("item_seq").alias("first_seq"))
    shaped = some.where("shaped").groupBy("collection_id").agg(F.min("item_seq").alias("shaped_seq"))
    any_shaped = F.coalesce(F.col("shaped_seq") == F.col("first_seq"), F.lit(False))
    x = declared.join(shaped, "collection_id", "left")
    return x.select("collection_id", "first_seq", (F.col("declared") & any_shaped & ~config.ignore_proj(F.col("collection_id"))).alias("has_proj"))


def keep_raster(assets: DataFrame, items: DataFrame, config: MDConfig) -> DataFrame:
    """The assets that are pixels, with ``has_proj`` and ``first_seq`` (the first item) of their collection.

    Assets named in the settings stay. Others must be pixels and, where the collection's first item declares the
    projection extension, have a shape and a transform; if no asset of that item has, that demand is dropped for the
    collection."""
    some = candidates(assets, config)
    return with_projection(some, measured(projections(some, items, config)))


def with_projection(some: DataFrame, proj: DataFrame) -> DataFrame:
    return some.join(proj, "collection_id").where("named OR (pixels AND (shaped OR NOT has_proj))")


def first_seqs(raster: DataFrame) -> DataFrame:
    """(collection_id, asset, item_seq): the first item that has an asset."""
    return raster.groupBy("collection_id", "asset").agg(F.min("item_seq").alias("item_seq"))


def first_assets(raster: DataFrame) -> DataFrame:
    """Each asset of a collection from the first item that has it, in the order (item_seq, asset_pos)."""
    rows = raster.join(measured(first_seqs(raster)), ["collection_id", "asset", "item_seq"], "left_semi")
    return _first(rows)


def _first(rows: DataFrame) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("collection_id", "asset")]
    row = rows.groupBy("collection_id", "asset").agg(F.min_by(F.struct(*keep), F.struct("item_seq", "asset_pos")).alias("r"))
    return row.select("collection_id", "asset", "r.*")


def bands_table(first: DataFrame, config: MDConfig) -> DataFrame:
    """(collection_id, asset, idx, band_pos, data_type, nodata, unit). An asset named in the settings has one band. Field
    by field: what the settings say of the asset, the document's raster bands, the settings' ``*``, then float32, no
    nodata, unit 1."""
    one = F.array(F.struct(*[F.lit(None).cast("string").alias(k) for k in ("data_type", "nodata", "unit")]))
    many = F.when(F.col("named") | F.col("raster_bands").isNull() | (F.size("raster_bands") == 0), one).otherwise(F.col("raster_bands"))
    x = first.select("collection_id", "asset", "item_seq", "asset_pos", "named", F.posexplode(many).alias("i", "b"))
    if config.names_assets():
        table = config.asset_table(first.sparkSession)
        x = _configured(table.where("asset <> '*'"), config.known, x.withColumn("_key", F.col("asset")), "exact")
        x = _configured(table.where("asset = '*'"), config.known, x.withColumn("_key", F.lit("*")), "rest")
    else:
        none = F.lit(None).cast("struct<data_type:string,nodata:double,unit:string>")
        x = x.withColumns({"exact": none, "rest": none})
    pos = F.row_number().over(W.partitionBy("collection_id").orderBy("item_seq", "asset_pos", "i")) - 1
    return x.select(
        "collection_id", "asset", (F.col("i") + 1).alias("idx"), pos.alias("band_pos"),
        F.coalesce("exact.data_type", "b.data_type", "rest.data_type", F.lit("float32")).alias("data_type"),
        F.coalesce("exact.nodata", F.col("b.nodata").try_cast("double"), "rest.nodata").alias("nodata"),
        F.coalesce("exact.unit", "b.unit", "rest.unit", F.lit("1")).alias("unit"),
    )


def aliases_table(first: DataFrame, config: MDConfig) -> DataFrame:
    """(collection_id, alias, alias_pos, rank, asset, idx): aliases of the settings first, then those of ``eo:bands``."""
    eo = first.where("eo_bands IS NOT NULL").select("collection_id", "asset", "asset_pos", F.when(F.col("item_seq") > F.col("first_seq"), F.col("item_seq")).alias("late"), F.posexplode("eo_bands").alias("i", "e"))
    found = alias_choices(eo.select("collection_id", "asset", "asset_pos", "late", (F.col("i") + 1).alias("idx"), "e.name", "e.common_name"))
    if not any(config.of(c).get("aliases") for c in ["*", *config.known]):
        return found
    table, known = config.alias_table(first.sparkSession), config.known
    ids = first.select("collection_id").distinct().withColumn("_own", F.when(F.col("collection_id").isin(known), F.col("collection_id")) if known else F.lit(None).cast("string"))
    own = ids.join(F.broadcast(table.withColumnRenamed("collection_id", "_c")), F.col("_own").eqNullSafe(F.col("_c"))).select("collection_id", "alias", F.lit(-1).cast("long").alias("alias_pos"), F.lit(0).cast("long").alias("rank"), "asset", "idx")
    return merge_by_precedence(own, found, ["collection_id", "alias"])


def late_assets(first: DataFrame) -> DataFrame:
    """Assets that their collection's first item does not have."""
    return first.where("item_seq > first_seq")


def _grid() -> Column:
    return F.when(F.col("proj_shape").isNotNull() & F.col("proj_transform").isNotNull(), asset_grid(F.col("proj_shape"), F.col("proj_transform"), F.col("proj_crs")))


def grids_table(rows: DataFrame) -> DataFrame:
    """(collection_id, asset, grid_name): named groups of equal grids, or of equal gsd where there is no projection, in
    the collection's first item (as ``grids.name_grids`` does for tables). A later asset has the grid of an asset that was
    known before and that has the same grid in the item where it appears (the last of several), else one of its own,
    ``grid-<asset>``. ``rows``: the assets of items in which an asset turns up; a group is one collection's."""
    rows = rows.select("collection_id", "item_seq", "asset_pos", "asset", "first_seq", "has_proj", F.coalesce("gsd", F.lit(0.0)).alias("gsd"), F.when(F.col("has_proj"), _grid()).alias("grid"))
    return rows.groupBy("collection_id").applyInArrow(_name_collection, "collection_id string, asset string, grid_name string")


def _name_collection(t: pa.Table) -> pa.Table:
    rows = t.sort_by([("item_seq", "ascending"), ("asset_pos", "ascending")]).to_pylist()
    for r in rows:
        r["key"] = r["gsd"] if not r["has_proj"] else None if r["grid"] is None else tuple(r["grid"].values())
        r["size"] = r["gsd"] if not r["has_proj"] or r["grid"] is None else min(abs(r["grid"]["a"]), abs(r["grid"]["e"]))
    start = rows[0]["first_seq"]
    groups: dict = {}
    for r in rows:
        if r["item_seq"] == start and r["key"] is not None:
            groups.setdefault(r["key"], []).append(r)
    names: dict[str, str] = {}
    taken: set[str] = set()
    best = min(groups.values(), key=lambda g: (-len(g), g[0]["size"], g[0]["asset_pos"]), default=None)
    for g in groups.values():
        plain = f"g{g[0]['size']:g}"
        name = "default" if g is best else plain if plain not in taken else f"{plain}-{g[0]['asset']}"
        if g is not best:
            taken.add(plain)
        names |= {r["asset"]: name for r in g}
    seen = {r["asset"] for r in rows if r["item_seq"] == start}
    later: dict[int, list] = {}
    for r in rows:
        if r["item_seq"] > start:
            later.setdefault(r["item_seq"], []).append(r)
    for item in later.values():
        known = {r["key"]: names[r["asset"]] for r in item if r["asset"] in names and r["key"] is not None}
        new = [r for r in item if r["asset"] not in seen]
        if item[0]["has_proj"]:
            names |= {r["asset"]: known.get(r["key"], f"grid-{r['asset']}") for r in new if r["key"] is not None}
        seen |= {r["asset"] for r in new}
    return pa.table([[rows[0]["collection_id"]] * len(names), list(names), list(names.values())], names=["collection_id", "asset", "grid_name"])


@dataclass
class Collections:
    """What is known of the collections of some items."""

    items: DataFrame
    assets: DataFrame
    bands: DataFrame
    aliases: DataFrame
    grids: DataFrame
    first: DataFrame
    folder: str | None = None
    kept: tuple[DataFrame, ...] = ()

    def settled(self) -> Collections:
        """The same with bands, aliases and grids, which every later plan joins, as tables in the shared folder."""
        folder = f"{shared_dir(self.items.sparkSession)}/collections-{uuid.uuid4().hex}"

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

        return Collections(self.items, self.assets, kept(self.bands, "bands"), kept(self.aliases, "aliases"), kept(self.grids, "grids"), self.first, folder, self.kept)

    def close(self) -> None:
        """Let go of what ``settled`` wrote and what plans keep."""
        for df in (*self.kept, self.items):
            df.unpersist()
        if self.folder:
            remove(self.items.sparkSession, self.folder)

    def sources(self, fail_on_error: bool = True) -> DataFrame:
        """(item_seq, collection_id, asset, idx, band_pos, uri, grid, has_proj): a source for each band of the schema that an item
        has. Within an item the assets of one grid name share the grid of the first of them. Relative hrefs are
        completed from the item's own, or fail."""
        null = F.lit(None).cast(GRID)
        made = asset_grid(F.col("proj_shape"), F.col("proj_transform"), F.col("proj_crs"))
        whole = F.col("proj_shape").isNotNull() & F.col("proj_transform").isNotNull() & F.col("proj_crs").isNotNull()
        grid = F.when(F.col("has_proj"), made if fail_on_error else F.when(whole, made)).otherwise(null)
        named = self.assets.join(self.grids, ["collection_id", "asset"], "left")
        w = W.partitionBy("item_seq", F.coalesce("grid_name", F.concat(F.lit("\0"), "asset"))).orderBy("asset_pos")
        named = named.withColumn("grid", F.first(grid, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        full = F.col("href").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)")
        base = F.regexp_extract("item_href", r"^(.*/)", 1)
        bad = F.raise_error(F.concat(F.lit("Relative href without a base: "), F.col("href"))).cast("string")
        uri = F.when(F.col("href").isNull() | (F.col("href") == "") | full, F.col("href")).when(base != "", F.concat(base, F.regexp_replace("href", r"^\./", ""))).otherwise(bad)
        return named.join(self.bands.select("collection_id", "asset", "idx", "band_pos"), ["collection_id", "asset"]).select("item_seq", "collection_id", "asset", "idx", "band_pos", uri.alias("uri"), "grid", "has_proj")


def collections_of(items: DataFrame, assets: DataFrame, config: MDConfig | dict | None = None) -> Collections:
    """Schemas of all collections of ``items`` and ``assets``. Three jobs measure what is small: the collections' first
    items, the first items of their assets, and the assets of these items."""
    config = config if isinstance(config, MDConfig) else MDConfig(config or {})
    some = candidates(assets, config).persist()
    proj = measured(projections(some, items, config))
    raster = with_projection(some, proj)
    turns = measured(first_seqs(raster))
    rows = measured(raster.join(turns, ["collection_id", "item_seq"], "left_semi"))
    first = _first(rows)
    return Collections(items, raster, bands_table(first, config), aliases_table(first, config), grids_table(rows), first, kept=(some, proj, turns, rows))


def parse_items(spark: SparkSession, docs, config: MDConfig | dict | None = None) -> Collections:
    """Items given as documents (dicts, texts) or as a table (item_seq, text), with the schemas of their collections."""
    texts = docs if isinstance(docs, DataFrame) else stac.items_from(spark, docs)
    parsed = stac.parse_documents(texts)
    return collections_of(stac.items_table(parsed), stac.assets_table(parsed), config)


def extract_collection_metadata(spark: SparkSession, doc: dict | str, config: MDConfig | dict | None = None) -> Collections:
    """The schema of a collection as one item of it tells."""
    return parse_items(spark, [doc], config)
