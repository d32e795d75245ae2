"""What must not grow with a collection: the part of its rows that one task gets."""

import os

import pytest
from pyspark.sql import functions as F

from rastercube import catalog
from rastercube.operators import infer, temporal
from rastercube.sources import stac
from rastercube.sources.stac import item_document

DATA = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_a_collection_is_not_one_task(spark):
    """Schemas are joined to the rows of a large collection where these are."""
    docs = [item_document(f"i{k}", "2020-01-01T00:00:00Z", collection="c", assets={"a": {"href": f"http://h/{k}.tif", "type": "image/tiff"}}) for k in range(400)]
    parsed = stac.parse_documents(stac.items_from(spark, docs))
    found = infer.collections_of(stac.items_table(parsed), stac.assets_table(parsed))
    assert found.assets.count() == 400 and tasks(found.assets) > 1
    assert [(r.asset, r.item_seq) for r in found.first.collect()] == [("a", 0)]
    found.close()


def test_items_without_assets(spark):
    """The first item counts even if it has no asset, and an item without assets makes no row."""
    shaped = {"href": "http://h/s.tif", "type": "image/tiff", "proj:epsg": 32632, "proj:shape": [2, 2], "proj:transform": [1, 0, 0, 0, -1, 0]}
    each = [("c", {}), ("c", {"s": shaped, "t": {"href": "http://h/t.tif", "type": "image/tiff"}}), ("d", {"s": shaped}), ("d", {"t": {"href": "http://h/t.tif", "type": "image/tiff"}})]
    docs = [item_document(f"i{k}", "2020-01-01T00:00:00Z", collection=c, assets=a) for k, (c, a) in enumerate(each)]
    parsed = stac.parse_documents(stac.items_from(spark, docs))
    found = infer.collections_of(stac.items_table(parsed), stac.assets_table(parsed))
    assert sorted((r.item_seq, r.asset, r.has_proj) for r in found.assets.collect()) == [(1, "s", False), (1, "t", False), (2, "s", True)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_documents_are_dealt_before_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(catalog, "DOCUMENTS", 50, raising=False)
    a = stac.assets_table(stac.parse_documents(catalog.documents(spark, DATA)))
    assert tasks(a) > 1
    assert "Filter (size(" not in a._jdf.queryExecution().executedPlan().toString()  # no parse below the deal


def test_ranks_come_of_one_sort(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = [r.t_idx for r in temporal.ranked(spark.range(100_000).select(F.hash("id").alias("k"), "id"), F.col("k"), F.col("id")).select("t_idx").collect()]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted(got) == list(range(100_000))
