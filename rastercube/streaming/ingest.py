"""Items as a stream: documents dropped into a folder, parsed as they come, counted by collection and solar day.

A solar day is a day of time shifted by longitude, so it is a tumbling window over that time. Documents that come later
than the watermark after the newest one are dropped from the counts, as in any window on event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import solar_time
from ..sources.stac import items_table, parse_documents


def stream_documents(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(item_seq, text) of JSON documents, one a line, that appear in a folder. There is no order in a stream: item_seq is
    a hash of the document, equal for equal documents."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    return lines.select(F.xxhash64("value").alias("item_seq"), F.col("value").alias("text"))


def stream_items(documents: DataFrame, late: str = "2 days") -> DataFrame:
    """Parsed items with ``solar`` time, each once within the time that late documents are waited for."""
    items = items_table(parse_documents(documents)).where("ts IS NOT NULL")
    items = items.withColumn("solar", solar_time("ts", "lon")).withWatermark("solar", late)
    return items.dropDuplicatesWithinWatermark(["id", "collection_id"])


def solar_days(items: DataFrame) -> DataFrame:
    """Items by collection and solar day."""
    day = F.window("solar", "1 day")
    return items.groupBy("collection_id", day).agg(F.count("*").alias("n_items")).select("collection_id", F.col("window.start").cast("date").alias("day"), "n_items")
