"""Streaming ingest: arrivals in a landing folder, upserted exactly once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.operators.near_duplicates import incremental_pairs
from medialens.sources.snapshot import SnapshotTable

ARRIVAL = "image_id string, bits bigint, mtime double, size_bytes long"


def arrivals(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(landing)


def ingest(spark: SparkSession, landing: str, images_path: str, pairs_path: str, checkpoint: str, distance: int = 12):
    """Starts a query that upserts arrivals and brings the pairs of near duplicates up to date; stops when all is read.

    A batch may run again after a failure: upserts by key and the recomputed pairs of its images give the same tables.
    """
    images, pairs = SnapshotTable(spark, images_path), SnapshotTable(spark, pairs_path)

    def batch(df: DataFrame, _: int) -> None:
        new = df.groupBy("image_id").agg(F.max_by(F.struct("bits", "mtime", "size_bytes"), F.struct("mtime", "size_bytes")).alias("x")).select("image_id", "x.*")
        images.upsert(new, ["image_id"])
        now = images.read()
        old = pairs.read()
        if old is None:
            old = spark.createDataFrame([], "anchor_id string, duplicate_id string, distance int")
        pairs.write(incremental_pairs(old, now, new, distance))

    return arrivals(spark, landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """start, event_type, n, total by tumbling windows of event time; for streams with a watermark."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
