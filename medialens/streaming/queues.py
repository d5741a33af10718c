"""Work queues by Structured Streaming: messages in a landing folder, routed to a handler by task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = ("pre_process", "process", "post_process")
MESSAGE = "image_id string, task string"


def enqueue(images: DataFrame, landing: str, task: str = TASKS[0]) -> None:
    """One message an image, added to the landing folder."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    images.select("image_id", F.lit(task).alias("task")).write.mode("append").parquet(landing)


def run_queues(spark: SparkSession, landing: str, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, files_per_batch: int = 1000):
    """Starts a query that hands each task's messages (image_id) of a batch to its handler; stops when all is read.

    A message counts as done when its batch is: after a failure the batch runs again, so handlers must be
    idempotent, as upserts by key are. Messages of tasks without a handler stay for a query that has one.
    """
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for task, handle in handlers.items():
                mine = df.filter(F.col("task") == task).select("image_id").distinct()
                if not mine.isEmpty():
                    handle(mine, number)
        finally:
            df.unpersist()

    return stream.filter(F.col("task").isin(*handlers)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
