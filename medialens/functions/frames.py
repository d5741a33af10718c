"""Sizes of tables, checked before they are broadcast; the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to so many rows are broadcast; larger ones shuffle.
SMALL = 20_000
#: Rows that dealt() gives a task; a sort and a hash table of so many fit into some hundred MB.
DEALT = 500_000


def small_side(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df, to be broadcast if it is found to have at most `limit` rows; the count stops one row beyond it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in partitions whose number grows with its rows, so that what a task sorts or gathers does not. Spark's own number of
    shuffle partitions is kept where it does, as these can be coalesced."""
    tasks = -(-df.count() // DEALT)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_medialens_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="medialens-")) / "medialens_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "medialens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    context._medialens_shipped = True
