"""File sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".webp", ".gif")
WIDE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff")


def scan_roots(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """path, size_bytes, mtime (epoch seconds) of all image files below the roots, found recursively.

    The content column is pruned, so files are listed but not read. Roots that do not exist are left out.
    """
    glob = "*{" + ",".join("." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s[1:]) for s in suffixes) + "}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [r for r in roots if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "path string, size_bytes long, mtime double")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(there)
    return files.select("path", F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"))


def stored_paths(images: DataFrame, paths: str = "all_paths") -> DataFrame:
    """path, image_id from a JSON array of paths; unreadable JSON has none."""
    return images.select("image_id", F.explode(F.from_json(F.col(paths), "array<string>")).alias("path"))
