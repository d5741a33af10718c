"""Sinks: append-only results, vectors, JSON, resumable annotations; and readers of captions and heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.functions.text import basename, stripped

HEAD = "label_key string, weights array<double>, bias double"


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Adds rows to a Parquet table of results; what is there is never changed."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_missing(df: DataFrame, path: str, key: str = "image_id") -> None:
    """Adds to a folder of JSON lines those rows whose key it does not have, so an interrupted run can go on."""
    append_json(without_written(df, path, key), path)


def without_written(df: DataFrame, path: str, key: str = "image_id") -> DataFrame:
    """Rows whose key is not among the JSON lines of a folder; all, where there is none."""
    try:
        done = df.sparkSession.read.schema(f"{key} {df.schema[key].dataType.simpleString()}").json(path)
    except AnalysisException:
        return df
    return df.join(done.filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*df.columns)


def append_json(df: DataFrame, path: str) -> None:
    """Adds rows as JSON lines, as error reports are kept."""
    df.write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str, key: str = "image_id", vector: str = "embedding") -> None:
    """Vectors as Parquet: key, vector (floats) and embedding_dim beside it."""
    rows = df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias(vector), F.size(vector).alias("embedding_dim"))
    rows.write.mode("overwrite").parquet(path)


def read_captions(spark: SparkSession, folder: str, ending: str = ".txt") -> DataFrame:
    """image_id (the file's name without its ending), caption of the caption files below a folder, without white space around.
    Files without a byte, which Spark's readers pass over, give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(folder)
    name = basename(F.col("path"))
    return files.select(F.substring(name, F.lit(1), F.length(name) - len(ending)).alias("image_id"), stripped(F.col("content").cast("string")).alias("caption"))


def read_head(spark: SparkSession, path: str) -> DataFrame | None:
    """label_key, weights, bias of a linear head in Parquet; None if it is missing or no head: rows without weights, or of
    different sizes."""
    try:
        rows = spark.read.parquet(path)
        head = rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in HEAD.split(", ")])
    except AnalysisException:
        return None
    n, least, most, empty = head.agg(F.count(F.lit(1)), F.min(F.size("weights")), F.max(F.size("weights")), F.count_if(F.expr("label_key IS NULL OR weights IS NULL OR bias IS NULL"))).first()
    return head if n and least == most and least > 0 and not empty else None


#: Tables that each stage fills, for clearing them by name.
STAGE_TABLES = {
    "preprocess": ("artifacts",),
    "embeddings_and_captions": ("embeddings", "captions"),
    "scene_classification": ("scenes",),
    "region_detection": ("regions", "region_embeddings"),
    "duplicates": ("near_duplicates", "duplicate_groups"),
    "labels": ("label_assignments",),
}


def cleared(stages: Sequence[str]) -> list[str]:
    """Tables of the named stages (`all`: of every one), in order; an unknown name is an error."""
    if "all" in stages:
        stages = list(STAGE_TABLES)
    if lost := [s for s in stages if s not in STAGE_TABLES]:
        raise ValueError(f"unknown stages: {', '.join(lost)}")
    return list(dict.fromkeys(t for s in stages for t in STAGE_TABLES[s]))


def clear_stages(spark: SparkSession, root: str, stages: Sequence[str]) -> list[str]:
    """Deletes the tables of the named stages below a root; returns those that were there."""
    jvm, gone = spark.sparkContext._jvm, []
    for table in cleared(stages):
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{table}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True):
            gone.append(table)
    return gone
