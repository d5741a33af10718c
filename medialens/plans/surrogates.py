"""Media tables as views of the test tables: images from embeddings, regions from lineitem, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialens.functions.frames import dealt
from medialens.functions.hashing import perceptual_bits
from medialens.operators import labeling
from medialens.operators.near_duplicates import duplicate_groups, group_edges, hamming_pairs

#: Thresholds at which the test tables have something to find.
HAMMING, COSINE, NEIGHBOURS, MIN_CLUSTER = 18, 0.40, 20, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, vec_id, label, v, mtime, width, height, size_bytes."""
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("%016x", n).alias("image_id"),
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("v"),
        (n % 97).alias("mtime"),
        (640 + 10 * (n % 13)).alias("width"),
        (480 + 10 * F.col("label")).cast("bigint").alias("height"),
        (1000 + (n * 7919) % 5000).alias("size_bytes"),
    )


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).withColumn("bits", perceptual_bits(F.col("v"))).drop("v")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_pairs(hashed(spark, sf_dir), HAMMING)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    return duplicate_groups(rows, group_edges(rows, HAMMING))


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_key, proto: one prototype for each class."""
    rows = images(spark, sf_dir).select(F.concat(F.lit("object.k"), "label").alias("label_key"), "v")
    return labeling.prototypes(rows, "label_key")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label_key, score: two scene assignments an image, from its class and the next one."""
    keys = F.array(*[F.lit(f"scene.{s}") for s in (*labeling.SCENES, "other")])
    n = F.col("vec_id")
    first = F.struct(F.get(keys, F.col("label")).alias("label_key"), (((n * 37) % 101) / 100).alias("score"))
    second = F.struct(F.get(keys, (F.col("label") + 1) % 9).alias("label_key"), (((n * 53) % 101) / 100).alias("score"))
    return images(spark, sf_dir).select("image_id", F.explode(F.array(first, second)).alias("a")).select("image_id", "a.*").groupBy("image_id", "label_key").agg(F.max("score").alias("score"))


def regions(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """image_id, idx, box, score, label_key of detected regions, dealt by image; without idx as they stand in the table if not `numbered`."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    x, y = 5 * F.col("l_discount"), 5 * F.col("l_tax")
    lines = table(spark, sf_dir, "lineitem")
    return (dealt(lines, "l_orderkey") if numbered else lines).select(
        F.col("l_orderkey").alias("image_id"),
        *([(F.row_number().over(order) - 1).alias("idx")] if numbered else []),
        x.alias("x_min"),
        y.alias("y_min"),
        F.least(F.lit(1.0), x + 0.1 + F.col("l_quantity") / 100).alias("x_max"),
        F.least(F.lit(1.0), y + 0.1 + (F.col("l_partkey") % 50) / 100).alias("y_max"),
        ((F.col("l_suppkey") % 100) / 100).alias("score"),
        F.concat(F.lit("object.p"), F.col("l_partkey") % 7).alias("label_key"),
    )
