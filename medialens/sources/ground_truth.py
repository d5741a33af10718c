"""Readers of ground truth and teacher annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUND_TRUTH = "image_id string, scene array<string>, attributes map<string,boolean>, objects array<string>"
ANNOTATION = (
    "image_id string, annotation struct<scene:string,has_person:boolean,has_text:boolean,has_animal:boolean,is_document:boolean,is_screenshot:boolean,"
    "objects:array<struct<name_free:string,coarse_type:string,is_main:boolean,confidence:double>>>"
)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file (one object or an array) or of JSON lines; blank and broken lines are left out."""
    lines = spark.read.schema(GROUND_TRUTH + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    # a schema of all fields and the broken line, so that Spark lets the line be asked for alone
    good = lines.filter("image_id IS NOT NULL AND _broken IS NULL").drop("_broken")
    if not good.isEmpty():
        return good
    return spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path).filter("image_id IS NOT NULL")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).option("mode", "DROPMALFORMED").json(path).filter("annotation IS NOT NULL")


def unprocessed(work: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows that a resumed run still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def first_wins(df: DataFrame, key: str, *order) -> DataFrame:
    """One row for each key, the first in the given order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")
