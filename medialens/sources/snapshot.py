"""Tables as snapshots: keyed upserts and refreshes, then an atomic switch of versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """new rows, and old ones whose key new does not have. Columns in `keep` (as created_at) stay those of the old row."""
    keys = list(keys)
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
        new = new.join(before, keys, "left").withColumns({c: F.coalesce(f"__old_{c}", c) for c in keep}).drop(*[f"__old_{c}" for c in keep])
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key old does not have."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def refresh(old: DataFrame, new: DataFrame, scope: Sequence[str], values: Sequence[tuple]) -> DataFrame:
    """Old rows outside the scope, and new ones: a pass replaces all it wrote before."""
    inside = F.lit(False)
    for row in values:
        match = F.lit(True)
        for c, v in zip(scope, row, strict=True):
            match = match & F.col(c).eqNullSafe(F.lit(v))
        inside = inside | match
    return old.filter(~inside).unionByName(new.select(*old.columns))


class SnapshotTable:
    """A Parquet table of versions. A write makes a new version and then switches the pointer to it; readers see the old
    or the new one. Meant for one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def current(self) -> str | None:
        for name in ("current.json", "next.json"):  # the second alone: a writer ended between its last two steps
            if self._fs.exists(self._at(name)):
                return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])["version"]
        return None

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{version}")
        out = self._fs.create(self._at("next.json"), True)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        self._fs.delete(self._at("current.json"), False)
        self._fs.rename(self._at("next.json"), self._at("current.json"))

    def upsert(self, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> None:
        old = self.read()
        self.write(new if old is None else upsert(old, new, keys, keep))


def without(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose keys are not among gone's."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)


def without_prefix(old: DataFrame, images: DataFrame, target: str, image: str = "image_id") -> DataFrame:
    """Old rows whose target `image#index` is no region of the images."""
    ids = images.select(F.col(image).alias("__image")).distinct()
    return old.join(ids, F.substring_index(target, "#", 1) == F.col("__image"), "left_anti")


def copy_table(source: SnapshotTable, target: SnapshotTable) -> None:
    """Dumps or restores a table: the current version of one as a new version of the other."""
    rows = source.read()
    if rows is None:
        raise FileNotFoundError(source.path)
    target.write(rows)


def create_empty(spark: SparkSession, path: str, schema: str) -> SnapshotTable:
    """A table of that schema; what is already there stays."""
    table = SnapshotTable(spark, path)
    if table.current() is None:
        table.write(spark.createDataFrame([], schema))
    return table
