"""Connected components that are kept between batches of changes.

New edges merge the components at their ends; removed nodes and edges may split theirs. A batch computes anew only the components that its
nodes belong to, from their own edges, and appends the result: edges by component, labels by node, and the components that they
replace. Reading takes the last word on each. Edges and labels lie in buckets, so a batch reads the buckets of what it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.operators.graph import connected_components, stored
from medialens.sources.snapshot import SnapshotTable

BUCKETS = 64


class KeptComponents:
    """Edges, labels and replaced components below a folder that driver and executors share. Meant for one writer; a batch counts once the table of batches
    names it, so a writer that is lost leaves everything as it was."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), kind, buckets
        self.batches = SnapshotTable(spark, f"{self.path}/batches")
        self._schemas = {"edges": f"component {kind}, a {kind}, b {kind}", "labels": f"node {kind}, component {kind}", "replaced": f"component {kind}"}

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _names(self) -> list[str]:
        rows = self.batches.read()
        return [] if rows is None else [r.batch for r in rows.orderBy("batch").collect()]

    def _append(self, what: str, batch: str, rows: DataFrame, by: str) -> None:
        rows.withColumn("bucket", self._bucket(F.col(by))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{what}/batch={batch}")

    def _read(self, what: str, buckets: list[int] | None = None) -> DataFrame:
        """All rows with their batch, of those buckets."""
        names = self._names()
        schema = f"{self._schemas[what]}, batch string, bucket int"
        if not names:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/batch={n}" for n in names])
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _buckets_of(self, keys: DataFrame, key: str) -> list[int]:
        return [r.k for r in keys.select(self._bucket(F.col(key)).alias("k")).distinct().collect()]

    def labels(self, nodes: DataFrame | None = None) -> DataFrame:
        """node, component (its smallest node) of all nodes, or of those in nodes (node)."""
        rows = self._read("labels", None if nodes is None else self._buckets_of(nodes, "node"))
        rows = rows if nodes is None else rows.join(nodes, "node", "left_semi")
        return rows.groupBy("node").agg(F.max_by("component", "batch").alias("component")).filter("component IS NOT NULL")

    def edges_of(self, components: DataFrame) -> DataFrame:
        """a, b of the present edges of those components (component, distinct)."""
        buckets = self._buckets_of(components, "component")
        last = self._read("replaced", buckets).groupBy("component").agg(F.max("batch").alias("since"))
        rows = self._read("edges", buckets).join(components, "component", "left_semi").join(last, "component", "left")
        return rows.filter("since IS NULL OR batch >= since").select("a", "b")

    def apply(self, added: DataFrame | None = None, removed_nodes: DataFrame | None = None, removed_edges: DataFrame | None = None) -> int:
        """Adds edges (a, b) and takes away nodes (node) with all their edges, and edges (a, b), added ones included. Returns how many components it computed anew.

        Edges have no direction; repeated edges and ones that are there already change nothing, nor do unknown nodes or edges among the removed. Edges
        with a null end are left out. A node without edges has no component.
        """
        none = self.spark.createDataFrame([], f"a {self.kind}, b {self.kind}")
        pairs = lambda df: none if df is None else df.select(F.least("a", "b").cast(self.kind).alias("a"), F.greatest("a", "b").cast(self.kind).alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("whole")).filter("whole").drop("whole").distinct()
        new, gone = stored(pairs(added)), stored(pairs(removed_edges))
        lost = stored((none.select(F.col("a").alias("node")) if removed_nodes is None else removed_nodes.select(F.col("node").cast(self.kind).alias("node"))).filter("node IS NOT NULL").distinct())
        ends = lambda df: df.select(F.col("a").alias("node")).union(df.select("b"))
        touched = stored(self.labels(stored(ends(new).union(ends(gone)).union(lost).distinct())).select("component").distinct())
        old = stored(self.edges_of(touched))
        left = old.union(new).distinct().join(gone, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(lost.withColumnRenamed("node", end), end, "left_anti").select("a", "b")
        left = stored(left)
        labels = stored(connected_components(left).select(F.col("node").cast(self.kind).alias("node"), F.col("component").cast(self.kind).alias("component")))
        single = ends(old).distinct().join(labels, "node", "left_anti").select("node", F.lit(None).cast(self.kind).alias("component"))
        names = self._names()
        batch = f"{len(names):08d}-{uuid.uuid4().hex[:8]}"
        self._append("edges", batch, left.join(labels, left["a"] == labels["node"]).select("component", "a", "b"), "component")
        self._append("labels", batch, labels.union(single), "node")
        self._append("replaced", batch, touched, "component")
        self.batches.write(self.spark.createDataFrame([(n,) for n in [*names, batch]], "batch string"))
        return touched.count()
