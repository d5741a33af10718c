"""Graph operators over edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Graphs up to so many distinct edges are joined by one task.
SMALL_GRAPH = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may go without it and gets a temporary folder; elsewhere
    a folder of one machine would lose its files with that machine, so that is an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="medialens-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, deleted when the application ends. Unlike a checkpoint it
    has true sizes, so that plans of many rounds are estimated rightly, and joins on it shuffle (and split) it anew."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/medialens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """node, component (its smallest node) of all nodes of undirected edges; edges with a null end are left out.

    Up to `small` distinct edges one task joins them. Beyond, the edges are rewritten into stars by turns: first all
    larger neighbours of a node, then all smaller ones, are linked to the smallest node around it. Rounds grow with the
    logarithm of the longest chain; a hub's edges meet its minimum in a join that Spark can split.
    """
    ends = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).filter("p IS NOT NULL AND q IS NOT NULL")
    links = stored(ends.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
    if links.limit(small + 1).count() <= small:
        kind = links.schema["u"].dataType.simpleString()
        return links.coalesce(1).mapInArrow(_joined_in_one_task, f"node {kind}, component {kind}")
    loops = links.filter("u = v").select("u")
    stars, before = links.filter("u <> v"), None
    while True:
        both = stars.select("u", "v").union(stars.select("v", "u"))
        lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        larger = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(larger.filter("u <> v").distinct())
        lowest = stored(stars.groupBy("u").agg(F.min("v").alias("m")))
        smaller = stars.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        stars = stored(smaller.filter("u <> v").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    known = labels.union(roots)
    alone = loops.join(known, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stored(known.union(alone))


def _joined_in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of a bounded number of edges (u, v)."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    u, v = (pa.chunked_array([b.column(i) for b in table]) for i in (0, 1))
    nodes = pc.unique(pa.chunked_array([*u.chunks, *v.chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    root = list(range(len(nodes)))
    for x, y in zip(pc.index_in(u, nodes).to_pylist(), pc.index_in(v, nodes).to_pylist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for i, r in enumerate(root):  # a root is never larger than its node, so it is settled before
        root[i] = root[r]
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root, pa.int64()))], names=["node", "component"])


def closure(edges: DataFrame, child: str, parent: str, max_depth: int = 64) -> DataFrame:
    """node, ancestor, depth of an acyclic child -> parent table; the shortest depth of each pair."""
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).filter("ancestor IS NOT NULL")
    out = step
    for depth in range(2, max_depth + 1):
        step = checkpointed(step.join(edges.select(F.col(child).alias("ancestor"), F.col(parent).alias("next")).filter("next IS NOT NULL"), "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(depth).alias("depth")).distinct())
        if step.isEmpty():
            break
        out = out.union(step)
    return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def top_per(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark limits groups before the shuffle too."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)
