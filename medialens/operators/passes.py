"""Passes that write labels: clusters of images and regions, the object head behind its scene gate, and artifacts into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialens.operators import labeling, vector_index
from medialens.operators.clusters import cluster_centers, clusters, rolled_up
from medialens.operators.graph import stored
from medialens.operators.near_duplicates import canonical_only

#: Names of the two clusterings, and the scenes whose images are clustered.
IMAGE_METHOD, REGION_METHOD = "siglip_image_knn_v1", "siglip_region_knn_v1"
CLUSTERED_SCENES = ("scene.product", "scene.food")


def _key(method: str, cluster: Column) -> Column:
    return F.concat(F.lit(f"cluster.{method}."), cluster)


def cluster_pass(units: DataFrame, method: str, target_type: str, label_space: str, k: int = 20, threshold: float = 0.78, min_size: int = 3, recall: float = 0.95) -> dict[str, DataFrame]:
    """The tables that a clustering writes, of units (id, v of length 1): `clusters` (cluster_id, label_key, method), `members` (label_key, target_type, target_id, distance, is_center),
    `labels` (label_key, level, display_name) and `assignments` (target_type, target_id, label_key, source, label_space_ver, score, extra).

    A cluster is named by its smallest member. Neighbours are found through the index of centroids, with that recall (1: all). Regions (target_type
    region, ids `image#index`) also label their images. Fewer than min_size vectors, or no component of that size, give empty tables.
    """
    edges = vector_index.knn_edges(units, k, threshold, recall)
    members = stored(cluster_centers(clusters(units, edges, min_size), units))
    made = members.select("cluster_id").distinct()
    extra = lambda **more: F.to_json(F.struct(F.lit(method).alias("cluster_method"), *[c.alias(n) for n, c in more.items()]))
    row = lambda kind, target, about: [F.lit(kind).alias("target_type"), target.alias("target_id"), _key(method, F.col("cluster_id")).alias("label_key"), F.lit("cluster").alias("source"), F.lit(label_space).alias("label_space_ver"), F.lit(1.0).alias("score"), about.alias("extra")]
    assignments = members.select(*row(target_type, F.col("id"), extra()))
    if target_type == "region":
        assignments = assignments.unionByName(rolled_up(members).select(*row("image", F.col("image_id"), extra(from_region=F.col("from_region")))))
    return {
        "clusters": made.select("cluster_id", _key(method, F.col("cluster_id")).alias("label_key"), F.lit(method).alias("method")),
        "members": members.select(_key(method, F.col("cluster_id")).alias("label_key"), F.lit(target_type).alias("target_type"), F.col("id").alias("target_id"), "distance", "is_center"),
        "labels": made.select(_key(method, F.col("cluster_id")).alias("label_key"), F.lit("cluster").alias("level"), F.concat(F.lit(f"{method} #"), F.col("cluster_id")).alias("display_name")),
        "assignments": assignments,
    }


def image_clusters(units: DataFrame, assignments: DataFrame, groups: DataFrame, label_space: str, scenes: Sequence[str] = CLUSTERED_SCENES, **options) -> dict[str, DataFrame]:
    """cluster_pass() of the images that have one of the scenes (assignments: image_id, label_key) and are not duplicates of another (groups: image_id, is_canonical)."""
    chosen = assignments.filter(F.col("label_key").isin(*scenes)).select(F.col("image_id").alias("id")).distinct()
    once = canonical_only(units.withColumnRenamed("id", "image_id"), groups).withColumnRenamed("image_id", "id")
    return cluster_pass(once.join(chosen, "id", "left_semi"), IMAGE_METHOD, "image", label_space, **options)


def region_clusters(units: DataFrame, label_space: str, **options) -> dict[str, DataFrame]:
    """cluster_pass() of regions; their images get the labels too."""
    return cluster_pass(units, REGION_METHOD, "region", label_space, **options)


def without_method(tables: dict[str, DataFrame], method: str) -> dict[str, DataFrame]:
    """The four tables of cluster_pass() (those of many methods) without what one method has written, by the keys of its clusters."""
    gone = tables["clusters"].filter(F.col("method") == method).select("label_key").distinct()
    return {t: rows.join(gone, "label_key", "left_anti").select(*rows.columns) for t, rows in tables.items()}


def object_head(images: DataFrame, head: DataFrame, scenes: DataFrame, labels: DataFrame, allowed: Sequence[str] = (), top_k: int = 5, label_space: str = "object_v1") -> DataFrame:
    """Assignments of the learned object head: target_type, target_id, label_key, source, label_space_ver, score, extra (rank and probability).

    Only images whose best scene (scenes: image_id, label_key, score) is allowed are scored, all if none is named. Ranks count all labels of the head; those that the vocabulary (labels: label_key)
    lacks, and those under one half, are not written.
    """
    if allowed:
        fits = labeling.best_scene(scenes).filter(F.col("label_key").isin(*allowed)).select("image_id")
        images = images.join(fits, "image_id", "left_semi")
    known = labels.select("label_key").distinct()
    scored = labeling.head_objects(images, head, top_k).join(known, "label_key", "left_semi")
    extra = F.to_json(F.struct((F.col("rank") - 1).alias("head_rank"), F.col("probability").alias("head_prob")))
    return scored.select(F.lit("image").alias("target_type"), F.col("image_id").alias("target_id"), "label_key", F.lit("classifier").alias("source"), F.lit(label_space).alias("label_space_ver"), F.col("probability").alias("score"), extra.alias("extra"))


def synced(table: DataFrame, artifacts: DataFrame, artifact_type: str, fields: str, version_key: str | None = None) -> DataFrame:
    """table (image_id, the fields, updated_at) with the rows that complete artifacts of a type say anew.

    artifacts: image_id, artifact_type, version_key, status, payload (JSON with the fields), updated_at. The newest artifact of an image counts, if it is newer than the
    table's row; payloads that are no JSON object, or lack all of the fields, change nothing.
    """
    mine = artifacts.filter((F.col("artifact_type") == artifact_type) & (F.col("status") == "complete"))
    mine = mine if version_key is None else mine.filter(F.col("version_key") == version_key)
    read = mine.select("image_id", "updated_at", F.from_json("payload", fields).alias("p"))
    names = [f.name for f in read.schema["p"].dataType.fields]
    newest = read.filter(F.coalesce(*[F.col(f"p.{n}").cast("string") for n in names]).isNotNull()).groupBy("image_id").agg(F.max_by("p", "updated_at").alias("p"), F.max("updated_at").alias("since"))
    both = table.withColumn("there", F.lit(True)).join(newest, "image_id", "full")
    fresh = F.col("since").isNotNull() & (F.col("there").isNull() | (F.col("updated_at") < F.col("since")))
    return both.select("image_id", *[F.when(fresh, F.col(f"p.{n}")).otherwise(F.col(n)).alias(n) for n in names], F.when(fresh, F.col("since")).otherwise(F.col("updated_at")).alias("updated_at"))
