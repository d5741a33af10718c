"""Ingest: content identity, paths, soft deletion; artifacts and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE = "hash IS NULL OR hash_algo IS NULL OR hash_algo <> '{algo}' OR width IS NULL OR height IS NULL OR exif_datetime IS NULL OR camera_model IS NULL"


def merge_scan(images: DataFrame, scan: DataFrame) -> DataFrame:
    """The image table after a full scan: image_id, primary_path, all_paths, size_bytes, mtime, status, dirty.

    images has those columns; scan has path, image_id (content hash), size_bytes, mtime. A path belongs to the hash it was
    scanned with. Kept paths stay in their order, new ones follow in path order; the primary path stays as long as it is
    there, else the first one takes its place. Images without paths become `deleted` (and keep their other
    columns); found again they are `active`. Seen images take the scan's size and time of their last path; new, changed and
    revived ones are dirty.
    """
    seen = scan.groupBy("image_id").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.max_by("size_bytes", "path").alias("new_size"), F.max_by("mtime", "path").alias("new_mtime"))
    both = images.join(seen, "image_id", "full_outer")
    old = F.coalesce("all_paths", F.array().cast("array<string>"))
    new = F.coalesce("paths", F.array().cast("array<string>"))
    kept = F.filter(old, lambda p: F.array_contains(new, p))
    paths = F.array_union(kept, new)
    primary = F.when(F.array_contains(paths, F.col("primary_path")), F.col("primary_path")).otherwise(F.coalesce(F.get(paths, F.lit(0)), F.lit("")))
    gone = F.size(paths) == 0
    changed = F.col("primary_path").isNull() | (F.col("status") != "active") | ~F.col("new_size").eqNullSafe(F.col("size_bytes")) | ~F.col("new_mtime").eqNullSafe(F.col("mtime"))
    return both.select(
        "image_id",
        primary.alias("primary_path"),
        paths.alias("all_paths"),
        F.coalesce("new_size", "size_bytes").alias("size_bytes"),
        F.coalesce("new_mtime", "mtime").alias("mtime"),
        F.when(gone, "deleted").otherwise("active").alias("status"),
        F.when(gone, F.coalesce("dirty", F.lit(False))).otherwise(F.coalesce("dirty", F.lit(False)) | changed).alias("dirty"),
    )


def merge_queued(images: DataFrame, scan: DataFrame) -> DataFrame:
    """The image table after some files were queued: columns as in merge_scan().

    Unlike a full scan, files that are not listed stay. A path leaves the image that it had before if it now has other
    content; an image whose last path leaves becomes `deleted` with an empty primary path. Seen images take size and time of
    their last path and are `active` again if they were deleted; `dirty` is left to the caller.
    """
    old = images.select("image_id", F.posexplode("all_paths").alias("at", "path"))
    now = scan.select("path", F.col("image_id").alias("now_id"))
    stays = old.join(now, "path", "left").filter("now_id IS NULL OR now_id = image_id").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("at", "path"))).alias("kept"))
    seen = scan.groupBy("image_id").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.max_by("size_bytes", "path").alias("new_size"), F.max_by("mtime", "path").alias("new_mtime"))
    both = images.join(stays, "image_id", "left").join(seen, "image_id", "full_outer")
    none = F.array().cast("array<string>")
    paths = F.array_union(F.coalesce(F.transform("kept", lambda k: k["path"]), none), F.coalesce("paths", none))
    primary = F.when(F.array_contains(paths, F.col("primary_path")), F.col("primary_path")).otherwise(F.coalesce(F.get(paths, F.lit(0)), F.lit("")))
    found = F.col("paths").isNotNull()
    return both.select(
        "image_id",
        primary.alias("primary_path"),
        paths.alias("all_paths"),
        F.coalesce("new_size", "size_bytes").alias("size_bytes"),
        F.coalesce("new_mtime", "mtime").alias("mtime"),
        F.when(F.size(paths) == 0, "deleted").when(found & (F.coalesce("status", F.lit("deleted")) == "deleted"), "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("dirty", F.lit(False)).alias("dirty"),
    )


def with_gps(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """images with gps_latitude and gps_longitude taken from the metadata artifact (image_id, payload: JSON) where they are
    null. Only numbers count; a broken payload gives nothing."""
    gps = F.from_json("payload", "gps struct<latitude:double,longitude:double>")["gps"]
    found = metadata.select("image_id", gps["latitude"].alias("__lat"), gps["longitude"].alias("__lon"))
    both = images.join(found, "image_id", "left")
    return both.withColumns({"gps_latitude": F.coalesce("gps_latitude", "__lat"), "gps_longitude": F.coalesce("gps_longitude", "__lon")}).select(*images.columns)


def embedding_size(meta: Column, vector: Column) -> Column:
    """The size that an embedding's metadata (JSON) state: a number, cut to a whole one, or a text of digits; else the vector's length."""
    raw = F.get_json_object(meta, "$.embedding_dim")
    quoted = meta.rlike(r'"embedding_dim"\s*:\s*"')
    stated = F.when(quoted, F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))).otherwise(raw.try_cast("double").try_cast("int"))
    return F.coalesce(stated, F.size(vector))


def exact_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """content_hash, first (smallest key), n of the contents of rows; memberships follow by the hash."""
    return rows.groupBy(F.md5(content).alias("content_hash")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))


def stale_hashes(images: DataFrame, algo: str) -> DataFrame:
    """Active images whose perceptual hash is missing, of another algorithm, or without the image's size, time taken or camera."""
    return images.filter("status = 'active'").filter(STALE.format(algo=algo))


def patch(images: DataFrame, found: DataFrame, columns: list[str], key: str = "image_id") -> DataFrame:
    """images with those columns set anew where found has a value."""
    new = found.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return images.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*images.columns)


def missing_artifacts(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows of wanted (image_id, artifact_type, version_key) of which no complete artifact exists."""
    done = artifacts.filter("status = 'complete'").select("image_id", "artifact_type", "version_key")
    return wanted.join(done, ["image_id", "artifact_type", "version_key"], "left_anti")


def stages_to_run(stages: list[str], done: str | None, cursor: str | None) -> list[str]:
    """What a resumed run has left: the stage that was interrupted and all later ones; all for an unknown stage."""
    if done not in stages:
        return list(stages)
    return stages[stages.index(done) + (cursor is None) :]


def after_cursor(df: DataFrame, key: str, cursor: str | None) -> DataFrame:
    return df if cursor is None else df.filter(F.col(key) > F.lit(cursor))
