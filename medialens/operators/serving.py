"""Serving: listings, details, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.frames import SMALL, ship
from medialens.functions.geometry import box, priority
from medialens.functions.text import basename
from medialens.operators.graph import top_per
from medialens.operators.ingest import with_gps

MAX_PAGE = 64


def listing(images: DataFrame, assignments: DataFrame, label_keys: Sequence[str] = (), region_hits: DataFrame | None = None, groups: DataFrame | None = None, duplicates: str = "any", labels: DataFrame | None = None) -> DataFrame:
    """Images that have all of the labels; with `labels` (label_key), those that it does not have are no condition. duplicates: `any`, `hide` (no non-canonical members) or `only` (members of groups).

    Each condition is a semi or anti join on the image, so none multiplies rows and none needs ids on the driver.
    """
    out = images
    if labels is not None:  # at most as many rows as keys were asked for
        known = {r[0] for r in labels.select("label_key").filter(F.col("label_key").isin(*label_keys)).distinct().collect()}
        label_keys = [k for k in label_keys if k in known]
    for key in label_keys:
        out = out.join(assignments.filter(F.col("label_key") == key).select("image_id").distinct(), "image_id", "left_semi")
    if region_hits is not None:
        out = out.join(region_hits.select("image_id").distinct(), "image_id", "left_semi")
    if groups is not None and duplicates == "hide":
        out = out.join(groups.filter(~F.col("is_canonical")).select("image_id"), "image_id", "left_anti")
    if groups is not None and duplicates == "only":
        out = out.join(groups.select("image_id"), "image_id", "left_semi")
    return out


def page(rows: DataFrame, number: int = 1, size: int = 24, key: str = "image_id") -> DataFrame:
    size = max(1, min(MAX_PAGE, size))
    return rows.orderBy(key).offset((max(1, number) - 1) * size).limit(size)


def top_labels(assignments: DataFrame, n: int = 4) -> DataFrame:
    """image_id, labels: the n best scored labels of each image, best first."""
    best = top_per(assignments, ["image_id"], [F.desc("score"), "label_key"], n, "rank")
    return best.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label_key", "score"))).alias("x")).select("image_id", F.transform("x", lambda s: F.struct(s["label_key"].alias("label_key"), s["score"].alias("score"))).alias("labels"))


def flags(assignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """image_id and a flag for each key."""
    return assignments.groupBy("image_id").agg(*[F.coalesce(F.bool_or(F.col("label_key") == k), F.lit(False)).alias(k.rpartition(".")[2]) for k in keys])


def facets(assignments: DataFrame) -> DataFrame:
    """level, label_key, n: images by label; the level is the key's first segment."""
    return assignments.groupBy(F.substring_index("label_key", ".", 1).alias("level"), "label_key").agg(F.count_distinct("image_id").alias("n"))


def filtered_facets(assignments: DataFrame, filters: dict[str, Sequence[str]]) -> DataFrame:
    """facet, value, n: images by value of each facet among those that pass the filters of all other facets; with a null value, images that have any value of the
    facet; with a null facet too, images that pass all filters.

    assignments: image_id, facet, value. A filter asks for one of its values; one without values asks nothing. A filter of a facet or value that
    no image has leaves the other facets empty. One pass: a bitmap tells for each image which filters it passes, and a value counts if no bit but its own facet's is missing.
    Rows with a null in them do not count, repeated ones count once.
    """
    asked = {facet: list(values) for facet, values in filters.items() if values}
    have = assignments.dropna(subset=["image_id", "facet", "value"]).groupBy("image_id").agg(F.array_sort(F.collect_set(F.struct("facet", "value"))).alias("have"))
    bit = {facet: 1 << k for k, facet in enumerate(asked)}
    passes = lambda facet: F.when(F.exists("have", lambda h: (h["facet"] == facet) & h["value"].isin(asked[facet])), bit[facet]).otherwise(0)
    passed = sum((passes(facet) for facet in asked), F.lit(0)).cast("bigint")
    rows = have.select(passed.alias("passed"), F.posexplode("have").alias("i", "h"), "have")
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for facet in asked for x in (facet, bit[facet])]), F.col("h.facet")), F.lit(0)) if asked else F.lit(0)
    every = sum(bit.values())
    first = (F.col("i") == 0) | (F.get("have", F.col("i") - 1)["facet"] != F.col("h.facet"))
    kept = rows.filter(F.col("passed").bitwiseOR(own) == every).select("h.facet", "h.value", first.cast("int").alias("of_facet"), ((F.col("i") == 0) & (F.col("passed") == every)).cast("int").alias("whole"))
    level = F.grouping_id()
    n = F.when(level == 0, F.count(F.lit(1))).when(level == 1, F.sum("of_facet")).otherwise(F.sum("whole"))
    return kept.rollup("facet", "value").agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))


def collection_members(changes: DataFrame) -> DataFrame:
    """collection_id, image_id of collections that are kept by hand: changes (collection_id, image_id, action add or remove, at) in order of time, a removal after an addition of
    the same time. Repeated changes change nothing; nulls and other actions do not count."""
    known = changes.filter("collection_id IS NOT NULL AND image_id IS NOT NULL AND at IS NOT NULL").filter(F.col("action").isin("add", "remove"))
    last = known.groupBy("collection_id", "image_id").agg(F.max(F.struct("at", "action")).alias("last"))
    return last.filter("last.action = 'add'").select("collection_id", "image_id")


def collection_sizes(members: DataFrame) -> DataFrame:
    """collection_id, n: the counters of collections, from their members."""
    return members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))


def detail(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Images with their regions nested, in order of index."""
    nested = regions.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "score", "x_min", "y_min", "x_max", "y_max"))).alias("regions"))
    return images.join(nested, "image_id", "left")


#: Attributes that a page shows as flags, and how many objects and clusters of an image.
SHOWN_FLAGS, SHOWN_OBJECTS, SHOWN_CLUSTERS = ("has_text", "has_person", "is_screenshot", "is_document"), 4, 3


def _scene(best: Column) -> Column:
    """The short name of a scene's key."""
    return F.when(best.startswith("scene."), F.substring(best, 7, 100)).otherwise(best)


def _entries(rows: DataFrame, level: str, order: list[Column], fields: Sequence[str], limit: int | None, name: str, key: str = "image_id") -> DataFrame:
    """key, `name`: the labels of one level as an ordered array of structs, `limit` at most."""
    mine = rows.filter(F.col("level") == level)
    ranked = mine.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    ranked = ranked if limit is None else ranked.filter(F.col("n") <= limit)
    packed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", *fields))).alias("x"))
    return packed.select(key, F.transform("x", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def _labelled(images: DataFrame, assignments: DataFrame) -> DataFrame:
    """image_id with its scene (best score, then key), whether it has each shown attribute, and nothing else."""
    scene = assignments.filter("level = 'scene'").groupBy("image_id").agg(F.min_by("label_key", F.struct(-F.coalesce("score", F.lit(0.0)), F.col("label_key"))).alias("scene_key"), F.max(F.coalesce("score", F.lit(0.0))).alias("scene_confidence"))
    flagged = assignments.filter("level = 'attribute'").groupBy("image_id").agg(*[F.bool_or(F.col("label_key") == f"attr.{a}").alias(a) for a in SHOWN_FLAGS])
    joined = images.select("image_id").join(scene, "image_id", "left").join(flagged, "image_id", "left")
    return joined.select("image_id", _scene(F.col("scene_key")).alias("scene_type"), "scene_confidence", *[F.coalesce(a, F.lit(False)).alias(a) for a in SHOWN_FLAGS])


def enriched_page(page_rows: DataFrame, assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of a page with scene_type, the shown flags, is_duplicate, and their best objects (display_name, score, source) and clusters (display_name, score).

    page_rows: image_id, one page (64 rows at most). assignments: image_id, label_key, level, display_name, score, source. pairs: anchor_id, duplicate_id. The page is
    broadcast to both, so nothing but its rows is shuffled. An image without labels has a null scene, no flags and empty arrays.
    """
    ids = F.broadcast(page_rows.select("image_id"))
    mine = assignments.join(ids, "image_id", "left_semi")
    best = [F.desc(F.coalesce("score", F.lit(0.0))), F.col("label_key")]
    objects = _entries(mine, "object", best, ["display_name", "score", "source"], SHOWN_OBJECTS, "objects")
    found = _entries(mine, "cluster", best, ["display_name", "score"], SHOWN_CLUSTERS, "clusters")
    ends = pairs.select(F.explode(F.array("anchor_id", "duplicate_id")).alias("image_id"))
    doubled = ends.join(ids, "image_id", "left_semi").distinct().withColumn("is_duplicate", F.lit(True))
    out = page_rows.join(_labelled(page_rows, mine).drop("scene_confidence"), "image_id", "left").join(doubled, "image_id", "left").join(objects, "image_id", "left").join(found, "image_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({"is_duplicate": F.coalesce("is_duplicate", F.lit(False)), "objects": empty("objects"), "clusters": empty("clusters")})


def image_details(wanted: DataFrame, images: DataFrame, assignments: DataFrame, captions: DataFrame, pairs: DataFrame, regions: DataFrame, region_labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """Everything around each wanted image (image_id) in one nested row; ids that images does not have give none.

    images: image_id, primary_path, status, gps_latitude, gps_longitude and what else shall be shown. assignments: image_id, label_key, level, display_name, score, source,
    created_at. captions: image_id, caption, model_name (the first model by name counts). pairs: anchor_id, duplicate_id, distance. regions: image_id, idx,
    box, score, raw_label, detector. region_labels: image_id, idx, level, display_name, label_key, score. metadata: image_id, payload (JSON), where coordinates that images lacks are taken from.

    Adds logical_name, scene (type, confidence and flags; null without a scene), object_labels by score, cluster_labels with the newest first, caption and caption_model,
    near_duplicates (each other image once, by its smaller distance, as anchor if equal; by distance, then id), and regions in order of index with their priority and labels.
    Up to SMALL wanted ids are broadcast; all else meets by sorted shuffles, so nothing that grows with the tables passes through the driver.
    """
    ids = wanted.select("image_id").distinct()
    ids = F.broadcast(ids) if ids.limit(SMALL + 1).count() <= SMALL else ids.hint("merge")
    # a hint holds for the first join above it; without one Spark broadcasts pairs, of which it can't know how many a tile hands on
    mine = lambda df: df.join(ids, "image_id", "left_semi").hint("merge")
    rows, labels = with_gps(mine(images), mine(metadata)), mine(assignments)
    about = _labelled(rows, labels)
    scene = about.select("image_id", F.when(F.col("scene_type").isNotNull(), F.struct("scene_type", "scene_confidence", *SHOWN_FLAGS)).alias("scene"))
    best = [F.desc(F.coalesce("score", F.lit(0.0))), F.col("label_key")]
    objects = _entries(labels, "object", best, ["display_name", "label_key", "score", "source"], None, "object_labels")
    found = _entries(labels, "cluster", [F.desc("created_at"), F.col("label_key")], ["display_name", "label_key", "score", "source"], None, "cluster_labels")
    said = mine(captions).groupBy("image_id").agg(F.min(F.struct("model_name", "caption")).alias("c")).select("image_id", F.col("c.caption").alias("caption"), F.col("c.model_name").alias("caption_model"))
    way = lambda a, b, role: F.struct(F.col(a).alias("image_id"), F.col(b).alias("other_id"), "distance", F.lit(role).alias("role"))
    sides = mine(pairs.select(F.inline(F.array(way("anchor_id", "duplicate_id", "anchor"), way("duplicate_id", "anchor_id", "duplicate")))))
    others = sides.join(images.select(F.col("image_id").alias("other_id"), "status", "primary_path"), "other_id")
    # dealt by image once, for both groupings
    others = others.repartition("image_id").groupBy("image_id", "other_id", "status", "primary_path").agg(F.min(F.struct("distance", "role")).alias("p"))
    near = others.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("p.distance").alias("distance"), "other_id", F.col("p.role").alias("role"), "status", "primary_path"))).alias("near_duplicates"))
    marks = mine(region_labels).withColumn("region", F.struct("image_id", "idx"))
    told = [_entries(marks, level, best, ["display_name", "score"], None, name, "region") for level, name in (("object", "object_labels"), ("cluster", "cluster_labels"))]
    ship(regions.sparkSession)
    boxes = mine(regions).withColumns({"region": F.struct("image_id", "idx"), "priority": priority(box(), F.col("score"))}).join(told[0], "region", "left").join(told[1], "region", "left")
    boxes = boxes.withColumn("raw_label", F.coalesce("raw_label", F.lit("(raw)")))
    nested = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x_min", "y_min", "x_max", "y_max", "raw_label", "score", "detector", "priority", *[F.coalesce(c, F.array().cast(boxes.schema[c].dataType)).alias(c) for c in ("object_labels", "cluster_labels")]))).alias("regions"))
    out = rows.withColumn("logical_name", basename(F.col("primary_path")))
    for part in (scene, objects, found, said, near, nested):
        out = out.join(part.hint("merge"), "image_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("object_labels", "cluster_labels", "near_duplicates", "regions")})


def thumbnails(images: DataFrame, artifacts: DataFrame, version_key: str, variant: str = "large") -> DataFrame:
    """image_id, path: of each active image its complete thumbnail of that version, else the original. Variants other than `small` are large."""
    kind = "thumbnail_small" if variant == "small" else "thumbnail_large"
    made = artifacts.filter((F.col("artifact_type") == kind) & (F.col("version_key") == version_key) & (F.col("status") == "complete")).groupBy("image_id").agg(F.min("storage_path").alias("made"))
    return images.filter("status = 'active'").select("image_id", "primary_path").join(made, "image_id", "left").select("image_id", F.coalesce("made", "primary_path").alias("path"))
