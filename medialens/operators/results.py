"""Payloads, exports and small rules around regions, artifacts and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.frames import small_side
from medialens.functions.geometry import area, box
from medialens.functions.metrics import route
from medialens.functions.vectors import l2_normalize
from medialens.operators import regions as reg


def region_payloads(regions: DataFrame) -> DataFrame:
    """image_id, payload: the regions of each image as JSON, in order of index."""
    item = F.struct("idx", F.struct("x_min", "y_min", "x_max", "y_max").alias("bbox"), F.col("label_key").alias("detector_label"), F.col("score").alias("detector_score"))
    return regions.groupBy("image_id").agg(F.to_json(F.struct("image_id", F.sort_array(F.collect_list(item)).alias("detections"))).alias("payload"))


def replace_by_image(old: DataFrame, new: DataFrame, images: DataFrame) -> DataFrame:
    """old without all rows of the images, and new ones."""
    return old.join(images.select("image_id"), "image_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def postprocess(detections: DataFrame, iou: float = 0.8, score_min: float = 0.25, max_regions: int = 10, min_priority: float = 0.03, min_relative: float = 0.3) -> DataFrame:
    """Detections of images as regions: weak ones go, overlapping ones go, and the rest are ordered and pruned by priority."""
    kept = reg.non_max_suppression(detections.filter(F.col("score") >= score_min), iou)
    return reg.pruned(reg.with_priority(kept), max_regions, min_priority, min_relative)


def cluster_candidates(regions: DataFrame, score_min: float = 0.4, low: float = 0.05, high: float = 0.6) -> DataFrame:
    """Regions that are worth clustering: sure ones of middling area."""
    return regions.filter((F.col("score") > score_min) & area(box()).between(low, high))


def type_scores(scores: DataFrame, types: DataFrame) -> DataFrame:
    """image_id, scene_type, p: the best probability of the label keys of each type; `other` is there with 0 at least."""
    best = scores.join(small_side(types), "label_key").groupBy("image_id", "scene_type").agg(F.max("p").alias("p"))
    other = scores.select("image_id").distinct().withColumns({"scene_type": F.lit("other"), "p": F.lit(0.0)})
    return best.unionByName(other).groupBy("image_id", "scene_type").agg(F.max("p").alias("p"))


def scene_margins(scores: DataFrame) -> DataFrame:
    """image_id, scene_type, p, margin: each type against the best of the others; negative where another is better."""
    w = Window.partitionBy("image_id")
    top = scores.withColumns({"a": F.max("p").over(w), "n": F.row_number().over(w.orderBy(F.desc("p"), "scene_type"))}).withColumn("second", F.coalesce(F.max(F.when(F.col("n") == 2, F.col("p"))).over(w), F.lit(0.0)))
    return top.select("image_id", "scene_type", "p", (F.col("p") - F.when(F.col("n") == 1, F.col("second")).otherwise(F.col("a"))).alias("margin"))


def grown_prototype(proto: Column, n: Column, mean: Column, m: Column) -> Column:
    """A prototype of n samples after m more of that mean, normalized."""
    return l2_normalize(F.zip_with(proto, mean, lambda a, b: (a * n + b * m) / (n + m)))


def annotation_stats(annotations: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(total, correct and accuracy; the most frequent corrections) of reviewed predictions (predicted, actual)."""
    right = F.col("predicted") == F.col("actual")
    totals = annotations.agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"), F.avg(right.cast("int")).alias("accuracy"))
    fixes = annotations.filter(~right).groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicted", "actual").limit(top)
    return totals, fixes


def suggestions(recent: DataFrame, similar: DataFrame) -> DataFrame:
    """image_id, label_key, confidence: the recent label at 0.7 and the labels of two similar images at 0.6, the surer of equals."""
    near = similar.withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("similarity"), "label_key"))).filter("n <= 2")
    both = recent.select("image_id", "label_key", F.lit(0.7).alias("confidence")).union(near.select("image_id", "label_key", F.lit(0.6)))
    return both.groupBy("image_id", "label_key").agg(F.max("confidence").alias("confidence"))


# Which label of a step leads to which next set of labels, and above what confidence (null: any).
STEPS = (("Electronics", "electronics", 0.5), ("Food", "food", 0.5), ("Smartphone", "specific_products", None), ("Laptop", "specific_products", None), ("Tablet", "specific_products", None))


def hierarchical_classes(scores: DataFrame, first: str = "general", steps=STEPS, depth: int = 3) -> DataFrame:
    """image_id, level1, confidence1, ... of scores (image_id, label_set, label_key, p): the best label of the first set, then
    that of the set which it leads to. One aggregation: the best label of every set, then a choice among them."""
    best = scores.groupBy("image_id", "label_set").agg(F.max_by(F.struct("label_key", "p"), F.struct("p", "label_key")).alias("best"))
    row = best.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("label_set", "best"))).alias("sets"))
    for n in range(1, depth + 1):
        if n == 1:
            of = F.lit(first)
        else:
            label, p = F.col(f"level{n - 1}"), F.col(f"confidence{n - 1}")
            fits = [F.when((label == parent) & (F.lit(True) if above is None else p > above), F.lit(following)) for parent, following, above in steps]
            of = F.coalesce(*fits)
        row = row.withColumn("__hit", F.try_element_at("sets", of)).withColumns({f"level{n}": F.col("__hit")["label_key"], f"confidence{n}": F.col("__hit")["p"]})
    return row.drop("sets", "__hit")


def batch_applied(verified: DataFrame, similar: DataFrame, confidence: float = 0.95) -> DataFrame:
    """image_id, label_key, confidence, action of images similar (image_id, similar_id) to those with a label that people confirmed."""
    both = verified.filter("human_verified").select("image_id", "label_key").join(similar, "image_id")
    return both.select(F.col("similar_id").alias("image_id"), "label_key", F.lit(confidence).alias("confidence"), F.lit("batch_applied").alias("action")).distinct()


def correction_alerts(annotations: DataFrame, at_least: int = 5) -> DataFrame:
    """predicted, actual, n of the corrections that were made so often that training again is worth it."""
    fixes = annotations.filter(F.col("predicted") != F.col("actual")).groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))
    return fixes.filter(F.col("n") >= at_least)


# Keys and messages of the annotation screen by kind of confidence.
ACTIONS = {"auto": ("Space:Confirm", "X:Skip", "E:Edit"), "suggest": ("1-4:Choose suggestion", "T:Enter custom label", "X:Skip"), "manual": ("1-9:Use quick label", "T:Enter label", "X:Mark unknown")}


def annotation_payloads(predictions: DataFrame, suggested: DataFrame, similar: DataFrame) -> DataFrame:
    """image_id, level, suggestions, actions, message, similar_count for an annotation screen.

    predictions: image_id, label_key, confidence; suggested: image_id, label_key, confidence (suggestions()); similar: image_id,
    similar_id. Only unsure predictions come with suggestions: the label itself and the best three others.
    """
    ranked = suggested.withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("confidence"), "label_key"))).filter("n <= 3")
    three = ranked.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("n", "label_key"))).alias("three"))
    counts = similar.groupBy("image_id").agg(F.count_distinct("similar_id").alias("similar_count"))
    both = predictions.join(three, "image_id", "left").join(counts, "image_id", "left").withColumn("level", route(F.col("confidence")))
    others = F.coalesce(F.transform("three", lambda s: s["label_key"]), F.array().cast("array<string>"))
    by_level = lambda values: F.coalesce(*[F.when(F.col("level") == k, v) for k, v in values.items()])
    return both.select(
        "image_id",
        "level",
        F.when(F.col("level") == "suggest", F.concat(F.array("label_key"), others)).otherwise(F.array().cast("array<string>")).alias("suggestions"),
        by_level({k: F.array(*[F.lit(x) for x in v]) for k, v in ACTIONS.items()}).alias("actions"),
        by_level({"auto": F.concat(F.lit("AI is confident this is: "), "label_key"), "suggest": F.lit("AI is unsure. Please confirm or adjust."), "manual": F.lit("AI cannot classify this image. Manual input required.")}).alias("message"),
        F.coalesce("similar_count", F.lit(0)).alias("similar_count"),
    )


def registered_prototypes(registry: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """label_key, category, samples, accuracy, created_at of a registry of prototypes, without the removed ones (label_key). Saving
    and loading is a SnapshotTable's work."""
    left = registry if removed is None else registry.join(removed.select("label_key"), "label_key", "left_anti")
    return left.select("label_key", "category", "samples", "accuracy", "created_at")


def flat_classes(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, label_key, confidence, alternatives (the next three), threshold_met, needs_review."""
    ranked = scores.withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("p"), "label_key"))).filter("n <= 4")
    out = ranked.groupBy("image_id").agg(F.max(F.when(F.col("n") == 1, F.col("label_key"))).alias("label_key"), F.max("p").alias("confidence"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "label_key")))).alias("x"))
    sure = F.col("confidence") >= threshold
    return out.select("image_id", "label_key", "confidence", F.transform("x", lambda s: s["label_key"]).alias("alternatives"), sure.alias("threshold_met"), (~sure).alias("needs_review"))


def thumbnail_size(width: Column, height: Column, side: int) -> tuple[Column, Column]:
    """Width and height of an image fitted into a square, 1 at least; small images stay."""
    k = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    fit = lambda n: F.greatest(F.lit(1), F.bround(n * k, 0).cast("int"))
    return fit(width), fit(height)


def current_artifacts(artifacts: DataFrame, images: DataFrame, artifact_type: str, version_key: str) -> DataFrame:
    """image_id, storage_path of active images that have a complete artifact of just that version."""
    good = artifacts.filter((F.col("artifact_type") == artifact_type) & (F.col("version_key") == version_key) & (F.col("status") == "complete"))
    return images.filter("status = 'active'").select("image_id").join(good.select("image_id", "storage_path"), "image_id")


def screenshot_score(*parts: tuple[Column, float]) -> Column:
    """Weighted sum of features in [0, 1], within [0, 1]."""
    total = F.lit(0.0)
    for feature, weight in parts:
        total = total + F.coalesce(feature.cast("double"), F.lit(0.0)) * weight
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def wants_ocr(rows: DataFrame) -> DataFrame:
    """Images worth reading: with text, documents or screenshots."""
    return rows.filter("has_text OR is_document OR is_screenshot")


def export_paths(images: DataFrame, path: str, form: str = "text") -> None:
    """Writes primary paths as lines of text or of JSON."""
    rows = images.select("primary_path")
    (rows.write.mode("overwrite").text(path) if form == "text" else rows.write.mode("overwrite").json(path))
