"""Detected regions: suppression, order, pruning, caption fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.frames import ship, small_side
from medialens.functions.geometry import box, fallback_box, iou, priority


def iou_pairs(regions: DataFrame, threshold: float) -> DataFrame:
    """image_id, a, b (indexes, a < b), iou of overlapping boxes of one image."""
    l, r = regions.alias("l"), regions.alias("r")
    value = iou(tuple(F.col(f"l.{c}") for c in ("x_min", "y_min", "x_max", "y_max")), tuple(F.col(f"r.{c}") for c in ("x_min", "y_min", "x_max", "y_max")))
    both = l.join(r, (F.col("l.image_id") == F.col("r.image_id")) & (F.col("l.idx") < F.col("r.idx")))
    return both.select(F.col("l.image_id").alias("image_id"), F.col("l.idx").alias("a"), F.col("r.idx").alias("b"), value.alias("iou")).filter(F.col("iou") >= threshold)


def non_max_suppression(regions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The regions that stay when, by falling score (then index), each box drops later ones that overlap it by the threshold.

    Greedy and whatever the class. A threshold of 0 or less keeps all. The boxes of an image are one array (a detector gives
    it at most some hundred), over which the greedy pass folds; nothing leaves the JVM.
    """
    if threshold <= 0:
        return regions
    corners = ("x_min", "y_min", "x_max", "y_max")
    groups = regions.groupBy("image_id").agg(F.collect_list(F.struct(*regions.columns)).alias("__all"))
    # rows may hold types without an order, so only their keys and places are sorted
    key = lambda s, i: F.struct(F.coalesce(-s["score"].cast("double"), F.lit(float("inf"))).alias("down"), s["idx"].alias("idx"), *[s[c].alias(c) for c in corners], i.alias("i"))
    ordered = F.transform(F.sort_array(F.transform("__all", key)), lambda k: F.get(F.col("__all"), k["i"]))
    groups = groups.select(F.when(F.size("__all") == 1, F.col("__all")).otherwise(_kept(ordered, threshold)).alias("__kept"))
    return groups.select(F.inline("__kept"))


def _kept(rows: Column, threshold: float) -> Column:
    """Fold over an ordered array of boxes: those that none of the kept ones before them overlaps so much."""

    def drops(a: Column, b: Column) -> Column:
        corners = ("x_min", "y_min", "x_max", "y_max")
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = ([s[c].cast("double") for c in corners] for s in (a, b))
        none = F.lit(0.0)
        both = F.greatest(none, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(none, F.least(ay1, by1) - F.greatest(ay0, by0))
        union = F.greatest(none, (ax1 - ax0) * (ay1 - ay0)) + F.greatest(none, (bx1 - bx0) * (by1 - by0)) - both
        return F.coalesce((both > 0) & (union > 0) & (both >= threshold * union), F.lit(False))

    return F.aggregate(rows, F.slice(rows, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda a: drops(a, b)), kept).otherwise(F.concat(kept, F.array(b))))


def with_priority(regions: DataFrame, gamma: float = 0.3, center_penalty: float = 0.6) -> DataFrame:
    """regions with priority and its rank in the image, from 0; ties by index."""
    ship(regions.sparkSession)
    scored = regions.withColumn("priority", priority(box(), F.col("score"), gamma, center_penalty))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("priority"), "idx")) - 1)


def pruned(ranked: DataFrame, max_regions: int = 10, min_priority: float = 0.03, min_relative: float = 0.3) -> DataFrame:
    """The first region of each image and those others whose priority, itself and against the first's, is high enough; at
    most max_regions. Nothing for max_regions of 0 or less."""
    if max_regions <= 0:
        return ranked.filter("false")
    w = Window.partitionBy("image_id")
    first = F.max(F.when(F.col("rank") == 0, F.col("priority"))).over(w)
    top = F.col("__first")
    ok = (F.col("rank") == 0) | ((F.col("priority") >= min_priority) & F.when(top > 0, F.col("priority") / top >= min_relative).otherwise(True))
    kept = ranked.withColumn("__first", first).filter(ok).drop("__first")
    return kept.withColumn("position", F.row_number().over(w.orderBy("rank"))).filter(F.col("position") <= max_regions)


def caption_labels(captions: DataFrame, keywords: DataFrame) -> DataFrame:
    """image_id, label of the first keyword group (lowest ord) that a caption holds. keywords: ord, keyword, label."""
    hit = captions.join(small_side(keywords), F.contains(F.lower("caption"), F.lower("keyword")))
    return hit.groupBy("image_id").agg(F.min_by("label", F.struct("ord", "keyword")).alias("label"))


def with_caption_fallback(regions: DataFrame, captions: DataFrame, keywords: DataFrame, min_priority: float, margin: tuple[float, float] = (0.1, 0.1)) -> DataFrame:
    """regions (with priority), and for images without any above min_priority one made from the caption, index -1."""
    good = regions.filter(F.col("priority") >= min_priority).select("image_id").distinct()
    x0, y0, x1, y1 = fallback_box(*margin)
    made = caption_labels(captions, keywords).join(good, "image_id", "left_anti")
    made = made.select("image_id", F.lit(-1).alias("idx"), x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"), F.lit(0.5).alias("score"), F.col("label").alias("raw_label"))
    return regions.unionByName(made, allowMissingColumns=True)
