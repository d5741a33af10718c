"""Regions of images."""

from pyspark.sql import functions as F

from medialens.functions.geometry import box, pixel_box
from medialens.operators import regions as g
from medialens.plans import surrogates as s
from medialens.plans.sql import PRIO, REG


def r(c):
    return F.round(c, 6)


def overlaps(spark, sf):
    return g.iou_pairs(s.regions(spark, sf), 0.3).withColumn("iou", r(F.col("iou")))


def priorities(spark, sf):
    return g.with_priority(s.regions(spark, sf)).select("image_id", "idx", r(F.col("priority")).alias("priority"), "rank")


def pruned(spark, sf):
    return g.pruned(g.with_priority(s.regions(spark, sf)), 5, 0.1, 0.5).select("image_id", "idx", "position")


def suppressed(spark, sf):
    return g.non_max_suppression(s.regions(spark, sf), 0.5).select("image_id", "idx", "score")


def crops(spark, sf):
    x0, y0, x1, y1 = pixel_box(box(), F.lit(640), F.lit(480))
    return s.regions(spark, sf).select("image_id", "idx", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).filter("x1 > x0 AND y1 > y0")


def fallback(spark, sf):
    docs = s.table(spark, sf, "documents")
    captions = docs.select(F.col("doc_id").alias("image_id"), F.col("text").alias("caption"))
    keywords = spark.createDataFrame([(1, "license", "object.document"), (2, "stupid", "object.food"), (3, "the", "object.other")], "ord int, keyword string, label string")
    none = spark.createDataFrame([], "image_id long, idx int, x_min double, y_min double, x_max double, y_max double, score double, priority double")
    return g.with_caption_fallback(none, captions, keywords, 0.1).select("image_id", "idx", "x_min", "y_min", "x_max", "y_max", "score", "raw_label")


IOU = "greatest(0.0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0.0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min))"
AREA = "greatest(0.0, (a.x_max - a.x_min) * (a.y_max - a.y_min)) + greatest(0.0, (b.x_max - b.x_min) * (b.y_max - b.y_min))"
QUERIES = {
    "iou_pairs": (overlaps, f"WITH {REG}, p AS (SELECT a.image_id, a.idx AS a, b.idx AS b, {IOU} AS i, {AREA} AS s FROM reg a JOIN reg b ON a.image_id = b.image_id AND a.idx < b.idx) SELECT image_id, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0 AND s - i > 0 AND i / (s - i) >= 0.3"),
    "region_priority": (priorities, f"WITH {PRIO} SELECT image_id, idx, round(priority, 6) AS priority, rank FROM ranked"),
    "prune_secondary_regions": (pruned, f"WITH {PRIO}, f AS (SELECT *, max(priority) FILTER (rank = 0) OVER (PARTITION BY image_id) AS p0 FROM ranked), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY rank) AS INTEGER) AS position FROM f WHERE rank = 0 OR (priority >= 0.1 AND (p0 <= 0 OR priority / p0 >= 0.5))) SELECT image_id, idx, position FROM k WHERE position <= 5"),
    "nms_regions": (
        suppressed,
        f"WITH RECURSIVE {REG}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, idx) AS n FROM reg), bad AS (SELECT b.image_id, b.n AS late, a.n AS early FROM o a JOIN o b ON a.image_id = b.image_id AND a.n < b.n WHERE {IOU} > 0 AND {IOU} >= 0.5 * ({AREA} - {IOU})), "
        "step AS (SELECT image_id, CAST(1 AS BIGINT) AS n, [CAST(1 AS BIGINT)] AS kept FROM o WHERE n = 1 UNION ALL SELECT s.image_id, s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.image_id = s.image_id AND bad.late = s.n + 1 AND list_contains(s.kept, bad.early)) THEN s.kept ELSE list_append(s.kept, s.n + 1) END FROM step s JOIN o ON o.image_id = s.image_id AND o.n = s.n + 1), "
        "last AS (SELECT image_id, arg_max(kept, n) AS kept FROM step GROUP BY image_id) SELECT o.image_id, idx, score FROM o JOIN last USING (image_id) WHERE list_contains(kept, n)",
    ),
    "crop_boxes": (crops, f"WITH {REG}, p AS (SELECT image_id, idx, CAST(least(640, greatest(0, round_even(x_min * 640, 0))) AS INTEGER) AS x0, CAST(least(480, greatest(0, round_even(y_min * 480, 0))) AS INTEGER) AS y0, CAST(least(640, greatest(0, round_even(x_max * 640, 0))) AS INTEGER) AS x1, CAST(least(480, greatest(0, round_even(y_max * 480, 0))) AS INTEGER) AS y1 FROM reg) SELECT * FROM p WHERE x1 > x0 AND y1 > y0"),
    "caption_fallback": (fallback, "SELECT doc_id AS image_id, -1 AS idx, CAST(0.1 AS DOUBLE) AS x_min, CAST(0.1 AS DOUBLE) AS y_min, CAST(0.9 AS DOUBLE) AS x_max, CAST(0.9 AS DOUBLE) AS y_max, CAST(0.5 AS DOUBLE) AS score, CASE WHEN contains(lower(text), 'license') THEN 'object.document' WHEN contains(lower(text), 'stupid') THEN 'object.food' ELSE 'object.other' END AS raw_label FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'stupid') OR contains(lower(text), 'the')"),
}
