"""Listings, details, facets, collections, statistics."""

from pyspark.sql import functions as F

from medialens.operators import serving as v
from medialens.plans import surrogates as s
from medialens.plans.sql import GROUPS, IMG, REG, SCENE


def listed(spark, sf):
    return v.listing(s.images(spark, sf).select("image_id", "label"), s.scenes(spark, sf), ["scene.food"], groups=s.groups(spark, sf), duplicates="hide")


def unknown_label(spark, sf):
    """A label that the vocabulary does not have is no condition."""
    labels = s.scenes(spark, sf).select("label_key").distinct()
    return v.listing(s.images(spark, sf).select("image_id", "label"), s.scenes(spark, sf), ["scene.food", "scene.nowhere"], labels=labels)


def duplicates_only(spark, sf):
    return v.listing(s.images(spark, sf).select("image_id", "label"), s.scenes(spark, sf), groups=s.groups(spark, sf), duplicates="only")


def top_labels(spark, sf):
    hits = s.regions(spark, sf).groupBy("image_id", "label_key").agg(F.max("score").alias("score"))
    return v.top_labels(hits).select("image_id", F.array_join(F.transform("labels", lambda x: x["label_key"]), ",").alias("labels"))


def flags(spark, sf):
    rows = s.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), F.explode(F.array(F.when(F.col("quality") == 1, "attr.quality"), F.when(F.col("toxic") == 1, "attr.toxic"), F.lit("attr.any"))).alias("label_key"))
    return v.flags(rows.filter("label_key IS NOT NULL"), ["attr.quality", "attr.toxic"])


def detail(spark, sf):
    rows = s.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), "o_orderstatus").dropDuplicates()
    out = v.detail(rows, s.regions(spark, sf))
    return out.select("image_id", "o_orderstatus", F.coalesce(F.array_join(F.transform("regions", lambda x: F.concat_ws(":", x["idx"], F.format_string("%.2f", x["score"]))), " "), F.lit("")).alias("regions"))


def photo_statistics(spark, sf):
    d = s.table(spark, sf, "documents").join(s.table(spark, sf, "labels"), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


def category_statistics(spark, sf):
    d = s.table(spark, sf, "documents").join(s.table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.count_if(F.col("quality") == 1).alias("good"))


def review_queue(spark, sf):
    d = s.table(spark, sf, "documents").select("doc_id", "lang").join(s.table(spark, sf, "labels"), "doc_id", "left")
    return d.filter("quality IS NULL OR toxic = 1").select("doc_id", "lang", F.when(F.col("quality").isNull(), "unlabelled").otherwise("toxic").alias("reason"))


def collections(spark, sf):
    """Rule-based collections and their sizes; a collection is a predicate over images."""
    rules = {"large": "width * height >= 400000", "recent": "mtime >= 80", "small files": "size_bytes < 1500"}
    rows = s.images(spark, sf).select("image_id", F.explode(F.array(*[F.when(F.expr(rule), name) for name, rule in rules.items()])).alias("collection"))
    return rows.filter("collection IS NOT NULL").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def by_hand(spark, sf):
    """Events as additions to and removals from collections."""
    e = s.table(spark, sf, "events").select(F.col("event_type").alias("collection_id"), F.col("user_id").alias("image_id"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("action"), F.col("ts").alias("at"))
    return v.collection_sizes(v.collection_members(e))


def assigned(spark, sf):
    """image_id, facet, value: scenes, class and shape of the images."""
    i = s.images(spark, sf)
    scene = s.scenes(spark, sf).select("image_id", F.lit("scene").alias("facet"), F.substring_index("label_key", ".", -1).alias("value"))
    kind = i.select("image_id", F.lit("class").alias("facet"), F.concat(F.lit("k"), "label").alias("value"))
    shape = i.select("image_id", F.lit("shape").alias("facet"), F.when(F.col("width") > F.col("height") + 150, "wide").otherwise("square").alias("value"))
    return scene.unionByName(kind).unionByName(shape)


def event_facets(spark, sf):
    return s.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "listing_unknown_label": (unknown_label, f"WITH {IMG}, {SCENE} SELECT image_id, label FROM img WHERE image_id IN (SELECT image_id FROM sc WHERE label_key = 'scene.food')"),
    "listing_page": (lambda spark, sf: v.page(listed(spark, sf), 2, 10), f"WITH RECURSIVE {GROUPS}, {SCENE} SELECT image_id, label FROM img WHERE EXISTS (SELECT 1 FROM sc WHERE sc.image_id = img.image_id AND label_key = 'scene.food') AND image_id NOT IN (SELECT image_id FROM grp WHERE NOT is_canonical) ORDER BY image_id LIMIT 10 OFFSET 10"),
    "listing_total": (lambda spark, sf: listed(spark, sf).agg(F.count(F.lit(1)).alias("total")), f"WITH RECURSIVE {GROUPS}, {SCENE} SELECT count(*) AS total FROM img WHERE EXISTS (SELECT 1 FROM sc WHERE sc.image_id = img.image_id AND label_key = 'scene.food') AND image_id NOT IN (SELECT image_id FROM grp WHERE NOT is_canonical)"),
    "listing_duplicates_only": (duplicates_only, f"WITH RECURSIVE {GROUPS} SELECT image_id, label FROM img WHERE image_id IN (SELECT image_id FROM grp)"),
    "listing_top_labels": (top_labels, f"WITH {REG}, h AS (SELECT image_id, label_key, max(score) AS score FROM reg GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS n FROM h) SELECT image_id, string_agg(label_key, ',' ORDER BY n) AS labels FROM k WHERE n <= 4 GROUP BY image_id"),
    "attribute_flags_pivot": (flags, "SELECT doc_id AS image_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id"),
    "facet_counts": (lambda spark, sf: v.facets(s.scenes(spark, sf)), f"WITH {IMG}, {SCENE} SELECT split_part(label_key, '.', 1) AS level, label_key, count(DISTINCT image_id) AS n FROM sc GROUP BY ALL"),
    "collections_by_hand": (by_hand, "WITH l AS (SELECT event_type, user_id, arg_max(event_id % 3 = 0, struct_pack(t := ts, r := event_id % 3 = 0)) AS gone FROM events GROUP BY ALL) SELECT event_type AS collection_id, count(*) AS n FROM l WHERE NOT gone GROUP BY 1"),
    "facets_filtered": (lambda spark, sf: v.filtered_facets(assigned(spark, sf), {"scene": ["food", "people"], "shape": ["wide"], "class": []}), f"""WITH {IMG}, {SCENE}, a AS (SELECT image_id, 'scene' AS facet, split_part(label_key, '.', 2) AS value FROM sc UNION SELECT image_id, 'class', 'k' || label FROM img UNION SELECT image_id, 'shape', CASE WHEN width > height + 150 THEN 'wide' ELSE 'square' END FROM img),
p AS (SELECT image_id, bool_or(facet = 'scene' AND value IN ('food', 'people')) AS scene, bool_or(facet = 'shape' AND value = 'wide') AS shape FROM a GROUP BY image_id), k AS (SELECT facet, value, image_id, scene AND shape AS whole FROM a JOIN p USING (image_id) WHERE (scene OR facet = 'scene') AND (shape OR facet = 'shape'))
SELECT facet, value, CASE WHEN grouping(facet) = 1 THEN count(DISTINCT image_id) FILTER (whole) ELSE count(DISTINCT image_id) END AS n FROM k GROUP BY GROUPING SETS ((facet, value), (facet), ())"""),
    "event_facets": (event_facets, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "detail_nested": (detail, f"WITH {REG}, n AS (SELECT image_id, string_agg(idx || ':' || format('{{:.2f}}', score), ' ' ORDER BY idx) AS regions FROM reg GROUP BY image_id) SELECT o_orderkey AS image_id, o_orderstatus, coalesce(regions, '') AS regions FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders) LEFT JOIN n ON image_id = o_orderkey"),
    "photo_statistics": (photo_statistics, "SELECT count(*) AS total, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic, round(avg(n_chars), 4) AS avg_chars FROM documents LEFT JOIN labels USING (doc_id)"),
    "category_statistics": (category_statistics, "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS avg_chars, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"),
    "review_queue": (review_queue, "SELECT doc_id, lang, CASE WHEN quality IS NULL THEN 'unlabelled' ELSE 'toxic' END AS reason FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 1"),
    "collections": (collections, f"WITH {IMG}, c AS (SELECT unnest([CASE WHEN width * height >= 400000 THEN 'large' END, CASE WHEN mtime >= 80 THEN 'recent' END, CASE WHEN size_bytes < 1500 THEN 'small files' END]) AS collection FROM img) SELECT collection, count(*) AS n FROM c WHERE collection IS NOT NULL GROUP BY 1"),
}
