"""Pages and details with everything around an image, and the passes that write cluster and head labels."""

from pyspark.sql import functions as F

from medialens.functions.vectors import l2_normalize
from medialens.operators import clusters as c
from medialens.operators import passes
from medialens.operators import serving as v
from medialens.operators.near_duplicates import hamming_pairs
from medialens.plans import surrogates as s
from medialens.plans.sql import GROUPS, IMG, PAIRS, PROTO, REG, SCENE


def assignments(spark, sf):
    """image_id, label_key, level, display_name, score, source, created_at of all levels."""
    i, n = s.images(spark, sf), F.col("vec_id")
    row = lambda key, level, shown, score, source, at: F.struct(key.alias("label_key"), F.lit(level).alias("level"), shown.alias("display_name"), score.cast("double").alias("score"), source.alias("source"), at.cast("bigint").alias("created_at"))
    scene = s.scenes(spark, sf).select("image_id", row(F.col("label_key"), "scene", F.col("label_key"), F.col("score"), F.lit("classifier"), F.lit(0)).alias("a"))
    attribute = [F.when(n % k == 0, row(F.lit(f"attr.{a}"), "attribute", F.lit(f"attr.{a}"), F.lit(1.0), F.lit("classifier"), F.lit(0))) for a, k in (("has_text", 2), ("has_person", 5))]
    kind = lambda j: ((F.col("label") + j) % 10).cast("string")
    objects = [row(F.concat(F.lit("object.k"), kind(j)), "object", F.concat(F.lit("K"), kind(j)), (n * (j + 3)) % 89 / 89, F.lit("zero_shot" if j % 2 else "aggregated"), F.lit(0)) for j in range(6)]
    found = [row(F.concat(F.lit("cluster.m."), (n + j) % 7), "cluster", F.concat(F.lit("m #"), (n + j) % 7), (n + 5 * j) % 10 / 10, F.lit("cluster"), (n * (j + 1)) % 13) for j in range(5)]
    rest = i.select("image_id", F.explode(F.array(*attribute, *objects, *found)).alias("a")).filter("a IS NOT NULL")
    return scene.unionByName(rest).select("image_id", "a.*")


ASSIGNED = f"""{SCENE}, asg AS (SELECT image_id, label_key, 'scene' AS level, label_key AS display_name, score, 'classifier' AS source, 0 AS created_at FROM sc
UNION ALL SELECT image_id, 'attr.has_text', 'attribute', 'attr.has_text', 1.0, 'classifier', 0 FROM img WHERE vec_id % 2 = 0 UNION ALL SELECT image_id, 'attr.has_person', 'attribute', 'attr.has_person', 1.0, 'classifier', 0 FROM img WHERE vec_id % 5 = 0
UNION ALL SELECT image_id, 'object.k' || ((label + j) % 10), 'object', 'K' || ((label + j) % 10), ((vec_id * (j + 3)) % 89) / 89, CASE WHEN j % 2 = 1 THEN 'zero_shot' ELSE 'aggregated' END, 0 FROM img, range(0, 6) t(j)
UNION ALL SELECT image_id, 'cluster.m.' || ((vec_id + j) % 7), 'cluster', 'm #' || ((vec_id + j) % 7), ((vec_id + 5 * j) % 10) / 10, 'cluster', (vec_id * (j + 1)) % 13 FROM img, range(0, 5) t(j)),
best AS (SELECT image_id, label_key, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS k FROM asg WHERE level = 'scene') WHERE k = 1),
obj AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS k FROM asg WHERE level = 'object'),
cl AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS k, row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC, label_key) AS age FROM asg WHERE level = 'cluster')"""


def told(array, *fields):
    """An array of structs as text."""
    parts = lambda x: F.concat_ws(":", *[F.format_string("%.4f", x[f]) if f in ("score", "priority") else x[f].cast("string") for f in fields])
    return F.array_join(F.transform(array, parts), " ")


def page(spark, sf):
    rows = v.page(s.images(spark, sf).select("image_id", "label"), 2, 24)
    near = hamming_pairs(s.hashed(spark, sf), s.HAMMING, delta=rows)  # of all pairs those that touch the page
    out = v.enriched_page(rows, assignments(spark, sf), near)
    return out.withColumns({"objects": told("objects", "display_name", "score", "source"), "clusters": told("clusters", "display_name", "score")})


def details(spark, sf):
    i, n = s.images(spark, sf), F.col("vec_id")
    images = i.select("image_id", F.concat(F.lit("/photos/"), n, F.lit(".jpg")).alias("primary_path"), F.lit("active").alias("status"), "width", F.when(n % 4 == 0, (n % 80).cast("double")).alias("gps_latitude"), F.when(n % 4 == 0, (n % 170).cast("double")).alias("gps_longitude"))
    metadata = i.filter("vec_id % 2 = 0").select("image_id", F.to_json(F.struct(F.struct((-(n % 50)).alias("latitude"), (-(n % 60)).alias("longitude")).alias("gps"))).alias("payload"))
    d = s.table(spark, sf, "documents").select(F.format_string("%016x", "doc_id").alias("image_id"), "doc_id", F.md5("text").alias("caption"))
    captions = d.select("image_id", "caption", F.lit("blip").alias("model_name")).unionByName(d.filter("doc_id % 3 = 0").select("image_id", F.concat(F.lit("alt "), "caption").alias("caption"), F.lit("alt").alias("model_name")))
    r = s.regions(spark, sf).withColumn("image_id", F.format_string("%016x", "image_id"))
    regions = r.select("image_id", "idx", "x_min", "y_min", "x_max", "y_max", "score", F.when(F.col("idx") > 0, F.col("label_key")).alias("raw_label"), F.lit("owlvit").alias("detector"))
    labels = r.select("image_id", "idx", F.lit("object").alias("level"), F.upper("label_key").alias("display_name"), "label_key", "score")
    out = v.image_details(i, images, assignments(spark, sf), captions, s.pairs(spark, sf), regions, labels, metadata)
    shown = {"scene": F.concat_ws(":", F.col("scene.scene_type"), F.format_string("%.2f", "scene.scene_confidence"), F.col("scene.has_text").cast("string"), F.col("scene.has_person").cast("string"))}
    shown |= {"object_labels": told("object_labels", "display_name", "label_key", "score", "source"), "cluster_labels": told("cluster_labels", "display_name", "score"), "near_duplicates": told("near_duplicates", "other_id", "distance", "role", "primary_path")}
    regions_told = F.array_join(F.transform("regions", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["raw_label"], F.format_string("%.4f", x["priority"]), told(x["object_labels"], "display_name"))), " ")
    return out.withColumns(shown | {"regions": regions_told}).select("image_id", "logical_name", "gps_latitude", "gps_longitude", "caption", "caption_model", *shown, "regions")


def product_clusters(spark, sf):
    units = c.unit_vectors(s.images(spark, sf), "image_id", "v")
    made = passes.image_clusters(units, s.scenes(spark, sf), s.groups(spark, sf), "cluster_v1", k=s.NEIGHBOURS, threshold=s.COSINE, min_size=s.MIN_CLUSTER, recall=1.0)
    rows = made["members"].join(made["labels"], "label_key")
    return rows.select("label_key", "display_name", "target_id", "is_center", F.round("distance", 6).alias("distance"))


def region_labels(spark, sf):
    """Vectors as regions, three of an image."""
    n = F.col("vec_id")
    rows = s.images(spark, sf).select(F.concat(F.format_string("%016x", F.floor(n / 3)), F.lit("#"), n % 3).alias("id"), "v")
    made = passes.region_clusters(c.unit_vectors(rows, "id", "v"), "cluster_v1", k=s.NEIGHBOURS, threshold=s.COSINE, min_size=s.MIN_CLUSTER, recall=1.0)
    return made["assignments"].select("target_type", "target_id", "label_key", F.coalesce(F.get_json_object("extra", "$.from_region"), F.lit("")).alias("from_region"))


def head_labels(spark, sf):
    rows = s.images(spark, sf).select("image_id", l2_normalize(F.col("v")).alias("v"))
    head = s.prototypes(spark, sf).select("label_key", F.col("proto").alias("weights"), F.lit(0.05).alias("bias"))
    out = passes.object_head(rows, head, s.scenes(spark, sf), head.select("label_key").filter("label_key <> 'object.k3'"), ["scene.food", "scene.people"], 3)
    return out.select("target_id", "label_key", F.round("score", 6).alias("score"), F.get_json_object("extra", "$.head_rank").cast("int").alias("head_rank"))


def thumbnails(spark, sf):
    i, n = s.images(spark, sf), F.col("vec_id")
    images = i.select("image_id", F.when(n % 5 == 0, "deleted").otherwise("active").alias("status"), F.concat(F.lit("/p/"), n).alias("primary_path"))
    made = i.select("image_id", F.lit("thumbnail_small").alias("artifact_type"), F.when(n % 2 == 0, "pil:1").otherwise("pil:0").alias("version_key"), F.when(n % 3 == 0, "error").otherwise("complete").alias("status"), F.concat(F.lit("/t/"), n).alias("storage_path"))
    return v.thumbnails(images, made, "pil:1", "small")


def synced(spark, sf):
    i, n = s.images(spark, sf), F.col("vec_id")
    table = i.filter("vec_id % 3 > 0").select("image_id", F.lit("old").alias("caption"), (n % 5).alias("size"), F.lit(10).cast("bigint").alias("updated_at"))
    payload = F.when(n % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("new "), n).alias("caption"), (n % 9).alias("size"))))
    made = i.filter("vec_id % 2 = 0").select("image_id", F.lit("caption").alias("artifact_type"), F.lit("blip:1").alias("version_key"), F.when(n % 4 == 0, "complete").otherwise("error").alias("status"), payload.alias("payload"), (n % 20).alias("updated_at"))
    return passes.synced(table, made, "caption", "caption string, size bigint", "blip:1")


def _clustered(units):
    """SQL of clusters on units (id, u): sims, neighbours, components, centers."""
    return f"""unit2 AS ({units}), sims2 AS (SELECT a.id AS src, b.id AS dst, list_inner_product(a.u, b.u) AS similarity FROM unit2 a JOIN unit2 b ON a.id <> b.id),
knn2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS n FROM sims2 WHERE similarity >= {s.COSINE}) WHERE n <= {s.NEIGHBOURS}),
und2 AS (SELECT src AS a, dst AS b FROM knn2 UNION SELECT dst, src FROM knn2), reach2 AS (SELECT a AS node, a AS other FROM und2 UNION SELECT r.node, x.b FROM reach2 r JOIN und2 x ON r.other = x.a),
comp2 AS (SELECT node, min(other) AS cluster_id FROM reach2 GROUP BY node), clu2 AS (SELECT cluster_id, node AS id, u FROM comp2 JOIN unit2 ON id = node WHERE cluster_id IN (SELECT cluster_id FROM comp2 GROUP BY cluster_id HAVING count(*) >= {s.MIN_CLUSTER})),
near2 AS (SELECT a.cluster_id, a.id, round(sum(list_inner_product(a.u, b.u)), 9) AS total FROM clu2 a JOIN clu2 b USING (cluster_id) GROUP BY ALL), mid2 AS (SELECT cluster_id, id AS center FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, id) AS n FROM near2) WHERE n = 1)"""


UNIT2 = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM img"
QUERIES = {
    "listing_enriched": (page, f"""WITH {PAIRS}, {ASSIGNED}, pg AS (SELECT image_id, label FROM img ORDER BY image_id LIMIT 24 OFFSET 24)
SELECT pg.image_id, label, split_part(best.label_key, '.', 2) AS scene_type, coalesce((SELECT bool_or(label_key = 'attr.has_text') FROM asg WHERE asg.image_id = pg.image_id), false) AS has_text, coalesce((SELECT bool_or(label_key = 'attr.has_person') FROM asg WHERE asg.image_id = pg.image_id), false) AS has_person, false AS is_screenshot, false AS is_document,
pg.image_id IN (SELECT anchor_id FROM pairs UNION SELECT duplicate_id FROM pairs) AS is_duplicate, (SELECT string_agg(display_name || ':' || format('{{:.4f}}', score) || ':' || source, ' ' ORDER BY k) FROM obj WHERE obj.image_id = pg.image_id AND k <= 4) AS objects, (SELECT string_agg(display_name || ':' || format('{{:.4f}}', score), ' ' ORDER BY k) FROM cl WHERE cl.image_id = pg.image_id AND k <= 3) AS clusters FROM pg LEFT JOIN best USING (image_id)"""),
    "image_details": (details, f"""WITH {PAIRS}, {ASSIGNED}, {REG}, o AS (SELECT image_id, string_agg(display_name || ':' || label_key || ':' || format('{{:.4f}}', score) || ':' || source, ' ' ORDER BY k) AS object_labels FROM obj GROUP BY 1), q AS (SELECT image_id, string_agg(display_name || ':' || format('{{:.4f}}', score), ' ' ORDER BY age) AS cluster_labels FROM cl GROUP BY 1),
b AS (SELECT anchor_id AS image_id, duplicate_id AS other, distance, 'anchor' AS role FROM pairs UNION ALL SELECT duplicate_id, anchor_id, distance, 'duplicate' FROM pairs), nd AS (SELECT b.image_id, string_agg(other || ':' || distance || ':' || role || ':/photos/' || i.vec_id || '.jpg', ' ' ORDER BY distance, other) AS near_duplicates FROM b JOIN img i ON i.image_id = other GROUP BY 1),
rg AS (SELECT format('{{:016x}}', image_id) AS image_id, string_agg(idx || ':' || CASE WHEN idx > 0 THEN label_key ELSE '(raw)' END || ':' || format('{{:.4f}}', score * pow(greatest(1e-6, greatest(0.0, x_max - x_min) * greatest(0.0, y_max - y_min)), 0.3) * greatest(0.0, 1.0 - 0.6 * sqrt(((x_min + x_max) / 2 - 0.5) * ((x_min + x_max) / 2 - 0.5) + ((y_min + y_max) / 2 - 0.5) * ((y_min + y_max) / 2 - 0.5)))) || ':' || upper(label_key), ' ' ORDER BY idx) AS regions FROM reg GROUP BY 1)
SELECT img.image_id, vec_id || '.jpg' AS logical_name, CASE WHEN vec_id % 4 = 0 THEN CAST(vec_id % 80 AS DOUBLE) WHEN vec_id % 2 = 0 THEN CAST(-(vec_id % 50) AS DOUBLE) END AS gps_latitude, CASE WHEN vec_id % 4 = 0 THEN CAST(vec_id % 170 AS DOUBLE) WHEN vec_id % 2 = 0 THEN CAST(-(vec_id % 60) AS DOUBLE) END AS gps_longitude,
CASE WHEN vec_id % 3 = 0 THEN 'alt ' || md5(text) ELSE md5(text) END AS caption, CASE WHEN text IS NOT NULL THEN CASE WHEN vec_id % 3 = 0 THEN 'alt' ELSE 'blip' END END AS caption_model, split_part(best.label_key, '.', 2) || ':' || format('{{:.2f}}', best.score) || ':' || (vec_id % 2 = 0) || ':' || (vec_id % 5 = 0) AS scene, object_labels, cluster_labels, coalesce(near_duplicates, '') AS near_duplicates, coalesce(regions, '') AS regions
FROM img LEFT JOIN best USING (image_id) LEFT JOIN o USING (image_id) LEFT JOIN q USING (image_id) LEFT JOIN nd USING (image_id) LEFT JOIN rg USING (image_id) LEFT JOIN documents ON doc_id = vec_id"""),
    "image_cluster_pass": (product_clusters, f"WITH RECURSIVE {GROUPS}, {SCENE}, {_clustered(f'''SELECT image_id AS id, {UNIT2} WHERE image_id IN (SELECT image_id FROM sc WHERE label_key IN ('scene.product', 'scene.food')) AND image_id NOT IN (SELECT image_id FROM grp WHERE NOT is_canonical)''')} SELECT 'cluster.{passes.IMAGE_METHOD}.' || m.cluster_id AS label_key, '{passes.IMAGE_METHOD} #' || m.cluster_id AS display_name, m.id AS target_id, m.id = center AS is_center, round(greatest(0.0, 1 - list_inner_product(m.u, c.u)), 6) AS distance FROM clu2 m JOIN mid2 USING (cluster_id) JOIN clu2 c ON c.id = center"),
    "region_cluster_pass": (region_labels, f"WITH RECURSIVE {IMG}, {_clustered(f'''SELECT format('{{:016x}}', vec_id // 3) || '#' || (vec_id % 3) AS id, {UNIT2}''')} SELECT 'region' AS target_type, id AS target_id, 'cluster.{passes.REGION_METHOD}.' || cluster_id AS label_key, '' AS from_region FROM clu2 UNION ALL SELECT 'image', split_part(id, '#', 1), 'cluster.{passes.REGION_METHOD}.' || cluster_id, max(id) FROM clu2 GROUP BY ALL"),
    "object_head_pass": (head_labels, f"WITH {PROTO}, {SCENE}, best AS (SELECT image_id, label_key AS scene FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS k FROM sc) WHERE k = 1), p AS (SELECT image_id, label_key, 1 / (1 + exp(-0.05 - list_inner_product(u, proto))) AS p FROM unit, proto), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, label_key) AS k FROM p) SELECT image_id AS target_id, label_key, round(p, 6) AS score, CAST(k - 1 AS INTEGER) AS head_rank FROM r JOIN best USING (image_id) WHERE scene IN ('scene.food', 'scene.people') AND k <= 5 AND p >= 0.5 AND label_key <> 'object.k3'"),
    "thumbnail_lookup": (thumbnails, "SELECT format('{:016x}', vec_id) AS image_id, CASE WHEN vec_id % 2 = 0 AND vec_id % 3 > 0 THEN '/t/' ELSE '/p/' END || vec_id AS path FROM embeddings WHERE vec_id % 5 > 0"),
    "artifact_sync": (synced, "WITH x AS (SELECT vec_id AS n, vec_id % 3 > 0 AS there, vec_id % 4 = 0 AND vec_id % 7 > 0 AS made FROM embeddings), y AS (SELECT *, made AND (NOT there OR n % 20 > 10) AS fresh FROM x WHERE there OR made) SELECT format('{:016x}', n) AS image_id, CASE WHEN fresh THEN 'new ' || n ELSE 'old' END AS caption, CASE WHEN fresh THEN n % 9 ELSE n % 5 END AS size, CASE WHEN fresh THEN n % 20 ELSE 10 END AS updated_at FROM y"),
}
