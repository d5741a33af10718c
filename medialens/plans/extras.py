"""Vocabulary, payloads and small rules."""

from pyspark.sql import functions as F

from medialens.operators import labeling as lab
from medialens.operators import results as res
from medialens.operators import taxonomy as tax
from medialens.plans import surrogates as s
from medialens.plans.sql import IMG, PRIO, PROTO, REG, SCENE


def r(c):
    return F.round(c, 6)


def seeds(spark, sf):
    return tax.seed_labels(spark).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count("parent_key").alias("with_parent"))


def alias_prompts(spark, sf):
    p = s.table(spark, sf, "part")
    labels = p.select(F.concat(F.lit("object.p"), "p_partkey").alias("label_key"), F.col("p_name").alias("display_name"))
    aliases = p.filter("p_partkey % 3 > 0").select(F.concat(F.lit("object.p"), "p_partkey").alias("label_key"), F.explode(F.array(F.struct(F.when(F.col("p_partkey") % 3 == 1, "zh").alias("language"), F.col("p_brand").alias("alias_text")), F.struct(F.lit("en").alias("language"), F.col("p_type").alias("alias_text")))).alias("a")).select("label_key", "a.*")
    return tax.prompts(labels, aliases).select("label_key", F.array_join("prompts", "|").alias("prompts"))


def assignment_upsert(spark, sf):
    sc = s.scenes(spark, sf)
    rows = lambda df, at: df.select(F.when(F.col("score") < 0.9, "image").otherwise("nothing").alias("target_type"), F.col("image_id").alias("target_id"), "label_key", F.lit("classifier").alias("source"), F.lit("v1").alias("label_space_ver"), "score", F.lit(at).alias("created_at"))
    old = tax.valid_assignments(rows(sc.filter("score >= 0.3"), 1))
    out = tax.upsert_assignments(old, rows(sc.filter("score < 0.6"), 2))
    return out.select("target_id", "label_key", "score", "created_at")


def attribute_refresh(spark, sf):
    base = s.table(spark, sf, "labels").select(F.lit("image").alias("target_type"), F.col("doc_id").cast("string").alias("target_id"), F.lit("attr.toxic").alias("label_key"), F.lit("classifier").alias("source"), F.col("toxic").cast("double").alias("score"))
    other = base.withColumns({"label_key": F.lit("scene.food")})
    again = base.filter(F.col("target_id").cast("long") % 2 == 0)
    new = again.filter("score = 1").withColumn("score", F.lit(0.5))
    return tax.refresh_attributes(base.unionByName(other), again.select(F.col("target_id").alias("image_id")), new).groupBy("label_key", "score").agg(F.count(F.lit(1)).alias("n"))


def payloads(spark, sf):
    rows = s.regions(spark, sf).select("image_id", "idx", *[F.lit(0.5).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")], "label_key", F.lit(0.25).alias("score"))
    return res.region_payloads(rows)


def replaced(spark, sf):
    old = s.regions(spark, sf).select("image_id", "idx", "score")
    again = old.select("image_id").filter("image_id % 10 = 0").distinct()
    return res.replace_by_image(old, again.select("image_id", F.lit(0).alias("idx"), F.lit(1.0).alias("score")), again)


def postprocessed(spark, sf):
    return res.postprocess(s.regions(spark, sf), 2.0, 0.3, 5, 0.1, 0.5).select("image_id", "idx", "position")


def candidates(spark, sf):
    return res.cluster_candidates(s.regions(spark, sf)).select("image_id", "idx")


def type_scores(spark, sf):
    scores = s.scenes(spark, sf).select("image_id", "label_key", F.col("score").alias("p"))
    types = spark.createDataFrame([("scene.food", "eat"), ("scene.product", "eat"), ("scene.people", "who"), ("scene.other", "other")], "label_key string, scene_type string")
    return res.scene_margins(res.type_scores(scores, types)).select("image_id", "scene_type", "p", r(F.col("margin")).alias("margin"))


def grown(spark, sf):
    rows = s.images(spark, sf).select(F.concat(F.lit("object.k"), "label").alias("label_key"), "v")
    protos = lab.prototypes(rows, "label_key")
    out = protos.select("label_key", res.grown_prototype(F.col("proto"), F.lit(10), F.reverse("proto"), F.lit(5)).alias("g"))
    return out.select("label_key", r(F.get("g", F.lit(0))).alias("first"), r(F.get("g", F.lit(63))).alias("last"))


def reviewed(spark, sf):
    o = s.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("predicted"), F.when(F.col("o_orderkey") % 4 == 0, "other").otherwise(F.col("o_orderpriority")).alias("actual"))
    totals, fixes = res.annotation_stats(o)
    return totals.crossJoin(fixes).withColumn("accuracy", r(F.col("accuracy")))


def suggested(spark, sf):
    i = s.images(spark, sf)
    recent = i.filter("vec_id % 2 = 0").select("image_id", F.concat(F.lit("k"), "label").alias("label_key"))
    similar = i.select("image_id", F.explode(F.array(*[F.struct(F.concat(F.lit("k"), (F.col("label") + j) % 10).alias("label_key"), F.lit(j / 10).alias("similarity")) for j in range(4)])).alias("x")).select("image_id", "x.*")
    return res.suggestions(recent, similar)


def flat(spark, sf):
    out = res.flat_classes(lab.zero_shot_image_labels(s.images(spark, sf), s.prototypes(spark, sf)).select("image_id", "label_key", F.col("probability").alias("p")), 0.12)
    return out.select("image_id", "label_key", r(F.col("confidence")).alias("confidence"), F.array_join("alternatives", ",").alias("alternatives"), "threshold_met", "needs_review")


def hierarchical(spark, sf):
    """Scores of four sets of labels, made from the image's number."""
    n = F.col("vec_id")
    sets = {"general": ("Electronics", "Food", "Other"), "electronics": ("Smartphone", "Laptop", "Cable"), "food": ("Pizza", "Burger"), "specific_products": ("iPhone", "ThinkPad")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("label_set"), F.lit(x).alias("label_key"), ((n * (7 * i + 3 * j + 5)) % 101 / 100).alias("p")) for i, (k, names) in enumerate(sets.items()) for j, x in enumerate(names)]))
    return res.hierarchical_classes(s.images(spark, sf).select("image_id", "vec_id", rows.alias("r")).select("image_id", "r.*"))


def applied(spark, sf):
    i = s.images(spark, sf)
    verified = i.select("image_id", F.concat(F.lit("k"), "label").alias("label_key"), (F.col("vec_id") % 3 == 0).alias("human_verified"))
    similar = i.select("image_id", F.explode(F.array(*[F.format_string("%016x", F.col("vec_id") + j) for j in (1, 2)])).alias("similar_id"))
    return res.batch_applied(verified, similar)


def alerts(spark, sf):
    o = s.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("predicted"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("c"), F.col("o_custkey") % 300)).otherwise(F.col("o_orderpriority")).alias("actual"))
    return res.correction_alerts(o)


def annotation_screens(spark, sf):
    i, n = s.images(spark, sf), F.col("vec_id")
    predictions = i.select("image_id", F.concat(F.lit("k"), "label").alias("label_key"), ((n * 31) % 100 / 100).alias("confidence"))
    suggested = i.select("image_id", F.explode(F.array(*[F.struct(F.concat(F.lit("s"), F.lit(j)).alias("label_key"), ((n * j) % 10 / 10).alias("confidence")) for j in range(1, 6)])).alias("x")).select("image_id", "x.*")
    similar = i.filter("vec_id % 2 = 0").select("image_id", F.explode(F.sequence(F.lit(0), n % 4)).alias("similar_id"))
    out = res.annotation_payloads(predictions, suggested, similar)
    return out.withColumns({"suggestions": F.array_join("suggestions", ","), "actions": F.array_join("actions", ",")})


def registry(spark, sf):
    rows = s.table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("samples"), F.max("vec_id").alias("created_at")).select(F.concat(F.lit("k"), "label").alias("label_key"), F.when(F.col("label") < 5, "low").otherwise("high").alias("category"), "samples", (F.col("label") / 10).alias("accuracy"), "created_at")
    return res.registered_prototypes(rows, rows.filter("category = 'low' AND accuracy > 0.25"))


def thumbnails(spark, sf):
    w, h = res.thumbnail_size(F.col("width"), F.col("height"), 256)
    return s.images(spark, sf).select("image_id", w.alias("w"), h.alias("h"))


def artifacts(spark, sf):
    i = s.images(spark, sf).select("image_id", "vec_id", F.when(F.col("vec_id") % 5 == 0, "deleted").otherwise("active").alias("status"))
    a = i.select("image_id", F.lit("embedding").alias("artifact_type"), F.when(F.col("vec_id") % 2 == 0, "m:1").otherwise("m:2").alias("version_key"), F.when(F.col("vec_id") % 3 == 0, "error").otherwise("complete").alias("status"), F.concat(F.lit("/x/"), "image_id").alias("storage_path"))
    return res.current_artifacts(a, i, "embedding", "m:2")


def screenshots(spark, sf):
    n = F.col("vec_id")
    return s.images(spark, sf).select("image_id", r(res.screenshot_score((n % 2 == 0, 0.5), ((n % 10) / 10, 0.4), (F.when(n % 7 == 0, 1.0), 0.3))).alias("score"))


def ocr(spark, sf):
    n = F.col("vec_id")
    return res.wants_ocr(s.images(spark, sf).select("image_id", (n % 2 == 0).alias("has_text"), (n % 3 == 0).alias("is_document"), (n % 5 == 0).alias("is_screenshot"))).select("image_id")


def source_labels(spark, sf):
    """Best object of each image from the sources that may be shown."""
    rows = s.scenes(spark, sf).withColumn("source", F.element_at(F.array(*[F.lit(x) for x in ("aggregated", "manual", "zero_shot")]), (F.pmod(F.length("label_key"), F.lit(3)) + 1).cast("int")))
    return lab.best_scene(rows.filter(F.col("source").isin("aggregated", "manual", "duplicate_propagated")).drop("source"))


def model_versions(spark, sf):
    """The newest active version of each model and how many vectors each version has."""
    e = s.table(spark, sf, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model"), (F.col("vec_id") % 3).alias("version"))
    return e.groupBy("model", "version").agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(F.max("version").alias("newest"), F.max_by("n", "version").alias("n"))


QUERIES = {
    "label_seeds": (seeds, "SELECT * FROM (VALUES ('scene', CAST(10 AS BIGINT), CAST(9 AS BIGINT)), ('attribute', 6, 5), ('object', 81, 80)) t(level, n, with_parent)"),
    "alias_prompts": (alias_prompts, "SELECT 'object.p' || p_partkey AS label_key, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_type || '|' || p_brand END AS prompts FROM part"),
    "assignment_upsert": (assignment_upsert, f"WITH {IMG}, {SCENE} SELECT image_id AS target_id, label_key, score, CASE WHEN score >= 0.3 THEN 1 ELSE 2 END AS created_at FROM sc WHERE score < 0.9"),
    "attribute_refresh": (attribute_refresh, "SELECT label_key, score, count(*) AS n FROM (SELECT 'scene.food' AS label_key, CAST(toxic AS DOUBLE) AS score FROM labels UNION ALL SELECT 'attr.toxic', CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE toxic END FROM labels WHERE doc_id % 2 <> 0 OR toxic = 1) GROUP BY ALL"),
    "region_payload_json": (payloads, f"""WITH {REG} SELECT image_id, '{{"image_id":' || image_id || ',"detections":[' || string_agg('{{"idx":' || idx || ',"bbox":{{"x_min":0.5,"y_min":0.5,"x_max":0.5,"y_max":0.5}},"detector_label":"' || label_key || '","detector_score":0.25}}', ',' ORDER BY idx) || ']}}' AS payload FROM reg GROUP BY image_id"""),
    "region_replace": (replaced, f"WITH {REG} SELECT image_id, idx, score FROM reg WHERE image_id % 10 <> 0 UNION ALL SELECT DISTINCT image_id, 0, 1.0 FROM reg WHERE image_id % 10 = 0"),
    "detection_postprocess": (postprocessed, f"WITH {PRIO}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY priority DESC, idx) AS k FROM prio WHERE score >= 0.3), f AS (SELECT *, max(priority) FILTER (k = 1) OVER (PARTITION BY image_id) AS p0 FROM o), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k) AS INTEGER) AS position FROM f WHERE k = 1 OR (priority >= 0.1 AND (p0 <= 0 OR priority / p0 >= 0.5))) SELECT image_id, idx, position FROM q WHERE position <= 5"),
    "region_cluster_candidates": (candidates, f"WITH {REG} SELECT image_id, idx FROM reg WHERE score > 0.4 AND greatest(0.0, x_max - x_min) * greatest(0.0, y_max - y_min) BETWEEN 0.05 AND 0.6"),
    "scene_type_margins": (type_scores, f"WITH {IMG}, {SCENE}, t AS (SELECT image_id, CASE label_key WHEN 'scene.people' THEN 'who' WHEN 'scene.other' THEN 'other' ELSE 'eat' END AS scene_type, max(score) AS p FROM sc WHERE label_key IN ('scene.food', 'scene.product', 'scene.people', 'scene.other') GROUP BY ALL), a AS (SELECT image_id, scene_type, max(p) AS p FROM (SELECT * FROM t UNION ALL SELECT DISTINCT image_id, 'other', 0 FROM sc) GROUP BY ALL) SELECT a.image_id, a.scene_type, a.p, round(a.p - coalesce(max(b.p), 0), 6) AS margin FROM a LEFT JOIN a b ON a.image_id = b.image_id AND a.scene_type <> b.scene_type GROUP BY a.image_id, a.scene_type, a.p"),
    "incremental_prototype": (grown, f"WITH {PROTO}, g AS (SELECT label_key, list_transform(range(1, 65), lambda i: (proto[i] * 10 + proto[65 - i] * 5) / 15) AS g FROM proto) SELECT label_key, round(g[1] / sqrt(list_inner_product(g, g)), 6) AS first, round(g[64] / sqrt(list_inner_product(g, g)), 6) AS last FROM g"),
    "annotation_stats": (reviewed, "WITH o AS (SELECT o_orderpriority AS predicted, CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE o_orderpriority END AS actual FROM orders), t AS (SELECT count(*) AS total, count(*) FILTER (predicted = actual) AS correct, round(avg(CAST(predicted = actual AS INTEGER)), 6) AS accuracy FROM o) SELECT t.*, f.* FROM t, (SELECT predicted, actual, count(*) AS n FROM o WHERE predicted <> actual GROUP BY ALL ORDER BY n DESC, predicted, actual LIMIT 5) f"),
    "label_suggestions": (suggested, "SELECT image_id, label_key, max(c) AS confidence FROM (SELECT format('{:016x}', vec_id) AS image_id, 'k' || label AS label_key, 0.7::DOUBLE AS c FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT format('{:016x}', vec_id), 'k' || ((label + j) % 10), 0.6 FROM embeddings, (VALUES (2), (3)) x(j)) GROUP BY ALL"),
    "flat_classification": (flat, f"WITH {PROTO}, sim AS (SELECT image_id, label_key, list_inner_product(u, proto) AS s FROM unit, proto), p AS (SELECT image_id, label_key, exp(s) / sum(exp(s)) OVER (PARTITION BY image_id) AS p FROM sim), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, label_key) AS n FROM p) SELECT image_id, max(label_key) FILTER (n = 1) AS label_key, round(max(p), 6) AS confidence, string_agg(label_key, ',' ORDER BY n) FILTER (n > 1) AS alternatives, max(p) >= 0.12 AS threshold_met, max(p) < 0.12 AS needs_review FROM k WHERE n <= 4 GROUP BY image_id"),
    "hierarchical_classes": (hierarchical, f"WITH {IMG}, s AS (SELECT image_id, set, label_key, (vec_id * (7 * i + 3 * j + 5)) % 101 / 100 AS p FROM img, (VALUES ('general', 0, 'Electronics', 0), ('general', 0, 'Food', 1), ('general', 0, 'Other', 2), ('electronics', 1, 'Smartphone', 0), ('electronics', 1, 'Laptop', 1), ('electronics', 1, 'Cable', 2), ('food', 2, 'Pizza', 0), ('food', 2, 'Burger', 1), ('specific_products', 3, 'iPhone', 0), ('specific_products', 3, 'ThinkPad', 1)) t(set, i, label_key, j)), "
    "b AS (SELECT image_id, set, label_key, p FROM (SELECT *, row_number() OVER (PARTITION BY image_id, set ORDER BY p DESC, label_key DESC) AS n FROM s) WHERE n = 1), one AS (SELECT image_id, label_key AS level1, p AS confidence1 FROM b WHERE set = 'general'), "
    "two AS (SELECT one.*, b.label_key AS level2, b.p AS confidence2 FROM one LEFT JOIN b ON b.image_id = one.image_id AND confidence1 > 0.5 AND b.set = CASE level1 WHEN 'Electronics' THEN 'electronics' WHEN 'Food' THEN 'food' END) SELECT two.*, b.label_key AS level3, b.p AS confidence3 FROM two LEFT JOIN b ON b.image_id = two.image_id AND b.set = 'specific_products' AND level2 IN ('Smartphone', 'Laptop', 'Tablet')"),
    "batch_applied": (applied, "SELECT DISTINCT format('{:016x}', vec_id + j) AS image_id, 'k' || label AS label_key, 0.95::DOUBLE AS confidence, 'batch_applied' AS action FROM embeddings, (VALUES (1), (2)) t(j) WHERE vec_id % 3 = 0"),
    "correction_alerts": (alerts, "SELECT o_orderpriority AS predicted, 'c' || (o_custkey % 300) AS actual, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL HAVING count(*) >= 5"),
    "annotation_payloads": (annotation_screens, f"WITH {IMG}, l AS (SELECT image_id, vec_id, 'k' || label AS label_key, (vec_id * 31) % 100 / 100 AS c FROM img), r AS (SELECT image_id, 's' || j AS k, row_number() OVER (PARTITION BY image_id ORDER BY (vec_id * j) % 10 DESC, 's' || j) AS n FROM img, range(1, 6) t(j)), t AS (SELECT image_id, string_agg(k, ',' ORDER BY n) AS three FROM r WHERE n <= 3 GROUP BY 1) "
    "SELECT image_id, CASE WHEN c >= 0.8 THEN 'auto' WHEN c >= 0.5 THEN 'suggest' ELSE 'manual' END AS level, CASE WHEN c >= 0.5 AND c < 0.8 THEN label_key || ',' || three ELSE '' END AS suggestions, CASE WHEN c >= 0.8 THEN 'Space:Confirm,X:Skip,E:Edit' WHEN c >= 0.5 THEN '1-4:Choose suggestion,T:Enter custom label,X:Skip' ELSE '1-9:Use quick label,T:Enter label,X:Mark unknown' END AS actions, "
    "CASE WHEN c >= 0.8 THEN 'AI is confident this is: ' || label_key WHEN c >= 0.5 THEN 'AI is unsure. Please confirm or adjust.' ELSE 'AI cannot classify this image. Manual input required.' END AS message, CASE WHEN vec_id % 2 = 0 THEN vec_id % 4 + 1 ELSE 0 END AS similar_count FROM l JOIN t USING (image_id)"),
    "prototype_registry": (registry, "SELECT 'k' || label AS label_key, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS category, count(*) AS samples, label / 10 AS accuracy, max(vec_id) AS created_at FROM embeddings GROUP BY label HAVING label < 3 OR label >= 5"),
    "thumbnail_sizes": (thumbnails, f"WITH {IMG}, k AS (SELECT *, least(1.0, 256.0::DOUBLE / greatest(width, height)) AS k FROM img) SELECT image_id, CAST(greatest(1, round_even(width * k, 0)) AS INTEGER) AS w, CAST(greatest(1, round_even(height * k, 0)) AS INTEGER) AS h FROM k"),
    "current_artifacts": (artifacts, "SELECT format('{:016x}', vec_id) AS image_id, '/x/' || format('{:016x}', vec_id) AS storage_path FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 2 = 1 AND vec_id % 3 <> 0"),
    "screenshot_score": (screenshots, "SELECT format('{:016x}', vec_id) AS image_id, round(least(1.0, (CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 0 END) + (vec_id % 10) / 10 * 0.4 + (CASE WHEN vec_id % 7 = 0 THEN 0.3 ELSE 0 END)), 6)::DOUBLE AS score FROM embeddings"),
    "ocr_gate": (ocr, "SELECT format('{:016x}', vec_id) AS image_id FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0"),
    "shown_sources": (source_labels, f"WITH {IMG}, {SCENE}, f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS n FROM sc WHERE length(label_key) % 3 < 2) SELECT image_id, label_key, score FROM f WHERE n = 1"),
    "model_versions": (model_versions, "WITH e AS (SELECT 'm' || (vec_id % 2) AS model, vec_id % 3 AS version, count(*) AS n FROM embeddings GROUP BY ALL) SELECT model, max(version) AS newest, arg_max(n, version) AS n FROM e GROUP BY model"),
}
