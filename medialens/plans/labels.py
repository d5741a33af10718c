"""Taxonomy, prototypes and label passes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialens.functions.frames import small_side
from medialens.functions.metrics import logistic, route, top_mean
from medialens.functions.vectors import dot
from medialens.operators import labeling as lab
from medialens.operators.graph import closure
from medialens.plans import surrogates as s
from medialens.plans.sql import GROUPS, IMG, PROTO, REG, SCENE


def r(c, n=6):
    return F.round(c, n)


def targets(spark, sf):
    return s.images(spark, sf).select(F.col("image_id").alias("target_id"), "v", "label")


def taxonomy(spark, sf):
    """The tree of part names below their types: each node, its ancestors and how far they are."""
    types = s.table(spark, sf, "part").select(F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("w")).distinct()
    nodes = types.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(F.array_join(F.slice("w", F.lit(1), i), " ").alias("node"), F.when(i > 1, F.array_join(F.slice("w", F.lit(1), i - 1), " ")).alias("parent")))).alias("n"))
    return closure(nodes.select("n.*").distinct(), "node", "parent")


def zero_shot(spark, sf):
    top = lab.gate(lab.ranked_labels(targets(spark, sf), s.prototypes(spark, sf), top_k=5), 0.1, 0.0)
    return top.select("target_id", "label_key", r(F.col("similarity")).alias("similarity"), "sim_rank", r(F.col("margin")).alias("margin"))


def coarse(spark, sf):
    prompts = s.prototypes(spark, sf).select(F.concat(F.lit("c"), F.substring("label_key", 9, 1).cast("int") % 4).alias("category"), "proto")
    out = lab.coarse_category(s.images(spark, sf), prompts, 0.29, 0.02)
    return out.select("image_id", "category", r(F.col("confidence")).alias("confidence"), r(F.col("margin")).alias("margin"))


def prompt_pairs(spark, sf):
    p = s.prototypes(spark, sf).withColumn("n", F.substring("label_key", 9, 1).cast("int"))
    pairs = p.filter("n < 5").select(F.concat(F.lit("attr.a"), "n").alias("attribute"), F.col("proto").alias("positive"), F.col("n").alias("i")).join(p.filter("n >= 5").select(F.col("proto").alias("negative"), (F.col("n") - 5).alias("i")), "i")
    out = lab.attributes_by_prompts(s.images(spark, sf), pairs.select("attribute", "positive", "negative", F.lit(0.05).alias("threshold")))
    return out.select("image_id", "attribute", r(F.col("margin")).alias("margin"), "value", r(F.col("score")).alias("score"))


def gated(spark, sf):
    protos = s.prototypes(spark, sf)
    allowed = lab.allow_table(spark, protos.select("label_key"), ["scene.food", "scene.product"], {"scene.screenshot": ["object.k1", "object.k2"]})
    best = lab.best_scene(s.scenes(spark, sf)).select("image_id", F.col("label_key").alias("scene_key"))
    rows = s.images(spark, sf).join(best, "image_id").select(F.col("image_id").alias("target_id"), "v", "scene_key")
    top = lab.gate(lab.ranked_labels(rows, protos, allowed, 5), 0.05, 0.0)
    black = spark.createDataFrame([("object.k3",)], "source_key string")
    remap = spark.createDataFrame([("object.k1", "object.k9"), ("object.k3", "object.k8")], "source_key string, target_key string")
    return lab.blacklist_and_remap(top, black, remap).select("target_id", "label_key", r(F.col("similarity")).alias("similarity"), "sim_rank")


def rollup(spark, sf):
    hits = s.regions(spark, sf).select("image_id", F.col("idx").alias("region_id"), "label_key", "score")
    return lab.rollup(hits, 0.32, 2)


def remapped(spark, sf):
    hits = s.regions(spark, sf, numbered=False)
    black = spark.createDataFrame([("object.p0",)], "source_key string")
    remap = spark.createDataFrame([("object.p0", "object.x"), ("object.p1", "object.x"), ("object.p2", "object.x")], "source_key string, target_key string")
    return lab.blacklist_and_remap(hits, black, remap).groupBy("label_key").agg(F.count(F.lit(1)).alias("n"))


def propagated(spark, sf):
    rows = s.scenes(spark, sf).withColumn("source", F.lit("classifier")).withColumn("extra", F.create_map(F.lit("k"), F.col("label_key")))
    low = rows.withColumn("source", F.lit("aggregated")).withColumn("score", F.col("score") / 2)
    return lab.propagate(rows.unionByName(low), s.groups(spark, sf))


def scene_rows(spark, sf):
    n = F.col("vec_id")
    wide = s.images(spark, sf).select("image_id", F.element_at(F.array(*[F.lit(x) for x in ("LANDSCAPE", " food ", "electronics")]), (n % 3 + 1).cast("int")).alias("scene_type"), ((n % 130) / 100).alias("scene_confidence"), *[c for i, a in enumerate(lab.ATTRIBUTES) for c in ((n % (i + 2) == 0).alias(a), ((n % 7) / 10 - 0.3).alias(f"{a}_margin"))])
    return lab.scene_assignments(wide).select("image_id", "label_key", r(F.col("score")).alias("score"))


def linear_head(spark, sf):
    head = s.prototypes(spark, sf).select("label_key", F.col("proto").alias("weights"), F.lit(-0.1).alias("bias"))
    return lab.head_objects(s.images(spark, sf), head).select("image_id", "label_key", r(F.col("probability")).alias("probability"), "rank")


def attribute_head(spark, sf):
    head = s.prototypes(spark, sf).filter("label_key < 'object.k5'").select(F.col("label_key").alias("attribute"), F.col("proto").alias("weights"), F.lit(-0.2).alias("bias"))
    return lab.attributes_by_head(s.images(spark, sf), head).select("image_id", "attribute", r(F.col("logit")).alias("logit"), r(F.col("probability")).alias("probability"), "value")


def image_labels(spark, sf):
    out = lab.zero_shot_image_labels(s.images(spark, sf), s.prototypes(spark, sf), 0.12)
    return out.groupBy("image_id").agg(r(top_mean(F.collect_list("probability"))).alias("confidence"), F.count_if("detected").alias("n_detected"))


def routing(spark, sf):
    return s.scenes(spark, sf).select("image_id", "label_key", route(F.col("score")).alias("routed"), r(logistic(F.col("score"))).alias("p"))


def fewshot(spark, sf):
    protos = lab.fewshot_prototypes(s.images(spark, sf).select(F.concat(F.lit("object.k"), "label").alias("label_key"), "v"), "label_key")
    return protos.select("label_key", r(F.col("threshold")).alias("threshold"), "n", r(F.get("proto", F.lit(0))).alias("first"))


def recognized(spark, sf):
    """Few-shot labels whose similarity passes the label's own threshold, the three best; a sentinel where none does."""
    images, protos = s.images(spark, sf), lab.fewshot_prototypes(s.images(spark, sf).select(F.concat(F.lit("object.k"), "label").alias("label_key"), "v"), "label_key")
    sims = images.crossJoin(small_side(protos)).select("image_id", "label_key", ((dot(F.col("v"), F.col("proto")) + 1) / 2).alias("s"), "threshold").filter("s >= threshold")
    top = sims.withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("s"), "label_key"))).filter("n <= 3")
    return images.select("image_id").join(top.select("image_id", "label_key", "n"), "image_id", "left").select("image_id", F.coalesce("label_key", F.lit("unknown")).alias("label_key"), F.coalesce("n", F.lit(1)).alias("n"))


SIM = PROTO + ", sim AS (SELECT image_id, label_key, list_inner_product(u, proto) AS similarity FROM unit, proto)"
FEW = PROTO + """, sv AS (SELECT p.label_key, p.proto, (list_inner_product(u, proto) + 1) / 2 AS s FROM unit JOIN proto p USING (label)),
mean2 AS (SELECT label, i, avg(v[i]) AS x FROM img, range(1, 65) t(i) GROUP BY label, i), pm2 AS (SELECT label, list(x ORDER BY i) AS m FROM mean2 GROUP BY label),
fp AS (SELECT 'object.k' || label AS label_key, label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS proto FROM pm2),
few AS (SELECT f.label_key, any_value(f.proto) AS proto, count(*) AS n, greatest(0.3, least(0.9, avg((list_inner_product(u, f.proto) + 1) / 2) - stddev_pop((list_inner_product(u, f.proto) + 1) / 2))) AS threshold FROM unit JOIN fp f USING (label) GROUP BY f.label_key HAVING count(*) >= 3)"""
QUERIES = {
    "label_taxonomy_paths": (
        taxonomy,
        "WITH t AS (SELECT DISTINCT string_split(p_type || ' ' || p_name, ' ') AS w FROM part), n AS (SELECT DISTINCT array_to_string(w[1:i], ' ') AS node, CASE WHEN i > 1 THEN array_to_string(w[1:i-1], ' ') END AS parent FROM t, range(1, 4) x(i) WHERE i <= len(w)), "
        "up AS (SELECT a.node, a.parent AS ancestor, 1 AS depth FROM n a WHERE parent IS NOT NULL UNION ALL SELECT a.node, b.parent, 2 FROM n a JOIN n b ON a.parent = b.node WHERE b.parent IS NOT NULL) SELECT node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY ALL",
    ),
    "class_prototypes": (lambda spark, sf: s.prototypes(spark, sf).select("label_key", F.posexplode("proto").alias("i", "x")).select("label_key", "i", r(F.col("x")).alias("x")), f"WITH {PROTO} SELECT label_key, CAST(i - 1 AS INTEGER) AS i, round(proto[i], 6) AS x FROM proto, range(1, 65) t(i)"),
    "zero_shot_topk": (zero_shot, f"WITH {SIM}, k AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS sim_rank FROM sim WINDOW w AS (PARTITION BY image_id ORDER BY similarity DESC, label_key)), m AS (SELECT *, max(similarity) FILTER (sim_rank = 0) OVER (PARTITION BY image_id) - max(similarity) FILTER (sim_rank = 1) OVER (PARTITION BY image_id) AS margin FROM k WHERE sim_rank < 5) SELECT image_id AS target_id, label_key, round(similarity, 6) AS similarity, sim_rank, round(margin, 6) AS margin FROM m WHERE similarity >= 0.1 AND margin >= 0"),
    "coarse_category": (coarse, f"WITH {SIM}, c AS (SELECT image_id, 'c' || (CAST(right(label_key, 1) AS INTEGER) % 4) AS category, max(similarity) AS s FROM sim GROUP BY ALL), p AS (SELECT image_id, category, exp(s) / sum(exp(s)) OVER (PARTITION BY image_id) AS p FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, category) AS n FROM p), t AS (SELECT image_id, max(category) FILTER (n = 1) AS category, max(p) AS confidence, max(p) - max(p) FILTER (n = 2) AS margin FROM o WHERE n <= 2 GROUP BY image_id) SELECT image_id, CASE WHEN confidence < 0.29 AND margin < 0.02 THEN 'other' ELSE category END AS category, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM t"),
    "attribute_prompt_pairs": (prompt_pairs, f"WITH {PROTO}, m AS (SELECT image_id, 'attr.a' || p.label AS attribute, list_inner_product(u, p.proto) - list_inner_product(u, n.proto) AS margin FROM unit, proto p JOIN proto n ON n.label = p.label + 5) SELECT image_id, attribute, round(margin, 6) AS margin, margin > 0.05 AS value, round(1 / (1 + exp(-margin)), 6) AS score FROM m"),
    "scene_gated_objects": (
        gated,
        f"WITH {SIM}, {SCENE}, bs AS (SELECT image_id, label_key AS scene_key FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS n FROM sc) WHERE n = 1), "
        "g AS (SELECT sim.* FROM sim JOIN bs USING (image_id) WHERE scene_key IN ('scene.food', 'scene.product') OR (scene_key = 'scene.screenshot' AND label_key IN ('object.k1', 'object.k2'))), "
        "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY similarity DESC, label_key) - 1 AS INTEGER) AS sim_rank FROM g), m AS (SELECT *, max(similarity) FILTER (sim_rank = 0) OVER (PARTITION BY image_id) - coalesce(max(similarity) FILTER (sim_rank = 1) OVER (PARTITION BY image_id), 0) AS margin FROM k WHERE sim_rank < 5) "
        "SELECT image_id AS target_id, CASE label_key WHEN 'object.k1' THEN 'object.k9' ELSE label_key END AS label_key, round(similarity, 6) AS similarity, sim_rank FROM m WHERE similarity >= 0.05 AND margin >= 0 AND label_key <> 'object.k3'",
    ),
    "object_rollup": (rollup, f"WITH {REG} SELECT image_id, label_key, max(score) AS score, count(*) FILTER (score >= 0.32) AS n_regions FROM reg GROUP BY ALL HAVING count(*) FILTER (score >= 0.32) >= 2"),
    "blacklist_remap": (remapped, f"WITH {REG} SELECT CASE WHEN label_key IN ('object.p1', 'object.p2') THEN 'object.x' ELSE label_key END AS label_key, count(*) AS n FROM reg WHERE label_key <> 'object.p0' GROUP BY 1"),
    "propagate_duplicate_labels": (propagated, f"""WITH RECURSIVE {GROUPS}, {SCENE} SELECT g.image_id, label_key, score, '{{"k":"' || label_key || '","duplicate_source_image_id":"' || group_id || '"}}' AS extra FROM grp g JOIN sc ON sc.image_id = g.group_id WHERE NOT is_canonical"""),
    "scene_label_write": (
        scene_rows,
        f"WITH {IMG}, w AS (SELECT image_id, vec_id AS n, ((vec_id % 7) / 10) - 0.3 AS m FROM img) SELECT image_id, CASE n % 3 WHEN 0 THEN 'scene.landscape' WHEN 1 THEN 'scene.food' ELSE 'scene.other' END AS label_key, round(least(1.0, (n % 130) / 100), 6) AS score FROM w "
        + "".join(f"UNION ALL SELECT image_id, 'attr.{a}', round(1 / (1 + exp(-m)), 6) FROM w WHERE n % {i + 2} = 0 " for i, a in enumerate(lab.ATTRIBUTES)),
    ),
    "linear_head_scores": (linear_head, f"WITH {PROTO}, p AS (SELECT image_id, label_key, 1 / (1 + exp(-(list_inner_product(v, proto) - 0.1))) AS probability FROM img, proto), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, label_key) AS INTEGER) AS rank FROM p) SELECT image_id, label_key, round(probability, 6) AS probability, rank FROM k WHERE rank <= 5 AND probability >= 0.5"),
    "attribute_head": (attribute_head, f"WITH {PROTO}, p AS (SELECT image_id, label_key AS attribute, list_inner_product(v, proto) - 0.2 AS logit FROM img, proto WHERE proto.label < 5) SELECT image_id, attribute, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS probability, 1 / (1 + exp(-logit)) >= 0.5 AS value FROM p"),
    "zero_shot_image_labels": (image_labels, f"WITH {SIM}, p AS (SELECT image_id, exp(similarity) / sum(exp(similarity)) OVER (PARTITION BY image_id) AS p FROM sim), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p DESC) AS n FROM p) SELECT image_id, round(avg(p) FILTER (n <= 3), 6) AS confidence, count(*) FILTER (p >= 0.12) AS n_detected FROM k GROUP BY image_id"),
    "best_scene_per_image": (lambda spark, sf: lab.best_scene(s.scenes(spark, sf)), f"WITH {IMG}, {SCENE} SELECT image_id, label_key, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS n FROM sc) WHERE n = 1"),
    "confidence_routing": (routing, f"WITH {IMG}, {SCENE} SELECT image_id, label_key, CASE WHEN score >= 0.8 THEN 'auto' WHEN score >= 0.5 THEN 'suggest' ELSE 'manual' END AS routed, round(1 / (1 + exp(-score)), 6) AS p FROM sc"),
    "fewshot_prototypes": (fewshot, f"WITH {FEW} SELECT label_key, round(threshold, 6) AS threshold, n, round(proto[1], 6) AS first FROM few"),
    "fewshot_recognize": (recognized, f"WITH {FEW}, h AS (SELECT image_id, label_key, (list_inner_product(v, proto) + 1) / 2 AS s, threshold FROM img, few), t AS (SELECT image_id, label_key, CAST(row_number() OVER (PARTITION BY image_id ORDER BY s DESC, label_key) AS INTEGER) AS n FROM h WHERE s >= threshold) SELECT img.image_id, coalesce(label_key, 'unknown') AS label_key, coalesce(n, 1) AS n FROM img LEFT JOIN (SELECT * FROM t WHERE n <= 3) x ON x.image_id = img.image_id"),
}
