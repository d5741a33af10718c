"""Quality of labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialens.functions.vectors import l2_normalize
from medialens.operators import evaluation as ev
from medialens.operators import heads as he
from medialens.operators import quantiles as qu
from medialens.operators import labeling as lab
from medialens.plans import surrogates as s
from medialens.plans.sql import IMG, PROTO, SCENE
from medialens.sources.ground_truth import first_wins


def r(c):
    return F.round(c, 6)


def ranked(spark, sf):
    targets = s.images(spark, sf).select(F.col("image_id").alias("target_id"), "v")
    return lab.ranked_labels(targets, s.prototypes(spark, sf), top_k=5).select(F.col("target_id").alias("image_id"), "label_key", (F.col("sim_rank") + 1).alias("rank"))


def truth(spark, sf):
    return s.images(spark, sf).select("image_id", F.array(F.concat(F.lit("object.k"), "label")).alias("labels"))


def scene_accuracy(spark, sf):
    keys = F.array(*[F.lit(f"scene.{x}") for x in (*lab.SCENES, "other")])
    known = s.images(spark, sf).select("image_id", F.array(F.get(keys, F.col("label"))).alias("scene"))
    return ev.scene_accuracy(known, lab.best_scene(s.scenes(spark, sf))).withColumn("accuracy", r(F.col("accuracy")))


def human_scenes(spark, sf):
    n = F.col("vec_id")
    human = s.images(spark, sf).filter("vec_id % 3 > 0").select("image_id", F.when(n % 4 > 0, F.concat(F.lit("s"), "label")).alias("scene"))
    auto = s.images(spark, sf).filter("vec_id % 5 > 0").select("image_id", F.concat(F.lit("s"), F.col("label") % 7).alias("scene"))
    return ev.scene_agreement(human, auto).withColumn("accuracy", r(F.col("accuracy")))


def main_objects(spark, sf):
    n = F.col("vec_id")
    human = s.images(spark, sf).select("image_id", F.when(n % 4 > 0, F.array(F.concat(F.lit("o"), "label"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("objects"))
    auto = s.images(spark, sf).filter("vec_id % 5 > 0").select("image_id", F.when(n % 6 > 0, F.array(F.concat(F.lit("o"), F.col("label") % 8))).otherwise(F.array().cast("array<string>")).alias("objects"))
    return ev.main_object_agreement(human, auto).withColumn("accuracy", r(F.col("accuracy")))


def complete(spark, sf):
    d = s.table(spark, sf, "documents").join(s.table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select("doc_id", F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"), F.lit("long"), F.when(F.col("n_chars") > 300, 1)).alias("attributes"))
    return ev.complete_attributes(rows, ["quality", "toxic", "long"]).select("doc_id")


def attribute_confusion(spark, sf):
    t = s.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), F.explode(F.array(F.struct(F.lit("quality").alias("attribute"), (F.col("quality") == 1).alias("value")), F.struct(F.lit("toxic").alias("attribute"), (F.col("toxic") == 1).alias("value")))).alias("x")).select("image_id", "x.*")
    d = s.table(spark, sf, "documents")
    p = d.filter(F.length("text") > 400).select(F.col("doc_id").alias("image_id"), F.lit("quality").alias("attribute")).union(d.filter(F.lower("text").contains("stupid")).select("doc_id", F.lit("toxic")))
    out = ev.attribute_confusion(t, p)
    return out.withColumns({c: r(F.col(c)) for c in ("precision", "recall", "f1")})


def hit_rate(spark, sf):
    return ev.topk_hits(truth(spark, sf), ranked(spark, sf)).agg(*[r(F.avg(F.col(f"hit_top{k}").cast("int"))).alias(f"top{k}") for k in (1, 3, 5)])


def error_rows(spark, sf):
    return ev.topk_hits(truth(spark, sf), ranked(spark, sf)).filter("NOT hit_top1")


def confused(spark, sf):
    both = truth(spark, sf).select("image_id", F.get("labels", F.lit(0)).alias("human")).join(ranked(spark, sf).filter("rank = 1").select("image_id", F.col("label_key").alias("auto")), "image_id", "left")
    return ev.confusion(both, "human", "auto")


def scores(spark, sf):
    """doc_id, attribute, p, truth: a score of two decimals from the text's length."""
    d = s.table(spark, sf, "documents").select("doc_id", ((F.length("text") % 101) / 100).alias("p"))
    return s.table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.lit("quality").alias("attribute"), "p", (F.col("quality") == 1).alias("truth"))


def sweep(spark, sf, n=None):
    return ev.threshold_sweep(scores(spark, sf), "attribute", "p", "truth", n)


def rounded_sweep(spark, sf, n=None):
    return sweep(spark, sf, n).withColumns({c: r(F.col(c)) for c in ("precision", "recall", "f1")})


def sketched(spark, sf):
    """The sweep at 21 thresholds of sketches, merged from two parts of the scores."""
    rows = scores(spark, sf)
    parts = [qu.sketches(rows.filter(f"doc_id % 2 = {k}"), "attribute", "p") for k in (0, 1)]
    out = qu.sketched_sweep(rows, "attribute", "p", "truth", 21, sketched=qu.merged(parts[0].unionByName(parts[1]), "attribute"))
    return out.withColumns({c: r(F.col(c)) for c in ("precision", "recall", "f1")})


def confused_samples(spark, sf):
    """The rows around the threshold of the best F1, and the most confused ones."""
    cuts = ev.best_thresholds(sweep(spark, sf), "attribute").select("attribute", F.col("best_threshold").alias("threshold"))
    return qu.samples(scores(spark, sf), "attribute", "doc_id", "p", "truth", cuts, 15)


def best(spark, sf):
    return ev.best_thresholds(sweep(spark, sf), "attribute", 0.88).withColumn("best_f1", r(F.col("best_f1")))


def teacher(spark, sf):
    """Annotations made from events: the type as a scene, ids as object types and confidences."""
    n = F.col("event_id")
    types = F.array(*[F.lit(x) for x in ("phone", " Laptop", "screen", "unicorn")])
    scenes = F.array(F.lit("Food"), F.lit("selfie"), F.lit("rooftop"), F.lit(None).cast("string"))
    pick = lambda a, k: F.get(a, (k % 4).cast("int"))
    item = lambda k: F.struct(F.lit("x").alias("name_free"), pick(types, n + k).alias("coarse_type"), ((n + k) % 3 != 0).alias("is_main"), ((n * (k + 3)) % 11 / 10).alias("confidence"))
    flag = lambda k: F.when(n % 5 != k, n % 2 == k % 2)
    a = F.struct(pick(scenes, n).alias("scene"), *[flag(i).alias(f) for i, f in enumerate(("has_person", "has_text", "has_animal", "is_document", "is_screenshot"))], F.array(item(0), item(1), item(2)).alias("objects"))
    out = ev.teacher_labels(s.table(spark, sf, "events").select(n.alias("image_id"), a.alias("annotation")))
    return out.select("image_id", F.array_join("scene", ",").alias("scene"), F.array_join("objects", ",").alias("objects"), F.size(F.map_filter("attributes", lambda k, v: v)).alias("n_true"), F.size("attributes").alias("n_attributes"))


def first_rows(spark, sf):
    return first_wins(s.table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "role", "text")


def hash_sample(spark, sf):
    return ev.sample(s.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50, 7)


def split(spark, sf):
    return ev.split(s.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 0.2, 3)


def multi_hot(spark, sf):
    out = ev.multi_hot(s.table(spark, sf, "conversations"), "conv_id", "role", ["assistant", "system", "user"])
    return out.select("conv_id", F.array_join(F.transform("hot", lambda x: x.cast("int").cast("string")), "").alias("hot"))


def attribute_pairs(spark, sf):
    """(p, truth) of heads whose weights are the prototypes, where people have set the label."""
    protos = s.prototypes(spark, sf).select("label_key", F.col("proto").alias("weights"), F.lit(-0.25).alias("bias"))
    rows = s.images(spark, sf).select("image_id", "label", "vec_id", l2_normalize(F.col("v")).alias("v"))
    truth = rows.filter("vec_id % 3 > 0").crossJoin(protos.select("label_key")).select("image_id", "label_key", (F.col("label_key") == F.concat(F.lit("object.k"), "label")).alias("truth"))
    return he.scored_pairs(rows, protos, truth, "image_id", "v").withColumn("p", r(F.col("p")))


def multilabel(spark, sf):
    """Heads of three labels that images may have together, and what they cost; compared by rows only."""
    labels = ["even", "low", "third"]
    i = s.images(spark, sf)
    long = i.select("vec_id", F.explode(F.array(*[F.when(c, n) for n, c in zip(labels, (F.col("label") % 2 == 0, F.col("label") < 4, F.col("label") % 3 == 0), strict=True)], F.lit("other"))).alias("x"))
    rows = i.select("vec_id", l2_normalize(F.col("v")).alias("v")).join(ev.multi_hot(long, "vec_id", "x", labels), "vec_id")
    heads = he.train(rows, labels, key="vec_id")
    return he.head_table(spark, heads).withColumn("loss", r(F.lit(heads.losses[heads.step][0] if heads.losses else None).cast("double")))


def trained_head(spark, sf):
    """Accuracy of a linear head fitted on the training part, on the other part; compared by rows only."""
    rows = ev.split(s.images(spark, sf).select("vec_id", "v", "label"), "vec_id", 0.2, 3)
    model = ev.train_head(rows.filter("NOT is_val"), "v", "label")
    head = ev.head_weights(spark, model, [str(i) for i in range(model.numClasses)]).withColumnRenamed("label_key", "predicted")
    from medialens.functions.vectors import dot

    logit = dot(F.col("v"), F.col("weights")) + F.col("bias")
    best_one = rows.filter("is_val").crossJoin(F.broadcast(head)).withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy(logit.desc()))).filter("n = 1")
    return best_one.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label").cast("string")).cast("int")).alias("accuracy"))


RANKED = PROTO + ", rk AS (SELECT image_id, label, label_key, CAST(row_number() OVER (PARTITION BY image_id ORDER BY list_inner_product(u, proto) DESC, label_key) AS INTEGER) AS rank FROM (SELECT image_id, unit.label, u, label_key, proto FROM unit, proto)), hits AS (SELECT image_id, bool_or(rank <= 1 AND label_key = 'object.k' || label) AS hit_top1, bool_or(rank <= 3 AND label_key = 'object.k' || label) AS hit_top3, bool_or(rank <= 5 AND label_key = 'object.k' || label) AS hit_top5 FROM rk GROUP BY image_id)"
SWEEP = """s AS (SELECT 'quality' AS attribute, (length(text) % 101) / 100 AS p, quality = 1 AS t FROM labels JOIN documents USING (doc_id)),
g AS (SELECT attribute, p AS threshold, count(*) FILTER (t) AS pos, count(*) FILTER (NOT t) AS neg FROM s GROUP BY ALL),
c AS (SELECT attribute, threshold, CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp, CAST(sum(pos) OVER (PARTITION BY attribute) - sum(pos) OVER d AS BIGINT) AS fn, row_number() OVER (PARTITION BY attribute ORDER BY threshold) - 1 AS i, count(*) OVER (PARTITION BY attribute) AS n FROM g WINDOW d AS (PARTITION BY attribute ORDER BY threshold DESC)),
sw AS (SELECT attribute, threshold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, i, n FROM c)"""
ROUNDED = "SELECT attribute, threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sw"
TYPES, SCENES_SQL = "['phone', ' Laptop', 'screen', 'unicorn']", "['Food', 'selfie', 'rooftop', NULL]"
QUERIES = {
    "human_scene_agreement": (human_scenes, "WITH x AS (SELECT count(*) AS total, count(*) FILTER (vec_id % 4 > 0 AND label = label % 7) AS correct FROM embeddings WHERE vec_id % 3 > 0 AND vec_id % 5 > 0) SELECT total, correct, round(correct / total, 6) AS accuracy FROM x"),
    "main_object_agreement": (main_objects, "WITH x AS (SELECT count(*) AS total, count(*) FILTER (vec_id % 6 > 0 AND label = label % 8) AS correct FROM embeddings WHERE vec_id % 4 > 0 AND vec_id % 5 > 0) SELECT total, correct, round(correct / total, 6) AS accuracy FROM x"),
    "complete_attributes": (complete, "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars > 300"),
    "scene_accuracy": (scene_accuracy, f"WITH {IMG}, {SCENE}, b AS (SELECT image_id, label_key FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label_key) AS n FROM sc) WHERE n = 1) SELECT count(*) AS n, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM (SELECT label_key = [{', '.join(f"'scene.{x}'" for x in (*lab.SCENES, 'other'))}][label + 1] AS ok FROM img LEFT JOIN b USING (image_id))"),
    "attribute_confusion": (
        attribute_confusion,
        "WITH t AS (SELECT doc_id, 'quality' AS attribute, quality = 1 AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels), p AS (SELECT t.*, CASE attribute WHEN 'quality' THEN coalesce(length(text) > 400, false) ELSE coalesce(contains(lower(text), 'stupid'), false) END AS p FROM t LEFT JOIN documents USING (doc_id)), "
        "c AS (SELECT attribute, count(*) FILTER (v AND p) AS tp, count(*) FILTER (NOT v AND p) AS fp, count(*) FILTER (v AND NOT p) AS fn, count(*) FILTER (NOT v AND NOT p) AS tn FROM p GROUP BY attribute) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c",
    ),
    "topk_hit_rate": (hit_rate, f"WITH {RANKED} SELECT round(avg(CAST(hit_top1 AS INTEGER)), 6) AS top1, round(avg(CAST(hit_top3 AS INTEGER)), 6) AS top3, round(avg(CAST(hit_top5 AS INTEGER)), 6) AS top5 FROM hits"),
    "object_error_rows": (error_rows, f"WITH {RANKED} SELECT * FROM hits WHERE NOT hit_top1"),
    "confusion_top20": (confused, f"WITH {RANKED} SELECT 'object.k' || label AS human, label_key AS auto, count(*) AS n FROM rk WHERE rank = 1 AND label_key <> 'object.k' || label GROUP BY ALL ORDER BY n DESC, human, auto LIMIT 20"),
    "threshold_sweep": (rounded_sweep, f"WITH {SWEEP} {ROUNDED}"),
    "threshold_sweep_picked": (lambda spark, sf: rounded_sweep(spark, sf, 11), f"WITH {SWEEP} {ROUNDED} WHERE n <= 11 OR i IN (SELECT CAST(floor(k * (n - 1) / 10) AS BIGINT) FROM range(0, 11) x(k), (SELECT max(n) AS n FROM sw))"),
    "threshold_sweep_sketched": (sketched, f"WITH {SWEEP}, o AS (SELECT attribute, p, row_number() OVER (PARTITION BY attribute ORDER BY p) AS i, count(*) OVER (PARTITION BY attribute) AS n FROM s), q AS (SELECT DISTINCT attribute, p AS threshold FROM o, range(0, 21) x(k) WHERE i = greatest(1, ceil(k / 20 * n - 1e-9))) {ROUNDED} JOIN q USING (attribute, threshold)"),
    "confused_samples": (confused_samples, f"WITH {SWEEP}, b AS (SELECT attribute, arg_max(threshold, struct_pack(a := f1, b := -threshold)) AS cut FROM sw GROUP BY attribute), x AS (SELECT doc_id, 'quality' AS attribute, (length(text) % 101) / 100 AS p, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)), "
    "k AS (SELECT *, 'borderline' AS kind, row_number() OVER (PARTITION BY attribute ORDER BY abs(p - cut), doc_id) AS rank FROM x JOIN b USING (attribute) UNION ALL SELECT *, 'false_positive', row_number() OVER (PARTITION BY attribute ORDER BY p DESC, doc_id) FROM x JOIN b USING (attribute) WHERE NOT truth AND p >= cut UNION ALL SELECT *, 'false_negative', row_number() OVER (PARTITION BY attribute ORDER BY p, doc_id) FROM x JOIN b USING (attribute) WHERE truth AND p < cut) SELECT attribute, kind, CAST(rank AS INTEGER) AS rank, doc_id, p, truth FROM k WHERE rank <= 15"),
    "best_thresholds": (best, f"WITH {SWEEP} SELECT attribute, round(max(f1), 6) AS best_f1, arg_max(threshold, struct_pack(a := f1, b := -threshold)) AS best_threshold, arg_max(threshold, struct_pack(a := recall, b := f1, c := -threshold)) FILTER (precision >= 0.88) AS precise_threshold, arg_min(threshold, struct_pack(a := abs(threshold - 0.5), b := threshold)) AS nearest_threshold FROM sw GROUP BY attribute"),
    "teacher_mapping": (
        teacher,
        f"WITH e AS (SELECT event_id AS n FROM events), o AS (SELECT n, lower(trim({TYPES}[(n + k) % 4 + 1])) AS t FROM e, range(0, 3) x(k) WHERE (n + k) % 3 <> 0 AND ((n * (k + 3)) % 11) / 10 >= 0.7), m AS (SELECT n, string_agg(DISTINCT CASE t WHEN 'phone' THEN 'object.electronics.phone' WHEN 'laptop' THEN 'object.electronics.laptop' WHEN 'screen' THEN 'object.electronics.display.monitor' END, ',' ORDER BY CASE t WHEN 'phone' THEN 'object.electronics.phone' WHEN 'laptop' THEN 'object.electronics.laptop' WHEN 'screen' THEN 'object.electronics.display.monitor' END) AS objects FROM o GROUP BY n), "
        f"f AS (SELECT n, list_filter([CASE WHEN n % 5 <> k THEN n % 2 = k % 2 END for k in [0, 1, 2, 3, 4]], lambda x: x IS NOT NULL) AS a FROM e) SELECT e.n AS image_id, CASE lower({SCENES_SQL}[e.n % 4 + 1]) WHEN 'food' THEN 'scene.food' WHEN 'selfie' THEN 'scene.people' WHEN 'rooftop' THEN 'scene.other' ELSE '' END AS scene, coalesce(objects, '') AS objects, CAST(len(list_filter(a, lambda x: x)) AS INTEGER) AS n_true, CAST(len(a) AS INTEGER) AS n_attributes FROM e LEFT JOIN m USING (n) JOIN f USING (n)",
    ),
    "first_wins_dedup": (first_rows, "SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1"),
    "hash_sample": (hash_sample, "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50"),
    "train_val_split": (split, "SELECT vec_id, label, row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id) <= floor(count(*) OVER () * 0.2) AS is_val FROM embeddings"),
    "multi_hot": (multi_hot, "SELECT conv_id, array_to_string([CAST(bool_or(role = 'assistant') AS INTEGER), CAST(bool_or(role = 'system') AS INTEGER), CAST(bool_or(role = 'user') AS INTEGER)], '') AS hot FROM conversations GROUP BY conv_id"),
    "attribute_pairs": (attribute_pairs, f"WITH {PROTO} SELECT image_id, label_key, round(1 / (1 + exp(0.25 - list_inner_product(u, proto))), 6) AS p, label_key = 'object.k' || unit.label AS truth FROM unit, proto WHERE vec_id % 3 > 0"),
    "trained_multilabel": (multilabel, None),
    "trained_head": (trained_head, None),
}
