"""Labels from embeddings: categories, attributes, zero-shot objects, gates, rollups, propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialens.functions.frames import small_side
from medialens.functions.metrics import clamp01, logistic, softmax_over
from medialens.functions.vectors import dot, l2_normalize, mean_by

# Scene types and attributes with their label keys.
SCENES = ("landscape", "snapshot", "people", "animals", "food", "product", "document", "screenshot", "other")
ATTRIBUTES = ("has_person", "has_text", "is_document", "is_screenshot", "has_animal")


def scene_key(scene_type):
    """`scene.<type>` of a scene type in any case; unknown or missing types are `scene.other`."""
    name = F.lower(F.trim(scene_type))
    return F.concat(F.lit("scene."), F.when(name.isin(*SCENES), name).otherwise("other"))


def _near(df: DataFrame, other: DataFrame) -> DataFrame:
    """All pairs of df with a table of vocabulary size: broadcast if it is checked to be small."""
    return df.crossJoin(small_side(other))


def prototypes(vectors: DataFrame, key: str, vec: str = "v") -> DataFrame:
    """key, proto: the mean of the normalized vectors of each key, normalized again."""
    units = vectors.select(key, l2_normalize(F.col(vec)).alias("__u")).filter("__u IS NOT NULL")
    return mean_by(units, [key], "__u", "__m").select(key, l2_normalize(F.col("__m")).alias("proto"))


def ranked_labels(targets: DataFrame, protos: DataFrame, allowed: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """target_id, label_key, similarity, sim_rank (from 0), margin of the top_k labels of each target.

    targets: target_id, v and, with allowed (scene_key, label_key), scene_key. margin is the first similarity less
    the second on the list (0 for a second that is missing). A target whose scene allows nothing has no rows.
    """
    units = targets.withColumn("__u", l2_normalize(F.col("v"))).filter("__u IS NOT NULL")
    if allowed is None:
        pairs = _near(units, protos)
    else:
        pairs = units.join(small_side(allowed), "scene_key").join(small_side(protos), "label_key")
    scored = pairs.select("target_id", "label_key", dot(F.col("__u"), F.col("proto")).alias("similarity"))
    w = Window.partitionBy("target_id").orderBy(F.desc("similarity"), "label_key")
    top = scored.withColumn("sim_rank", F.row_number().over(w) - 1)
    if top_k > 0:
        top = top.filter(F.col("sim_rank") < top_k)
    whole = Window.partitionBy("target_id")
    at = lambda r: F.max(F.when(F.col("sim_rank") == r, F.col("similarity"))).over(whole)
    return top.withColumn("margin", at(0) - F.coalesce(at(1), F.lit(0.0)))


def gate(ranked: DataFrame, score_min: float, margin_min: float) -> DataFrame:
    return ranked.filter((F.col("similarity") >= score_min) & (F.col("similarity") >= 0) & (F.col("margin") >= margin_min))


def allow_table(spark: SparkSession, labels: DataFrame, whitelist: Sequence[str], fallback: dict[str, Sequence[str]]) -> DataFrame:
    """scene_key, label_key: all labels for scenes of the whitelist, the listed ones for scenes with a fallback."""
    every = labels.select(F.explode(F.lit(list(whitelist)).cast("array<string>")).alias("scene_key"), "label_key")
    rows = [(s, label) for s, ls in fallback.items() if s not in whitelist for label in ls]
    return every if not rows else every.union(spark.createDataFrame(rows, "scene_key string, label_key string"))


def blacklist_and_remap(rows: DataFrame, blacklist: DataFrame, remap: DataFrame) -> DataFrame:
    """Rows without labels of the blacklist (source_key), which is held against the key before it is replaced by remap
    (source_key, target_key)."""
    kept = rows.join(small_side(blacklist.select(F.col("source_key").alias("label_key"))), "label_key", "left_anti")
    names = small_side(remap.select(F.col("source_key").alias("label_key"), "target_key"))
    return kept.join(names, "label_key", "left").withColumn("label_key", F.coalesce("target_key", "label_key")).drop("target_key")


def rollup(hits: DataFrame, score_min: float, min_regions: int = 1) -> DataFrame:
    """image_id, label_key, score, n_regions: labels that enough regions of an image have.

    hits: image_id, region_id, label_key, score. Several hits of one label in a region count as one, with the best score.
    """
    per_region = hits.groupBy("image_id", "label_key", "region_id").agg(F.max("score").alias("score"))
    rolled = per_region.groupBy("image_id", "label_key").agg(F.max("score").alias("score"), F.count_if(F.col("score") >= score_min).alias("n_regions"))
    return rolled.filter(F.col("n_regions") >= min_regions)


def best_scene(assignments: DataFrame) -> DataFrame:
    """image_id, label_key, score: the best scored label of each image; a missing score is 0, ties go to the smaller key."""
    w = F.max_by(F.struct("label_key", F.coalesce("score", F.lit(0.0)).alias("score")), F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), F.col("__order")))
    ordered = assignments.withColumn("__order", -F.dense_rank().over(Window.partitionBy("image_id").orderBy("label_key")))
    return ordered.groupBy("image_id").agg(w.alias("b")).select("image_id", "b.label_key", "b.score")


def coarse_category(images: DataFrame, prompts: DataFrame, score_min: float = 0.15, threshold: float = 0.01, fallback: str = "other") -> DataFrame:
    """image_id, category, confidence, margin from prompts (category, proto).

    A category scores its best prompt; scores become probabilities over the categories. The fallback is taken only
    if both the best probability and its lead are low.
    """
    scored = _near(images.select("image_id", l2_normalize(F.col("v")).alias("u")).filter("u IS NOT NULL"), prompts).groupBy("image_id", "category").agg(F.max(dot(F.col("u"), F.col("proto"))).alias("s"))
    probs = scored.select("image_id", "category", softmax_over(F.col("s"), "image_id").alias("p"))
    w = Window.partitionBy("image_id").orderBy(F.desc("p"), "category")
    top = probs.withColumn("n", F.row_number().over(w)).filter("n <= 2").groupBy("image_id").agg(F.max(F.when(F.col("n") == 1, F.col("category"))).alias("category"), F.max("p").alias("confidence"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("p"))), F.lit(0.0)).alias("second"))
    margin = F.col("confidence") - F.col("second")
    fell = (F.col("confidence") < score_min) & (margin < threshold)
    return top.select("image_id", F.when(fell, fallback).otherwise(F.col("category")).alias("category"), "confidence", margin.alias("margin"))


def attributes_by_prompts(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """image_id, attribute, margin, value, score from prompt pairs (attribute, positive, negative, threshold)."""
    pairs = _near(images.select("image_id", l2_normalize(F.col("v")).alias("u")).filter("u IS NOT NULL"), prompts)
    margin = dot(F.col("u"), F.col("positive")) - dot(F.col("u"), F.col("negative"))
    return pairs.select("image_id", "attribute", margin.alias("margin"), (margin > F.col("threshold")).alias("value"), logistic(margin).alias("score"))


def attributes_by_head(images: DataFrame, head: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, attribute, logit, probability, value from a linear head (attribute, weights, bias)."""
    logit = dot(F.col("v"), F.col("weights")) + F.col("bias")
    return _near(images.select("image_id", "v"), head).select("image_id", "attribute", logit.alias("logit"), logistic(logit).alias("probability"), (logistic(logit) >= threshold).alias("value"))


def head_objects(images: DataFrame, head: DataFrame, top_k: int = 5, threshold: float = 0.5) -> DataFrame:
    """image_id, label_key, probability, rank of the object head's best labels that pass the threshold."""
    p = logistic(dot(F.col("v"), F.col("weights")) + F.col("bias"))
    scored = _near(images.select("image_id", "v"), head).select("image_id", "label_key", p.alias("probability"))
    w = Window.partitionBy("image_id").orderBy(F.desc("probability"), "label_key")
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= max(top_k, 5)) & (F.col("probability") >= threshold))


def scene_assignments(attributes: DataFrame) -> DataFrame:
    """Wide scene rows (image_id, scene_type, scene_confidence and a flag and margin for each attribute) as label rows:
    image_id, label_key, score; of attributes only those that hold."""
    scene = attributes.select("image_id", scene_key(F.col("scene_type")).alias("label_key"), clamp01(F.col("scene_confidence")).alias("score"))
    there = [a for a in ATTRIBUTES if a in attributes.columns]
    flags = F.explode(F.array(*[F.struct(F.lit(f"attr.{a}").alias("label_key"), F.col(a).alias("value"), logistic(F.col(f"{a}_margin")).alias("score")) for a in there]))
    return scene.union(attributes.select("image_id", flags.alias("f")).filter("f.value").select("image_id", "f.label_key", "f.score"))


def propagate(assignments: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels of canonical images copied to the other members of their groups: image_id, label_key, score, extra.

    assignments: image_id, label_key, source, score, extra (map). Of several sources of a label the best score is
    copied, then the first source by name. extra tells the image a label comes from.
    """
    own = assignments.filter("source <> 'duplicate_propagated'")
    w = Window.partitionBy("image_id", "label_key").orderBy(F.desc("score"), "source")
    own = own.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("image_id").alias("group_id"), "label_key", "score", "extra")
    members = groups.filter(~F.col("is_canonical")).select("group_id", "image_id")
    mark = F.map_from_arrays(F.array(F.lit("duplicate_source_image_id")), F.array("group_id"))
    kept = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, _: k != "duplicate_source_image_id")
    return members.join(own, "group_id").select("image_id", "label_key", "score", F.to_json(F.map_concat(kept, mark)).alias("extra"))


def zero_shot_image_labels(images: DataFrame, protos: DataFrame, detected_at: float = 0.3) -> DataFrame:
    """image_id, label_key, probability, detected over all labels of each image."""
    scored = _near(images.select("image_id", l2_normalize(F.col("v")).alias("u")), protos).select("image_id", "label_key", dot(F.col("u"), F.col("proto")).alias("s"))
    p = softmax_over(F.col("s"), "image_id")
    return scored.select("image_id", "label_key", p.alias("probability"), (p >= detected_at).alias("detected"))


def fewshot_prototypes(samples: DataFrame, key: str, min_samples: int = 3) -> DataFrame:
    """key, proto, threshold, n: mean vectors, with mean less deviation of the samples' similarities within [0.3, 0.9]."""
    protos = mean_by(samples, [key], "v", "m").filter(F.col("n") >= min_samples).select(key, l2_normalize(F.col("m")).alias("proto"), "n")
    sims = samples.join(protos, key).select(key, ((dot(l2_normalize(F.col("v")), F.col("proto")) + 1) / 2).alias("s"))
    limits = sims.groupBy(key).agg(F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.avg("s") - F.stddev_pop("s"))).alias("threshold"))
    return protos.join(limits, key)
