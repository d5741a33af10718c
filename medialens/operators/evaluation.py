"""Label quality: accuracy, confusion, hits, threshold sweeps, weak labels, sampling, heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.metrics import f1, ratio

# The teacher's object types and their label keys.
OBJECT_KEYS = {
    "electronics": "object.electronics",
    "circuit_board": "object.electronics.circuit_board",
    "disk": "object.electronics.disk",
    "charger": "object.electronics.charger",
    "phone": "object.electronics.phone",
    "laptop": "object.electronics.laptop",
    "tablet": "object.electronics.tablet",
    "mini_pc": "object.electronics.mini_pc",
    "computer_case": "object.electronics",
    "monitor": "object.electronics.display.monitor",
    "keyboard": "object.electronics.peripheral.keyboard",
    "mouse": "object.electronics.peripheral.mouse",
    "earphones": "object.electronics.audio.earbuds",
    "headphones": "object.electronics.audio.headphones",
    "hub": "object.electronics.peripheral.hub",
    "camera": "object.electronics.camera",
    "game_console": "object.electronics.console",
    "controller": "object.electronics.console.controller",
    "food": "object.food",
    "drink": "object.drink",
    "dessert": "object.food.dessert",
    "paper_document": "object.document.paper",
    "book": "object.document.book",
    "screen": "object.electronics.display.monitor",
    "packaging": "object.dailystuff",
    "card": "object.document.bank_card",
    "id_card": "object.document.id_card",
}
SCENE_NAMES = {**{s: f"scene.{s}" for s in ("landscape", "snapshot", "people", "food", "product", "document", "screenshot", "animals", "other")}, "selfie": "scene.people"}


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def scene_accuracy(truth: DataFrame, best: DataFrame) -> DataFrame:
    """n, correct, accuracy: records with a scene whose best predicted label is among its true ones."""
    rows = truth.filter(F.size("scene") > 0).join(best.select("image_id", "label_key"), "image_id", "left")
    hit = F.coalesce(F.array_contains("scene", F.col("label_key")), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct")).withColumn("accuracy", F.col("correct") / F.greatest(F.lit(1), F.col("n")))


def scene_agreement(human: DataFrame, auto: DataFrame) -> DataFrame:
    """total, correct, accuracy of automatic against human scenes (image_id, scene): total has all common images, also
    those without a human scene, which are never correct."""
    both = human.select("image_id", F.col("scene").alias("h")).join(auto.select("image_id", F.col("scene").alias("a")), "image_id")
    return _accuracy(both.select(F.coalesce(F.col("h") == F.col("a"), F.lit(False)).alias("right")))


def main_object_agreement(human: DataFrame, auto: DataFrame) -> DataFrame:
    """total, correct, accuracy of the first of the objects (image_id, objects); images without a human object do not count."""
    first = lambda df, name: df.select("image_id", F.get("objects", F.lit(0)).alias(name))
    both = first(human, "h").join(first(auto, "a"), "image_id").filter("h IS NOT NULL")
    return _accuracy(both.select(F.coalesce(F.col("h") == F.col("a"), F.lit(False)).alias("right")))


def _accuracy(rows: DataFrame) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct"))
    return counts.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def complete_attributes(rows: DataFrame, names: Sequence[str], column: str = "attributes") -> DataFrame:
    """Rows whose map of attributes has a value for each name; the others are left out."""
    return rows.filter(F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(F.col(column), n).isNotNull()))


def attribute_confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """attribute, tp, fp, fn, tn, precision, recall, f1 from truth (image_id, attribute, value) and the assigned
    (image_id, attribute). Only labelled attributes count."""
    rows = truth.filter("value IS NOT NULL").join(predicted.select("image_id", "attribute").distinct().withColumn("p", F.lit(True)), ["image_id", "attribute"], "left").withColumn("p", F.coalesce("p", F.lit(False)))
    v, p = F.col("value"), F.col("p")
    counts = rows.groupBy("attribute").agg(F.count_if(v & p).alias("tp"), F.count_if(~v & p).alias("fp"), F.count_if(v & ~p).alias("fn"), F.count_if(~v & ~p).alias("tn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn)})


def topk_hits(truth: DataFrame, ranked: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """image_id and hit_top<k>: truth (image_id, labels array) against ranked (image_id, label_key, rank from 1). No prediction is a miss."""
    rows = truth.join(ranked.filter(F.col("rank") <= max(ks)), "image_id", "left")
    hit = F.coalesce(F.array_contains("labels", F.col("label_key")), F.lit(False))
    return rows.groupBy("image_id").agg(*[F.coalesce(F.bool_or(hit & (F.col("rank") <= k)), F.lit(False)).alias(f"hit_top{k}") for k in ks])


def confusion(pairs: DataFrame, human: str, auto: str, limit: int = 20) -> DataFrame:
    """human, auto (`<none>` if missing), n: the most frequent differences, a report of `limit` rows."""
    both = pairs.select(F.col(human).alias("human"), F.coalesce(auto, F.lit("<none>")).alias("auto")).filter("human <> auto")
    return both.groupBy("human", "auto").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "human", "auto").limit(limit)


def threshold_sweep(scores: DataFrame, key: str, p: str, truth: str, max_thresholds: int | None = None) -> DataFrame:
    """key, threshold, tp, fp, fn, precision, recall, f1 for each distinct score, or evenly picked ones.

    Rows are first summed by (key, score). Running sums go inside 4,096 ranges of scores, on top of the sums of the
    ranges above, so a key with very many different scores does not gather in one task.
    """
    place = F.least(F.lit(4095), F.greatest(F.lit(0), F.floor(F.col("threshold") * 4096))).cast("int")
    at = scores.groupBy(key, F.col(p).alias("threshold")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg")).withColumn("range", place)
    higher = Window.partitionBy(key).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    sums = at.groupBy(key, "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("bigint")
    sums = sums.select(key, "range", F.coalesce(F.sum("p").over(higher), zero).alias("more_pos"), F.coalesce(F.sum("q").over(higher), zero).alias("more_neg"), F.coalesce(F.sum("c").over(lower), zero).alias("less"), F.sum("p").over(whole).alias("all"), F.sum("c").over(whole).alias("of"))
    here = Window.partitionBy(key, "range")
    down = here.orderBy(F.desc("threshold"))
    rows = at.withColumns({"own_pos": F.sum("pos").over(down), "own_neg": F.sum("neg").over(down), "own_n": F.row_number().over(here.orderBy("threshold"))}).join(sums, [key, "range"])
    rows = rows.select(key, "threshold", (F.col("own_pos") + F.col("more_pos")).alias("tp"), (F.col("own_neg") + F.col("more_neg")).alias("fp"), "all", (F.col("own_n") + F.col("less")).alias("n"), "of")
    if max_thresholds:
        # position i of m picks is floor(i (of - 1) / (m - 1)); a row is picked if some i lands on it
        i = F.ceil((F.col("n") - 1) * F.lit(max_thresholds - 1) / F.greatest(F.lit(1), F.col("of") - 1))
        rows = rows.filter((F.col("of") <= max_thresholds) | (F.floor(i * (F.col("of") - 1) / F.lit(max(1, max_thresholds - 1))) == F.col("n") - 1))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("all") - F.col("tp")
    return rows.select(key, "threshold", "tp", "fp", fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def best_thresholds(sweep: DataFrame, key: str, min_precision: float = 0.9, near: float = 0.5) -> DataFrame:
    """key, best_f1 and its threshold (the lowest of equals), the best recall at the precision asked for, and the threshold nearest to `near`."""
    ok = F.col("precision") >= min_precision
    return sweep.groupBy(key).agg(
        F.max("f1").alias("best_f1"),
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("best_threshold"),
        F.max_by(F.when(ok, F.col("threshold")), F.when(ok, F.struct("recall", "f1", -F.col("threshold")))).alias("precise_threshold"),
        F.min_by("threshold", F.struct(F.abs(F.col("threshold") - near), F.col("threshold"))).alias("nearest_threshold"),
    )


def teacher_labels(annotations: DataFrame, min_confidence: float = 0.7, only_main: bool = True) -> DataFrame:
    """image_id, scene (array), attributes (map), objects (sorted keys) from a teacher's annotation struct."""
    a = F.col("annotation")
    name = F.lower(F.trim(a["scene"]))
    scene = F.when(a["scene"].isNull(), F.array().cast("array<string>")).otherwise(F.array(F.coalesce(F.try_element_at(_map(SCENE_NAMES), name), F.lit("scene.other"))))
    names = ("has_person", "has_text", "has_animal", "is_document", "is_screenshot")
    entries = F.filter(F.array(*[F.struct(F.lit(f"attr.{n}").alias("key"), a[n].alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    fits = lambda o: (F.coalesce(o["confidence"], F.lit(0.0)) >= min_confidence) & (F.coalesce(o["is_main"], F.lit(False)) if only_main else F.lit(True))
    keys = F.transform(F.filter(F.coalesce(a["objects"], F.array().cast("array<struct<name_free:string,coarse_type:string,is_main:boolean,confidence:double>>")), fits), lambda o: F.try_element_at(_map(OBJECT_KEYS), F.lower(F.trim(o["coarse_type"]))))
    return annotations.select("image_id", scene.alias("scene"), F.map_from_entries(entries).alias("attributes"), F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("objects"))


def hash_order(key: str, seed: int) -> Column:
    """A shuffled order of rows that does not depend on partitions."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (1 at least) in the seed's order."""
    return df.orderBy(hash_order(key, seed), key).limit(max(1, n))


def split(df: DataFrame, key: str, validation: float = 0.2, seed: int = 0) -> DataFrame:
    """df with is_val: the first int(n * validation) rows in the seed's order validate.

    The cut is found without gathering the rows: counts of 4,096 ranges of the hash, then the order inside one range.
    """
    bucket = F.conv(F.substring(hash_order(key, seed), 1, 3), 16, 10).cast("int")
    rows = df.withColumn("__h", hash_order(key, seed)).withColumn("__b", bucket)
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.floor(F.sum("__n") * F.lit(validation)).alias("__cut"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    placed = rows.withColumn("__r", rank).join(F.broadcast(before.select("__b", "__before")), "__b").crossJoin(F.broadcast(total))
    return placed.withColumn("is_val", F.col("__before") + F.col("__r") <= F.col("__cut")).select(*df.columns, "is_val")


def multi_hot(df: DataFrame, key: str, label: str, labels: Sequence[str]) -> DataFrame:
    """key, hot: for each key whether it has each of the labels, in their order."""
    return df.groupBy(key).agg(F.collect_set(label).alias("have")).select(key, F.array(*[F.array_contains("have", name) for name in labels]).alias("hot"))


def train_head(df: DataFrame, vec: str, label: str, max_iter: int = 50, ridge: float = 1e-3):
    """A multinomial linear head on embeddings. label: class index from 0. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=ridge, family="multinomial").fit(rows)


def head_weights(spark, model, keys: Sequence[str]) -> DataFrame:
    """label_key, weights, bias of a fitted head."""
    m, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return spark.createDataFrame([(k, [float(x) for x in m[i]], float(b[i])) for i, k in enumerate(keys)], "label_key string, weights array<double>, bias double")
