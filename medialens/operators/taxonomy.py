"""The label vocabulary: seeds, lookups, aliases, assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.operators.labeling import ATTRIBUTES, SCENES
from medialens.sources.snapshot import insert_missing, upsert

# Keys of the object labels. Parents and names follow from them; aliases in other languages are data.
OBJECT_KEYS = """
object object.animals object.electronics object.food object.drink object.document object.stationery object.dailystuff
object.electronics.circuit_board object.electronics.expansion_card object.electronics.disk object.electronics.charger object.electronics.sbc
object.electronics.mini_pc object.electronics.mini_pc.mac_mini object.electronics.laptop object.electronics.laptop.macbook object.electronics.phone
object.electronics.phone.iphone object.electronics.tablet object.electronics.tablet.ipad object.electronics.peripheral.keyboard
object.electronics.peripheral.mouse object.electronics.display.monitor object.electronics.tv object.electronics.peripheral.hub
object.electronics.peripheral.power_strip object.electronics.audio.headphones object.electronics.audio.earbuds object.electronics.audio.earbuds.airpods
object.electronics.audio.speaker object.electronics.audio.microphone object.electronics.camera object.electronics.camera.lens
object.electronics.camera.tripod object.electronics.storage.external_drive object.electronics.storage.usb_drive object.electronics.network.router
object.electronics.console object.electronics.console.controller object.food.dish object.food.meal object.food.pizza object.food.burger object.food.fries
object.food.pasta object.food.sandwich object.food.salad object.food.rice_bowl object.food.noodles object.food.dumplings object.food.hotpot
object.food.sushi object.food.fruit object.food.dessert object.food.cake object.food.ice_cream object.food.cookie object.drink.coffee object.drink.tea
object.drink.milk_tea object.drink.juice object.drink.soda object.drink.beer object.drink.wine object.drink.water_bottle object.document.paper
object.document.book object.document.notebook object.document.id_card object.document.bank_card object.document.receipt object.stationery.pen
object.stationery.scissors object.dailystuff.mug object.dailystuff.bottle object.dailystuff.backpack object.dailystuff.suitcase
object.dailystuff.chair object.dailystuff.desk object.dailystuff.lamp
""".split()


def _named(keys: Sequence[str], level: str) -> list[tuple[str, str, str, str | None]]:
    """(key, name, level, parent): the parent is the longest proper prefix that is a key itself."""
    known = set(keys)
    out = []
    for key in keys:
        parts = key.split(".")
        parent = next((p for n in range(len(parts) - 1, 0, -1) if (p := ".".join(parts[:n])) in known), None)
        out.append((key, parts[-1].replace("_", " ").title(), level, parent))
    return out


def seed_labels(spark: SparkSession) -> DataFrame:
    """label_key, display_name, level, parent_key of all seeded labels; the same table every time."""
    rows = _named(["scene", *[f"scene.{s}" for s in SCENES]], "scene") + _named(["attr", *[f"attr.{a}" for a in ATTRIBUTES]], "attribute") + _named(OBJECT_KEYS, "object")
    return spark.createDataFrame(rows, "label_key string, display_name string, level string, parent_key string")


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new labels upserted by key. A label that changes its level, or whose parent is missing, is an error."""
    clash = old.alias("o").join(new.alias("n"), "label_key").filter("o.level <> n.level")
    if not clash.isEmpty():
        raise ValueError(f"the level of {clash.first()['label_key']} differs")
    out = upsert(old, new, ["label_key"])
    lost = out.filter("parent_key IS NOT NULL").join(out.select(F.col("label_key").alias("parent_key")), "parent_key", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"the parent of {lost.first()['label_key']} is missing")
    return out


def require_labels(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted labels; an unknown key is an error."""
    lost = wanted.join(labels, "label_key", "left_anti")
    if not lost.isEmpty():
        raise KeyError(lost.first()["label_key"])
    return wanted.join(labels, "label_key")


def add_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (label_key, language, alias_text) with those of new that are missing; blank ones are left out."""
    clean = new.withColumn("alias_text", F.trim("alias_text")).filter("alias_text <> ''")
    return insert_missing(old, clean, ["label_key", "language", "alias_text"])


def prompts(labels: DataFrame, aliases: DataFrame, languages: Sequence[str] = ("en", "zh")) -> DataFrame:
    """label_key, prompts: aliases in the languages' order, then those without a language; the name where there are none."""
    place = F.coalesce(*[F.when(F.col("language") == x, F.lit(i)) for i, x in enumerate(languages)], F.when(F.col("language").isNull(), F.lit(len(languages))))
    texts = aliases.withColumn("place", place).filter("place IS NOT NULL").groupBy("label_key").agg(F.sort_array(F.collect_list(F.struct("place", "alias_text"))).alias("x"))
    return labels.join(texts, "label_key", "left").select("label_key", F.coalesce(F.transform("x", lambda s: s["alias_text"]), F.array("display_name")).alias("prompts"))


def valid_assignments(rows: DataFrame) -> DataFrame:
    """Label assignments with a known kind of target and a target; others are left out."""
    return rows.filter("target_type IN ('image', 'region') AND target_id <> ''")


KEY = ("target_type", "target_id", "label_key", "source", "label_space_ver")


def upsert_assignments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assignments keyed by target, label, source and label space; created_at stays that of the first write."""
    return upsert(old, valid_assignments(new), KEY, ["created_at"])


def refresh_attributes(old: DataFrame, images: DataFrame, new: DataFrame) -> DataFrame:
    """old without the classifier's attributes of the images, and new ones."""
    mine = (F.col("source") == "classifier") & F.col("label_key").startswith("attr.") & (F.col("target_type") == "image")
    again = old.filter(mine).join(images.select(F.col("image_id").alias("target_id")), "target_id", "left_anti")
    return old.filter(~mine).unionByName(again.select(*old.columns)).unionByName(new.select(*old.columns))
