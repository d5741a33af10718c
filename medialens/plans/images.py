"""Hashes, near duplicates and groups of images."""

import uuid

from pyspark.sql import functions as F

from medialens.functions.hashing import hamming_hex, hex64, perceptual_hash, prefix_bucket
from medialens.functions.pixels import grey_thumbnails
from medialens.operators import ingest
from medialens.operators.graph import shared_folder, stored
from medialens.operators.kept_components import KeptComponents
from medialens.operators.near_duplicates import canonical_only, hamming_pairs, incremental_pairs, neighbours
from medialens.plans import surrogates as s
from medialens.plans.sql import BITS, GROUPS, HAMMING, PAIRS


def perceptual_bits(spark, sf):
    return s.hashed(spark, sf).select("image_id", hex64(F.col("bits")).alias("phash"))


def from_pixels(spark, sf):
    """Hashes of images whose grey pixels are made from their vectors, in sizes of their own; compared by rows only."""
    n = F.col("vec_id")
    wide, high = (32 + n % 40).cast("int"), (32 + n % 23).cast("int")
    pixel = lambda k: F.floor(128 + 900 * F.element_at("v", (k % 64 + 1).cast("int")) * F.element_at("v", (F.floor(k / 64) % 64 + 1).cast("int")))
    made = F.transform(F.sequence(F.lit(0), wide * high - 1), lambda k: F.greatest(F.lit(0), F.least(F.lit(255), pixel(k))))
    rows = s.images(spark, sf).select("image_id", wide.alias("width"), high.alias("height"), F.lit(1).alias("channels"), made.alias("pixels"))
    return grey_thumbnails(rows, "image_id").select("image_id", perceptual_hash("grey").alias("phash"))


def hamming_incremental(spark, sf):
    rows = s.hashed(spark, sf)
    dirty = rows.filter("mtime >= 70")
    before = hamming_pairs(rows.filter("mtime < 70"), HAMMING)
    return incremental_pairs(before, rows, dirty, HAMMING)


def banded(spark, sf):
    """The plan for large tables: bands of hashes instead of a broadcast side (distance 7, so that few values are near)."""
    return hamming_pairs(s.hashed(spark, sf), 17, small=0, bands=8)


def kept_groups(spark, sf):
    """Groups of near duplicates kept over three batches of changes: pairs, more pairs, and images that go."""
    near = stored(s.pairs(spark, sf).select(F.col("anchor_id").alias("a"), F.col("duplicate_id").alias("b"), "distance"))
    kept = KeptComponents(spark, f"{shared_folder(spark)}/components-{uuid.uuid4().hex}", "string")
    kept.apply(near.filter("distance % 2 = 0"))
    kept.apply(near.filter("distance % 2 = 1"))
    kept.apply(removed_nodes=s.images(spark, sf).filter("vec_id % 7 = 0").select(F.col("image_id").alias("node")))
    return kept.labels()


def canonical(spark, sf):
    return canonical_only(s.images(spark, sf).select("image_id", "label"), s.groups(spark, sf))


def buckets(spark, sf):
    return s.hashed(spark, sf).groupBy(prefix_bucket(F.col("bits")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first"))


def hamming_text(spark, sf):
    rows = perceptual_bits(spark, sf)
    other = F.when(F.substring("phash", 16, 1) == "0", "not a hash").otherwise(F.lit("00000000ffffffff"))
    return rows.select("image_id", hamming_hex(F.col("phash"), other).alias("distance"))


def exact_duplicates(spark, sf):
    return ingest.exact_duplicates(s.table(spark, sf, "documents"), "doc_id", "text").select("first", "n")


HEX = "array_to_string(list_transform(range(0, 16), lambda n: format('{:x}', 8 * b[4 * n + 1] + 4 * b[4 * n + 2] + 2 * b[4 * n + 3] + b[4 * n + 4])), '')"
QUERIES = {
    "exact_duplicates": (exact_duplicates, "SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY md5(text)"),
    "perceptual_bits": (perceptual_bits, f"WITH {BITS} SELECT image_id, {HEX} AS phash FROM bits"),
    "hash_prefix_buckets": (buckets, f"WITH {BITS} SELECT CAST('0x' || substr({HEX}, 1, 4) AS INTEGER) AS bucket, count(*) AS n, min(image_id) AS first FROM bits GROUP BY 1"),
    "perceptual_hash_of_pixels": (from_pixels, None),
    "hamming_hex": (hamming_text, f"WITH {BITS}, x AS (SELECT image_id, b, {HEX} AS h FROM bits) SELECT image_id, CASE WHEN h LIKE '%0' THEN 64 ELSE CAST(list_sum(b[1:32]) + 32 - list_sum(b[33:64]) AS INTEGER) END AS distance FROM x"),
    "hamming_pairs": (s.pairs, f"WITH {PAIRS} SELECT * FROM pairs"),
    "hamming_pairs_banded": (banded, f"WITH {PAIRS} SELECT * FROM pairs WHERE distance <= 17"),
    "hamming_pairs_incremental": (hamming_incremental, f"WITH {PAIRS} SELECT * FROM pairs"),
    "near_duplicate_groups": (s.groups, f"WITH RECURSIVE {GROUPS} SELECT * FROM grp"),
    "groups_kept_over_batches": (kept_groups, f"WITH RECURSIVE {PAIRS}, e AS (SELECT anchor_id AS a, duplicate_id AS b FROM pairs JOIN img x ON x.image_id = anchor_id JOIN img y ON y.image_id = duplicate_id WHERE x.vec_id % 7 <> 0 AND y.vec_id % 7 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON r.other = u.a) SELECT node, min(other) AS component FROM reach GROUP BY node"),
    "canonical_only": (canonical, f"WITH RECURSIVE {GROUPS} SELECT image_id, label FROM img WHERE image_id NOT IN (SELECT image_id FROM grp WHERE NOT is_canonical)"),
    "near_duplicate_neighbours": (lambda spark, sf: neighbours(s.pairs(spark, sf), unique=True), f"WITH {PAIRS} SELECT anchor_id AS image_id, duplicate_id AS other_id, distance FROM pairs UNION ALL SELECT duplicate_id, anchor_id, distance FROM pairs"),
}
