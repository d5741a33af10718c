"""Near duplicates of images by perceptual hash."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialens.functions.frames import ship
from medialens.functions.hashing import hamming
from medialens.operators.graph import connected_components, stored

DEFAULT_DISTANCE = 12
#: Below so many rows one side is broadcast and all pairs are tested row by row, which one task may have to do; above, hashes meet in tiles.
SMALL = 4_096
#: A tile is two blocks of about BLOCK hashes at most; smaller tables are cut into SPREAD blocks of about LEAST or more, so that many tasks share them.
BLOCK, SPREAD, LEAST = 65_536, 10, 4_096
#: Pairs that a tile tests at once, and that it hands on at once.
TESTED, HANDED = 1 << 18, 1 << 17


def _anchor_first(left: str, right: str) -> Column:
    """Whether the left image is the anchor: newer, or of equal age with the smaller id."""
    lm, rm, li, ri = (F.col(f"{s}.{c}") for c in ("mtime", "image_id") for s in (left, right))
    return (lm > rm) | ((lm == rm) & (li < ri))


def _pairs(joined: DataFrame) -> DataFrame:
    first = _anchor_first("l", "r")
    pick = lambda yes, no: F.when(first, F.col(f"{yes}.image_id")).otherwise(F.col(f"{no}.image_id"))
    return joined.select(pick("l", "r").alias("anchor_id"), pick("r", "l").alias("duplicate_id"), hamming(F.col("l.bits"), F.col("r.bits")).alias("distance"))


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK), min(SPREAD, -(-n // LEAST)))


def _tiles(rows: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """rows (one for each image) by tile (i, j), as the side that asks and the side that is asked; `twice` marks those among the asked that also ask in the same or the mirrored tile."""
    n = _blocks(rows.count())
    block = lambda k: F.pmod(F.xxhash64("image_id", F.lit("block")), F.lit(k)).cast("int")
    every = lambda low, high: F.explode(F.sequence(low, high))
    if probe is None:
        asks = rows.select("*", block(n).alias("i")).select("*", every(F.col("i"), F.lit(n - 1)).alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("twice"))
        asked = rows.select("*", block(n).alias("j")).select("*", every(F.lit(0), F.col("j")).alias("i"), F.lit(False).alias("asks")).withColumn("twice", F.col("i") == F.col("j"))
        return asks.unionByName(asked)
    changed = probe.select("image_id", F.lit(True).alias("changed")).distinct()
    m = _blocks(probe.count())
    asks = probe.select("*", block(m).alias("i"), every(F.lit(0), F.lit(n - 1)).alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("twice"))
    asked = rows.join(changed, "image_id", "left").select(*rows.columns, block(n).alias("j"), every(F.lit(0), F.lit(m - 1)).alias("i"), F.lit(False).alias("asks"), F.coalesce("changed", F.lit(False)).alias("twice"))
    return asks.unionByName(asked)


def _found(tile: pa.Table, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a tile sorted by image_id: the number of each row's image, and the rows of its near pairs, the smaller id first, some at a time."""
    node = tile["image_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    bits, asks, twice = tile["bits"].to_numpy().view(np.uint64), tile["asks"].to_numpy(), tile["twice"].to_numpy()
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    step = max(1, TESTED // max(1, len(right)))
    for at in range(0, len(left) if len(right) else 0, step):
        some = left[at : at + step]
        near = np.flatnonzero(np.bitwise_count(bits[some][:, None] ^ bits[right][None, :]) <= distance)
        l, r = some[near // len(right)], right[near % len(right)]
        good = (node[l] < node[r]) | ((node[l] > node[r]) & ~twice[r])
        l, r = l[good], r[good]
        if len(l):
            down = node[l] > node[r]
            yield node, np.where(down, r, l), np.where(down, l, r)


def _tile_pairs(rows: DataFrame, distance: int, probe: DataFrame | None = None) -> DataFrame:
    """The near pairs of rows (image_id, bits, mtime), or those with a row of probe."""
    ship(rows.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches)).sort_by("image_id").combine_chunks()
        bits = tile["bits"].to_numpy().view(np.uint64)
        ids, mtimes = tile["image_id"].combine_chunks(), tile["mtime"].combine_chunks()

        def handed(some: list) -> pa.RecordBatch:
            l, r = (np.concatenate([x[k] for x in some]) for k in (0, 1))
            near = np.bitwise_count(bits[l] ^ bits[r]).astype(np.int32)
            l, r = pa.array(l), pa.array(r)
            return pa.RecordBatch.from_arrays([ids.take(l), mtimes.take(l), ids.take(r), mtimes.take(r), pa.array(near)], names=["li", "lm", "ri", "rm", "distance"])

        kept, size = [], 0
        for _, l, r in _found(tile, distance):
            for at in range(0, len(l), HANDED):
                kept.append((l[at : at + HANDED], r[at : at + HANDED]))
                size += len(kept[-1][0])
                if size >= HANDED:
                    yield handed(kept)
                    kept, size = [], 0
        if kept:
            yield handed(kept)

    i, m = (rows.schema[c].dataType.simpleString() for c in ("image_id", "mtime"))
    found = _tiles(rows, probe).groupBy("i", "j").applyInArrow(pairs, f"li {i}, lm {m}, ri {i}, rm {m}, distance int")
    first = (F.col("lm") > F.col("rm")) | ((F.col("lm") == F.col("rm")) & (F.col("li") < F.col("ri")))
    pick = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    return found.select(pick("li", "ri").alias("anchor_id"), pick("ri", "li").alias("duplicate_id"), "distance")


def _tile_trees(rows: DataFrame, distance: int) -> DataFrame:
    """anchor_id, duplicate_id: for each tile, edges from the smallest image of each of its connected parts to the part's others; together they connect what the near pairs connect."""
    ship(rows.sparkSession)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches)).sort_by("image_id").combine_chunks()
        names = tile["image_id"].combine_chunks().dictionary_encode().dictionary
        root = np.arange(len(names))
        for node, l, r in _found(tile, distance):
            while True:
                a, b = root[node[l]], root[node[r]]
                apart = a != b
                if not apart.any():
                    break
                l, r, a, b = l[apart], r[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := root[root], root):
                    root = up
        below = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(root[below])), names.take(pa.array(below))], names=["anchor_id", "duplicate_id"])

    i = rows.schema["image_id"].dataType.simpleString()
    return _tiles(rows).groupBy("i", "j").applyInArrow(trees, f"anchor_id {i}, duplicate_id {i}")


def hamming_pairs(images: DataFrame, distance: int = DEFAULT_DISTANCE, delta: DataFrame | None = None, small: int = SMALL, bands: int | None = None) -> DataFrame:
    """anchor_id, duplicate_id, distance of the pairs at most so far apart, each once.

    images: image_id, bits, mtime. With delta (image_id) only pairs that touch it. A distance of 0 or less means the default.
    Up to `small` rows all pairs are tested against a broadcast side. Beyond, all pairs are tested too, in tiles of two blocks of
    bounded size, about a nanosecond a pair; what is shuffled is a few blocks' worth of hashes for each block, never a pair.

    With `bands` each hash is cut into so many bands instead: two hashes within d agree up to d // bands bits in some band, so one side looks up all values of a band
    that near, an equi-join finds the candidates, and no pair is lost. Lookups are many unless d // bands is 0 or 1.
    """
    distance = distance if distance > 0 else DEFAULT_DISTANCE
    rows = images.filter("bits IS NOT NULL").select("image_id", F.col("bits").cast("bigint").alias("bits"), "mtime")
    changed = None if delta is None else delta.select("image_id").distinct()
    near = hamming(F.col("l.bits"), F.col("r.bits")) <= distance
    if rows.limit(small + 1).count() <= small:
        probe = rows if changed is None else rows.join(changed, "image_id", "left_semi")
        return _pairs(probe.alias("l").join(F.broadcast(rows.alias("r")), near & (F.col("l.image_id") < F.col("r.image_id") if delta is None else F.col("l.image_id") != F.col("r.image_id")))).distinct()
    if bands is None:
        rows = stored(rows.filter("image_id IS NOT NULL").distinct())
        found = _tile_pairs(rows, distance, None if changed is None else stored(rows.join(changed, "image_id", "left_semi")))
        # images that are listed once make pairs that are found once
        return found if rows.select("image_id").distinct().count() == rows.count() else found.distinct()
    probe = rows if changed is None else rows.join(changed, "image_id", "left_semi")
    width = 64 // bands
    masks = [sum(1 << b for b in c) for n in range(distance // bands + 1) for c in combinations(range(width), n)]
    band = lambda i: F.shiftrightunsigned("bits", i * width).bitwiseAND((1 << width) - 1)
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), band(i).alias("value")) for i in range(bands)]))
    table = rows.select("*", cut.alias("k")).select("image_id", "bits", "mtime", "k.*")
    flips = F.explode(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"))
    lookups = probe.select("*", cut.alias("k")).select("image_id", "bits", "mtime", "k.band", F.col("k.value").alias("own")).select("*", flips.alias("flip")).withColumn("value", F.col("own").bitwiseXOR(F.col("flip")))
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.image_id") != F.col("r.image_id"))
    return _pairs(lookups.alias("l").join(table.alias("r"), same & near)).distinct()


def group_edges(images: DataFrame, distance: int = DEFAULT_DISTANCE, small: int = SMALL) -> DataFrame:
    """anchor_id, duplicate_id: edges that connect the same images as hamming_pairs() does. Of n images with one hash there are n - 1 edges, to the one with the
    smallest id, which alone is compared with other hashes; all pairs would be n (n - 1) / 2. Beyond `small` distinct hashes a tile hands on one edge an image at most."""
    distance = distance if distance > 0 else DEFAULT_DISTANCE
    rows = images.filter("bits IS NOT NULL AND image_id IS NOT NULL").select("image_id", F.col("bits").cast("bigint").alias("bits"))
    first = stored(rows.groupBy("bits").agg(F.min("image_id").alias("image_id")).withColumn("mtime", F.lit(0)))
    near = hamming_pairs(first, distance, small=small).select("anchor_id", "duplicate_id") if first.limit(small + 1).count() <= small else _tile_trees(first, distance)
    same = rows.withColumnRenamed("image_id", "duplicate_id").join(first.select("bits", F.col("image_id").alias("anchor_id")), "bits").filter("anchor_id <> duplicate_id")
    return near.unionByName(same.select("anchor_id", "duplicate_id"))


def incremental_pairs(old_pairs: DataFrame, images: DataFrame, dirty: DataFrame, distance: int = DEFAULT_DISTANCE, **options) -> DataFrame:
    """The pairs after a change: those that touch dirty or vanished images are dropped, those of dirty images are computed anew."""
    stays = images.select(F.col("image_id").alias("id")).join(dirty.select(F.col("image_id").alias("id")), "id", "left_anti")
    kept = old_pairs
    for side in ("anchor_id", "duplicate_id"):
        kept = kept.join(stays, F.col(side) == F.col("id"), "left_semi")
    return kept.unionByName(hamming_pairs(images, distance, dirty, **options))


def duplicate_groups(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """group_id (the canonical image), image_id, is_canonical, distance of the members of groups of two or more.

    Canonical is the largest by pixels (unknown sides count as 0), bytes, then id. images: image_id, bits, width, height, size_bytes; pairs: anchor_id, duplicate_id, of hamming_pairs() or
    group_edges().
    """
    labels = connected_components(pairs, "anchor_id", "duplicate_id").withColumnRenamed("node", "image_id")
    members = labels.join(images, "image_id").select("component", "image_id", "bits", (F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).cast("bigint").alias("area"), "size_bytes")
    best = members.groupBy("component").agg(F.max(F.struct("area", "size_bytes", "image_id", "bits")).alias("best"))
    both = members.join(best, "component")
    return both.select(F.col("best.image_id").alias("group_id"), "image_id", (F.col("image_id") == F.col("best.image_id")).alias("is_canonical"), hamming(F.col("bits"), F.col("best.bits")).alias("distance"))


def canonical_only(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Images without the members of groups that are not canonical."""
    return images.join(groups.filter(~F.col("is_canonical")).select("image_id"), "image_id", "left_anti")


def neighbours(pairs: DataFrame, image_ids: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """image_id, other_id, distance: both directions of each pair, the smaller distance where there are several. `unique` says that no two images
    have several, as those of hamming_pairs() have not where each image is listed once; then no pair is shuffled."""
    way = lambda a, b: F.struct(F.col(a).alias("image_id"), F.col(b).alias("other_id"), "distance")
    both = pairs.select(F.inline(F.array(way("anchor_id", "duplicate_id"), way("duplicate_id", "anchor_id"))))
    if image_ids is not None:
        both = both.join(image_ids.select("image_id"), "image_id", "left_semi")
    return both if unique else both.groupBy("image_id", "other_id").agg(F.min("distance").alias("distance"))
