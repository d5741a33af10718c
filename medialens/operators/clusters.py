"""Similarity clusters on the graph of nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.frames import ship
from medialens.functions.vectors import dot, l2_normalize, sum_by
from medialens.operators.graph import connected_components

#: Vectors of one side of a block of the similarity matrix.
BLOCK = 4096
#: Vectors of one side of a tile, whose blocks one task computes, at most; smaller tables are cut into SPREAD sets of a block or more each.
TILE, SPREAD = 32_768, 10
#: Digits that order similarities: equal vectors are equally near, whichever block they are in.
DIGITS = 12
#: Pairs that a tile holds before it lets go all but the k nearest of each vector.
PENDING = 1 << 20


def unit_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, v (normalized, double); rows without a direction are left out."""
    return df.select(F.col(id_col).alias("id"), l2_normalize(F.col(vec).cast("array<double>")).alias("v")).filter("v IS NOT NULL")


def raw_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, v (double) as they are, for heads that were fitted on such vectors; null and empty ones, and those with a null element, are left out."""
    v = F.col(vec).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))


def sets_of(n: int, block: int) -> int:
    """Into how many sets n vectors are cut, each of which meets all others: how often a vector is sent."""
    return max(1, -(-n // TILE), min(SPREAD, -(-n // block)))


def knn_edges(units: DataFrame, k: int = 20, threshold: float = 0.78, block: int = BLOCK) -> DataFrame:
    """src, dst, similarity: the up to k nearest of each vector at or above the threshold (all of them for k <= 0), ties by id.

    The similarity matrix is computed in blocks of two sets of at most `block` vectors, each by one matrix product that serves both directions. A task gets
    a tile of such blocks, of two sets of about TILE vectors at most, and sends on at most k neighbours a row, so neither the matrix nor a group grows with the
    input, and a vector is sent to a tile for each TILE vectors of the table.
    """
    kind = units.schema["id"].dataType.simpleString()
    ship(units.sparkSession)
    sets = sets_of(units.count(), block)
    # the id is hashed with a seed of its own, so sets are even whatever the ids are
    mine = units.withColumn("mine", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(sets)).cast("int"))
    asks = mine.select("id", "v", F.lit(0).alias("side"), F.col("mine").alias("i"), F.explode(F.sequence("mine", F.lit(sets - 1))).alias("j"))
    rows = asks.union(mine.select("id", "v", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), "mine")).alias("i"), F.col("mine").alias("j")))

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        ids = table["id"].combine_chunks().dictionary_encode()
        node, side = ids.indices.to_numpy(), table["side"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        mirrored = key[0].as_py() != key[1].as_py()

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for lo in range(0, len(left), min(block, 512)):
                some = left[lo : lo + min(block, 512)]
                for at in range(0, len(right), block):
                    others = right[at : at + block]
                    s = (v[some] @ v[others].T).ravel()
                    near = np.flatnonzero(s >= threshold)
                    a, b = node[some[near // len(others)]], node[others[near % len(others)]]
                    apart = a != b
                    a, b, s = a[apart], b[apart], s[near][apart]
                    yield (np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])) if mirrored else (a, b, s)

        for a, b, s in nearest(found(), k):
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(a)), ids.dictionary.take(pa.array(b)), pa.array(s)], names=["src", "dst", "similarity"])

    found = rows.groupBy("i", "j").applyInArrow(compare, f"src {kind}, dst {kind}, similarity double")
    if k <= 0:
        return found
    w = Window.partitionBy("src").orderBy(F.desc(F.round("similarity", DIGITS)), "dst")
    return found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def nearest(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (a, b, similarity) the k nearest of each a, ties by b; all as they come for k <= 0. Holds about PENDING pairs and k of each a."""

    def best(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, -np.round(s, DIGITS), a))
        a, b, s = a[order], b[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        return a[place < k], b[place < k], s[place < k]

    parts, kept, size = [], 0, 0
    for part in found:
        if not len(part[0]):
            continue
        if k <= 0:
            yield part
            continue
        parts.append(part)
        size += len(part[0])
        if size > PENDING + 2 * kept:
            parts = [best(parts)]
            size = kept = len(parts[0][0])
    if parts:
        yield best(parts)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src")))).distinct()


def clusters(units: DataFrame, edges: DataFrame, min_size: int = 3) -> DataFrame:
    """cluster_id (the smallest member), id of the components of at least min_size; single vectors count as components of one."""
    labels = connected_components(edges, "src", "dst")
    named = units.select("id").join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster_id"))
    sizes = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return named.join(sizes.select("cluster_id"), "cluster_id").select("cluster_id", "id")


def cluster_centers(members: DataFrame, units: DataFrame) -> DataFrame:
    """cluster_id, id, is_center, distance (1 - cosine to the center, 0 at least).

    The center has the largest sum of products with all members, ties to the smallest id. That sum is one product with the sum
    of the members' vectors, so a cluster of n costs n products.
    """
    rows = members.join(units, "id").select("cluster_id", "id", "v")
    total = sum_by(rows, ["cluster_id"], "v", "total").select("cluster_id", "total")
    scored = rows.join(total, "cluster_id").withColumn("closeness", F.round(dot(F.col("v"), F.col("total")), 9))
    center = scored.groupBy("cluster_id").agg(F.max("closeness").alias("closeness")).join(scored, ["cluster_id", "closeness"]).groupBy("cluster_id").agg(F.min(F.struct("id", "v")).alias("c"))
    both = rows.join(center, "cluster_id")
    return both.select("cluster_id", "id", (F.col("id") == F.col("c.id")).alias("is_center"), F.greatest(F.lit(0.0), 1.0 - dot(F.col("v"), F.col("c.v"))).alias("distance"))


def rolled_up(members: DataFrame) -> DataFrame:
    """Region clusters carried to their images: cluster_id, image_id, from_region (the last region of the image)."""
    image = F.substring_index("id", "#", 1)
    return members.groupBy("cluster_id", image.alias("image_id")).agg(F.max("id").alias("from_region"))
