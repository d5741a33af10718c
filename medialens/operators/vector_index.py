"""Nearest neighbours through an index of coarse centroids, in front of the exact product.

Equal vectors are one entry, so copies make no pairs. Each entry is listed under its nearest centroid. A query looks into those
lists only that can hold a neighbour (their radius is known, and angles obey the triangle inequality), nearest first, and of
these into as many as a sample of queries needed for the wanted recall. What it meets there is compared exactly, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.frames import ship
from medialens.operators.clusters import BLOCK, DIGITS, SPREAD, TILE, nearest
from medialens.operators.graph import stored

#: Centroids are fitted to so many entries at most (those with the smallest hashes); there are as many as the root of all entries, up to a limit.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 16_384, 4096, 6
#: So many sampled entries ask all others, to find how many lists the wanted recall takes.
PROBED = 256
#: Angles give way by this much for rounding.
SLACK = 1e-6


@dataclass
class Index:
    """entries: rep (smallest id of equal vectors), v, list, angle (to the list's centroid); radii and sizes of the lists; probes: lists a query looks into at most."""

    entries: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    probes: int


def fit_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` unit vectors, by rounds of assignment and means; they begin with evenly spaced rows of the sample."""
    centroids = sample[np.unique(np.linspace(0, len(sample) - 1, count).astype(int))]
    for _ in range(ROUNDS):
        near = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        sizes = np.linalg.norm(sums, axis=1)
        centroids = np.where(sizes[:, None] > 1e-9, sums / np.maximum(sizes, 1e-9)[:, None], centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _angles(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centroids.T, -1, 1))


def _lists_of(angles: np.ndarray, radii: np.ndarray, reach: float, probes: int) -> list[np.ndarray]:
    """For each query, the lists that can hold a neighbour within the angle `reach`, nearest first, `probes` at most."""
    order = np.argsort(angles, axis=1, kind="stable")
    fits = angles - radii <= reach + SLACK
    return [row[fits[i, row]][:probes] for i, row in enumerate(order)]


def build(units: DataFrame, k: int, threshold: float, recall: float = 0.95) -> Index:
    """The index of units (id, v of length 1). `recall` is the share of the neighbours at or above the threshold (of the up to k nearest) that
    the sampled queries must find; 1 looks into every list that can hold one, which loses nothing."""
    spark = units.sparkSession
    ship(spark)
    kind = units.schema["id"].dataType.simpleString()
    distinct = stored(units.groupBy("v").agg(F.min("id").alias("rep")).select("rep", "v"))
    count = distinct.count()
    rows = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("v").collect()
    sample = np.array([r.v for r in rows]) if rows else np.zeros((1, 1))
    centroids = fit_centroids(sample, int(min(MAX_LISTS, max(1, round(count**0.5)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(batch["v"]), centroids) if batch.num_rows else np.zeros((0, 1))
            near = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["v"], pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near])], names=["rep", "v", "list", "angle"])

    entries = stored(distinct.mapInArrow(assign, f"rep {kind}, v array<double>, list int, angle double"))
    radii, sizes = np.full(len(centroids), -np.inf), np.zeros(len(centroids), np.int64)
    for r in entries.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["list"]], sizes[r["list"]] = r.radius, r.n
    index = Index(entries, centroids, radii, sizes, len(centroids))
    if recall < 1:
        index.probes = _probes_for(index, sample[:PROBED], k, threshold, recall)
    return index


def _probes_for(index: Index, queries: np.ndarray, k: int, threshold: float, recall: float) -> int:
    """How many lists the queries must look into for so large a share of their neighbours, all entries being compared with them."""
    centroids, radii = index.centroids, index.radii

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch["v"]) @ queries.T if batch.num_rows else np.zeros((0, len(queries)))
            top = np.argsort(-near, axis=0, kind="stable")[: k + 1]
            query = np.broadcast_to(np.arange(len(queries)), top.shape)
            good = near[top, query] >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(query[good], pa.int32()), pa.array(near[top, query][good]), pa.array(np.asarray(batch["list"])[top[good]], pa.int32())], names=["query", "similarity", "list"])

    found = index.entries.mapInArrow(nearest, "query int, similarity double, list int")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "list")
    rows = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("query", "list").agg(F.count(F.lit(1)).alias("n")).collect()
    lists = _lists_of(_angles(queries, centroids), radii, float(np.arccos(np.clip(threshold, -1, 1))), len(centroids))
    need = np.repeat([int(np.flatnonzero(lists[r["query"]] == r["list"])[0]) + 1 for r in rows], [r.n for r in rows]) if rows else np.array([1])
    return int(np.quantile(need, recall, method="higher"))


def _room(index: Index, block: int) -> int:
    """Entries of one side of a tile."""
    return min(TILE, max(block, -(-int(index.sizes.sum()) // SPREAD)))


def _bundles(index: Index, room: int) -> np.ndarray:
    """For each list, the bundle that it is in: lists with near centroids, together about `room` entries or one larger list."""
    some = index.centroids[:: max(1, int(len(index.centroids) ** 0.5))]
    order = np.argsort((index.centroids @ some.T).argmax(1), kind="stable")
    starts = np.cumsum(index.sizes[order]) - index.sizes[order]
    bundle = np.empty(len(order), np.int32)
    bundle[order] = np.unique(starts // room, return_inverse=True)[1]
    return bundle


def _asked(index: Index, threshold: float, bundle: np.ndarray) -> DataFrame:
    """rep, v, bundle, lists: each entry, once for each bundle that holds lists which it looks into."""
    centroids, radii, probes = index.centroids, index.radii, index.probes
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    kind = index.entries.schema["rep"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                lists = _lists_of(_angles(_matrix(some["v"]), centroids), radii, reach, probes)
                row, of = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
                order = np.lexsort((of, bundle[of], row))
                row, of = row[order], of[order]
                starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (bundle[of[1:]] != bundle[of[:-1]])]))
                nested = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(of, pa.int32()))
                mine = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([some["rep"].take(mine), some["v"].take(mine), pa.array(bundle[of[starts]], pa.int32()), nested], names=["rep", "v", "bundle", "lists"])

    return index.entries.select("rep", "v").mapInArrow(probe, f"rep {kind}, v array<double>, bundle int, lists array<int>")


def _met(index: Index, threshold: float, block: int) -> DataFrame:
    """bundle, i, j, asks, rep, v, lists: the entries of each bundle of lists and those that look into some of them, in tiles of bounded size. An entry asks once for each bundle, not for each list."""
    room = _room(index, block)
    bundle = _bundles(index, room)
    asked = stored(_asked(index, threshold, bundle))
    number = F.element_at(F.array(*[F.lit(int(x)) for x in bundle]), F.col("list") + 1)
    held = index.entries.select("rep", "v", F.array("list").alias("lists"), number.alias("bundle"))
    parts = lambda rows, name: rows.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias(name))
    shape = F.broadcast(parts(held, "rows").join(parts(asked, "columns"), "bundle"))  # a row for each bundle, of which there are no more than lists
    mine = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = held.join(shape, "bundle").select("bundle", mine("rows", "held").alias("i"), every("columns").alias("j"), F.lit(False).alias("asks"), "rep", "v", "lists")
    return held.unionByName(asked.join(shape, "bundle").select("bundle", every("rows").alias("i"), mine("columns", "asks").alias("j"), F.lit(True).alias("asks"), "rep", "v", "lists"))


def compared_pairs(index: Index, threshold: float) -> int:
    """How many pairs of entries the index compares."""
    asks = _asked(index, threshold, np.zeros(len(index.sizes), np.int32)).select(F.explode("lists").alias("list")).groupBy("list").count().collect()
    return sum(int(index.sizes[r["list"]]) * r["count"] for r in asks)


def knn_edges(units: DataFrame, k: int = 20, threshold: float = 0.78, recall: float = 0.95, index: Index | None = None, block: int = BLOCK) -> DataFrame:
    """src, dst, similarity: the up to k nearest of each vector at or above the threshold, ties by id, as `clusters.knn_edges` has them, but for the share that the
    index may miss (none at recall 1). units: id, v of length 1, all of one length."""
    if k < 1:
        raise ValueError("an index needs k, else use clusters.knn_edges")
    index = index or build(units, k, threshold, recall)
    kind = units.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches)).sort_by("rep").combine_chunks()
        asks = tile["asks"].to_numpy()
        v, reps, lists = _matrix(tile["v"].combine_chunks()), tile["rep"].combine_chunks().dictionary_encode(), tile["lists"].combine_chunks()
        node = reps.indices.to_numpy()
        row, of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        order = np.argsort(of, kind="stable")
        row, cuts = row[order], np.flatnonzero(np.diff(of[order])) + 1

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for rows in np.split(row, cuts):
                left, right = rows[asks[rows]], rows[~asks[rows]]
                for lo in range(0, len(left), min(block, 512)):
                    some = left[lo : lo + min(block, 512)]
                    for at in range(0, len(right), block):
                        others = right[at : at + block]
                        s = (v[some] @ v[others].T).ravel()
                        near = np.flatnonzero(s >= threshold)
                        yield node[some[near // len(others)]], node[others[near % len(others)]], s[near]

        for a, b, s in nearest(found(), k + 1):
            yield pa.RecordBatch.from_arrays([reps.dictionary.take(pa.array(a)), reps.dictionary.take(pa.array(b)), pa.array(s)], names=["a", "b", "similarity"])

    found = _met(index, threshold, block).groupBy("bundle", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")
    nearer = F.desc(F.round("similarity", DIGITS))
    best = Window.partitionBy("a").orderBy(nearer, "b")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    # of each set of equal vectors the k + 1 smallest ids are enough for any k nearest but oneself
    members = stored(units.join(index.entries.select("rep", "v"), "v").select("id", "rep"))
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1).select(F.col("rep").alias("b"), F.col("id").alias("dst"))
    ranked = found.join(first, "b").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(nearer, "dst"))).filter(F.col("n") <= k + 1)
    answers = ranked.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "dst", "similarity"))).alias("near"))
    own = members.join(answers, members["rep"] == answers["a"]).select(F.col("id").alias("src"), F.explode(F.slice(F.filter("near", lambda x: x["dst"] != F.col("id")), 1, k)).alias("e"))
    return own.select("src", "e.dst", "e.similarity")
