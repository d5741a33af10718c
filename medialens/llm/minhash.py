"""Near-duplicate detection by weighted minwise hashing of word shingles.

A text is the multiset of its five-word shingles. Its signature is a bag minhash: the multiplicities
are discretised to whole weights, the weight axis is cut into the blocks [0,1), [1,2), [2,4), [4,8), ...
and each shingle has, for each block, a Poisson process of points (time, component, weight). A text sees
the points whose weight is below the shingle's multiplicity; component i of its signature is the first time
of a point of component i. Two signatures agree in a component with the probability of the weighted Jaccard similarity.
Points come in order of time, so a shingle is done once its next point is later than the latest
component of its text: about n + m log m points for n shingles and m components instead of n m.

Bands of signatures bucket the texts; links are verified on the whole multisets; classes are the connected
components of the links. First each text of a bucket is compared with one member of it, then with another. Where a bucket
still holds several classes after that, all its pairs of different classes are compared: those of a small
bucket as pairs, those of a large one in blocks of two chunks of its texts, of which only links come out. No
link between classes is lost, no task holds more than two chunks, and a large group of like texts costs a comparison or two each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, cut, fresh, map_arrow, release_memory, ship, written
from medialens.llm.words import U64, Words, blocks, hash_words, mix, window_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 4: a pair of similarity 0.8 shares no band with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Buckets up to this size compare pairs; larger ones blocks of two chunks of about CHUNK texts.
SMALL_BUCKET = 24
CHUNK = 256
_FEATURES = 4096


def shingles_of(words: Words, n_rows: int, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles, repeated ones too. A text of fewer words than `size` has one, of them all."""
    counts = np.diff(words.first)
    rows, hashes = [], []
    h = window_hashes(words.hash, tuple(range(size)))
    if len(h):
        same = words.row[: len(h)] == words.row[size - 1 :]
        rows.append(words.row[: len(h)][same])
        hashes.append(h[same])
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            hashes.append(window_hashes(words.hash, tuple(range(k)))[words.first[short]] ^ U64(k))
            rows.append(short)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(rows), np.concatenate(hashes)


def bags_of(words: Words, n_rows: int, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, shingle, count): the distinct shingles of each text; keys are unique to text and shingle, and sorted."""
    rows, hashes = shingles_of(words, n_rows, size)
    keys, at, counts = np.unique(hashes ^ mix(rows.astype(U64) + U64(1)), return_index=True, return_counts=True)
    return keys, rows[at], hashes[at], counts


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper 53 bits."""
    return ((h >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(rows: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n_rows: int, components: int) -> np.ndarray:
    """Signatures (n_rows x components, times) of multisets; rows without shingles stay infinite."""
    best = np.full((n_rows, components), np.inf)
    # one entry for each block of the weight axis that the multiplicity reaches
    parts = [(rows, shingles, np.zeros(len(rows)), np.ones(len(rows)), counts)]
    low = 1
    while len(counts) and low < counts.max():
        more = counts > low
        parts.append((rows[more], mix(shingles[more] + U64(low)), np.full(more.sum(), float(low)), np.full(more.sum(), float(low)), counts[more]))
        low *= 2
    row, seed, floor, wide, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(row))
    flat = best.reshape(-1)
    done, chunk = 0, 1
    with np.errstate(over="ignore"):
        while len(row):
            step = np.arange(done + 1, done + chunk + 1).astype(U64) * U64(0x9E3779B97F4A7C15)
            h = mix(seed[:, None] + step[None, :])
            gaps = -np.log(_unit(h)) / (components * wide)[:, None]
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)
            g = mix(h ^ U64(0xD6E8FEB86659FD93))
            part = ((g >> U64(32)) * U64(components) >> U64(32)).astype(np.int64)
            level = floor[:, None] + wide[:, None] * ((g & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            seen = level < weight[:, None]
            np.minimum.at(flat, (row[:, None] * components + part)[seen], times[seen])
            latest = best.max(axis=1)
            time = times[:, -1]
            go = time < latest[row]
            row, seed, floor, wide, weight, time = row[go], seed[go], floor[go], wide[go], weight[go], time[go]
            done += chunk
            if done > 2:
                chunk *= 2
            chunk = min(chunk, 64)
    return best


def band_hashes(signature: np.ndarray, bands: int = BANDS, per_band: int = ROWS) -> np.ndarray:
    """Hash of each band of each signature (n x bands)."""
    bits = signature.view(U64).reshape(len(signature), bands, per_band)
    out = np.broadcast_to(np.arange(1, bands + 1).astype(U64) * U64(0xA24BAED4963EE407), (len(signature), bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(per_band):
            out = mix((out ^ bits[:, :, k]) * U64(0x9FB21C651E98DF25))
    return out


def similarity_of(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of two columns of texts, row by row; 0 without shingles."""
    n = len(left)
    ka, ra, _, ca = bags_of(hash_words(left), n)
    kb, rb, _, cb = bags_of(hash_words(right), n)
    both = np.zeros(n)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    np.add.at(both, ra[ia], np.minimum(ca[ia], cb[ib]))
    total = np.bincount(ra, ca, n) + np.bincount(rb, cb, n) - both
    return np.divide(both, total, out=np.zeros(n), where=total > 0)


def _bands(texts: DataFrame, bands: int, per_band: int) -> DataFrame:
    """band, id of (id, text): no shuffle; a text is signed once in each block that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                ids = part.column(0).dictionary_encode()
                _, at = np.unique(np.asarray(ids.indices), return_index=True)
                words = hash_words(part.column(1).take(pa.array(at)))
                _, rows, shingles, counts = bags_of(words, len(at))
                full = np.unique(rows)
                hashes = band_hashes(signatures(rows, shingles, counts, len(at), bands * per_band)[full], bands, per_band)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.reshape(-1).view(np.int64)), ids.dictionary.take(pa.array(np.repeat(full, bands)))], names=["band", "id"])

    return map_arrow(texts, run, "band bigint, id binary")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) of distinct pairs whose texts are at least so similar."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2, 2_000_000):
                linked = similarity_of(part.column(2), part.column(3)) >= threshold - 1e-12
                yield part.select(["a", "b"]).filter(pa.array(linked))

    return map_arrow(both, run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, class (its smallest node) of the nodes of (a, b) links; labels travel to neighbours and jump to
    their own label's label, so rounds grow with the logarithm of the longest chain."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("class").alias("heard"))
        step = labels.join(heard.hint("merge"), F.col("node") == F.col("a"), "left").select("node", F.col("class").alias("old"), F.least("class", F.coalesce("heard", "class")).alias("class"))
        up = labels.select(F.col("node").alias("class"), F.col("class").alias("up"))
        step = cut(step.join(up.hint("merge"), "class", "left").select("node", "old", F.least("class", F.coalesce("up", "class")).alias("class")))
        labels = step.select("node", "class")
        if step.filter("class <> old").isEmpty():
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: only links between classes are followed, on the graph of classes."""
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("class").alias(f"class_{side}"))
        links = links.join(named.hint("merge"), side, "left").withColumn(f"class_{side}", F.coalesce(f"class_{side}", side))
    merged = components(links.filter("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    named = merged.select(F.col("node").alias("class"), F.col("class").alias("root"))
    old = labels.join(named.hint("merge"), "class", "left").select("node", F.coalesce("root", "class").alias("class"))
    new = merged.join(labels.select("node").hint("merge"), "node", "left_anti").select("node", "class")
    return cut(old.unionByName(new))


def near_duplicate_labels(texts: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(node, class of all nodes that have a link; numbers) of (id, text); an id stands for one text, a node for an id.

    Nodes are 64-bit hashes of ids, unless two ids that share a bucket with others have the same one; then numbers (id, node)
    has nodes that are counted. Sides that are summed by bucket are written before they are joined, so that Spark can split a
    bucket which many texts are in.
    """
    rows = written(_bands(texts, bands, per_band).distinct(), "bands")
    full = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "full")
    rows = written(rows.join(full, "band", "left_semi"), "shared")
    ids = rows.select("id").distinct()
    numbers = None
    if not ids.groupBy(hash_of("id").alias("node")).count().filter("count > 1").isEmpty():
        numbers = written(ids.select("id", F.monotonically_increasing_id().alias("node")), "numbers")
    rows = with_node(rows, numbers).select("band", "node")
    known = written(with_node(texts, numbers).join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    low = rows.groupBy("band").agg(F.min("node").alias("low"))
    rows = written(rows.join(written(low, "lowest"), "band"), "buckets")
    return _labels(rows, known, threshold), numbers


def hash_of(name: str) -> Column:
    return F.xxhash64(name)


def with_node(df: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """df with the node of its id; null for ids that have no number."""
    return df.withColumn("node", hash_of("id")) if numbers is None else df.join(numbers, "id", "left")


def _labels(rows: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """node, class of the nodes of (band, node, low) that have a link."""
    tried = cut(rows.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(_verified(tried, known, threshold))

    rows = _open(rows, labels)
    leaders = rows.groupBy("band").agg(F.min_by(F.struct("node", "class"), F.xxhash64("node", "band")).alias("leader")).select("band", F.col("leader.node").alias("l_node"), F.col("leader.class").alias("l_class"))
    pairs = rows.join(written(leaders, "leaders"), "band").filter("class <> l_class").select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct()
    pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
    labels = _joined(labels, _verified(pairs, known, threshold))

    rows = _open(rows, labels)
    tried = tried.union(pairs)
    sizes = rows.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("main"))
    rows = cut(rows.join(written(sizes, "sizes"), "band"))
    small = rows.filter(F.col("n") <= SMALL_BUCKET)
    other = small.select("band", F.col("node").alias("b"), F.col("class").alias("b_class"))
    pairs = small.join(other, "band").filter("class < b_class").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    links = _verified(pairs.join(tried, ["a", "b"], "left_anti"), known, threshold)
    return _joined(labels, links.union(_block_links(rows.filter(F.col("n") > SMALL_BUCKET), known, threshold)))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, class of the buckets that still hold several classes."""
    named = rows.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("class", "node").alias("class"))
    several = named.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("band")
    return cut(named.join(written(several, "several"), "band", "left_semi"))


def _block_links(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different classes of large buckets.

    The texts outside a bucket's largest class are the rest. Chunks of the rest meet each other and
    the chunks of the largest class, which do not meet among themselves.
    """
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(CHUNK))).cast("int")
    n_main, n_rest = chunks(F.col("main.n")), chunks(F.col("n") - F.col("main.n"))
    is_main = F.col("class") == F.col("main.class")
    mine = F.pmod(F.xxhash64("node", "band"), F.when(is_main, n_main).otherwise(n_rest)).cast("int")
    blocks_of = F.when(
        F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda j: F.struct(F.lit(True).alias("with_main"), F.col("mine").alias("i"), j.alias("j")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda i: F.struct(F.lit(True).alias("with_main"), i.alias("i"), F.col("mine").alias("j"))),
            F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda j: F.struct(F.lit(False).alias("with_main"), F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"))),
        )
    )
    dealt = rows.select("band", "node", "class", is_main.alias("is_main"), n_main.alias("n_main"), n_rest.alias("n_rest"), mine.alias("mine"))
    dealt = dealt.select("band", "node", "class", "is_main", F.explode(blocks_of).alias("block")).select("band", "block.*", "node", "class", "is_main")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, classes, main = (np.asarray(table[c]) for c in ("node", "class", "is_main"))
        crosswise = main.any()
        both, total = overlaps(table["text"].combine_chunks())
        similar = both >= (threshold - 1e-12) * (total[:, None] + total[None, :] - both)
        similar &= classes[:, None] != classes[None, :]
        if crosswise:
            similar &= main[:, None] != main[None, :]
        i, j = np.nonzero(np.triu(similar, 1) & (both > 0))
        release_memory()
        return pa.table({"a": nodes[i], "b": nodes[j]})

    ship(rows.sparkSession)
    return dealt.join(texts, "node").groupBy("band", "with_main", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def overlaps(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the intersections of all pairs of shingle multisets, sizes of the multisets)."""
    n = len(texts)
    _, row, shingle, count = bags_of(hash_words(texts), n)
    total = np.bincount(row, count, n)
    # occurrence k of a shingle is a feature of its own; one that a single text has adds to no intersection
    again = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(again)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        names, feature, times = np.unique(mix(shingle[again] + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    shared = times > 1
    index = np.cumsum(shared) - 1
    keep = shared[feature]
    feature, owner = index[feature[keep]], row[again[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    for low in range(0, int(shared.sum()), _FEATURES):
        a, b = np.searchsorted(feature, [low, low + _FEATURES])
        x = np.zeros((n, _FEATURES), np.float32)
        x[owner[a:b], feature[a:b] - low] = 1.0
        both += x @ x.T
    return both.astype(np.float64), total


def text_id(text: str) -> Column:
    """128 bits that tell texts apart; null for null."""
    return F.unhex(F.md5(col(text)))


def _classes(df: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """id, keeper (struct of doc_id and id), n_docs of the texts of df."""
    labels, numbers = near_duplicate_labels(df.select(text_id(text).alias("id"), col(text).alias("text")).filter("text IS NOT NULL"), **options)
    docs = df.filter(col(text).isNotNull()).select(text_id(text).alias("id"), col(doc_id).alias("doc_id")).groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"))
    docs = with_node(docs.select("id", F.when(F.col("n_null") == 0, F.col("doc_id")).alias("doc_id"), "n"), numbers)
    docs = cut(docs.join(labels, "node", "left").select("id", "doc_id", "n", "class"))
    own = F.struct("doc_id", "id")
    best = docs.filter("class IS NOT NULL").groupBy("class").agg(F.min(own).alias("keeper"), F.sum("n").alias("n_docs"))
    return docs.join(written(best, "keepers"), "class", "left").select("id", F.coalesce("keeper", own).alias("keeper"), F.coalesce("n_docs", "n").alias("n_docs"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_docs (rows of the class) and kept for each row of df.

    class_id is the smallest doc_id of the class (null goes first); kept marks the rows with that id and text,
    so equal rows are kept or dropped together. Equal texts are one class. Texts without words link to
    nothing but their copies; null texts are classes of their own, kept. An empty table gives an empty result.
    Texts are told apart by 128-bit hashes. Options: threshold, bands, per_band.
    """
    classes = _classes(df, doc_id, text, **options)
    rows = df.select(col(doc_id).alias("doc_id"), text_id(text).alias("row_id"), col(text).isNull().alias("no_text"))
    both = rows.join(classes, F.col("row_id") == F.col("id"), "left")
    kept = F.col("no_text") | (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("row_id") == F.col("keeper.id")))
    return both.select("doc_id", F.when(F.col("no_text"), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"), F.coalesce("n_docs", F.lit(1)).alias("n_docs"), kept.alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, all columns as they were: the one near_duplicates() keeps; of equal rows one.

    Only the kept ids and hashes meet the rows' hashes; the texts of the rows shuffle once.
    """
    node, r_id, r_node, serial = fresh(df, "node", "r_id", "r_node", "serial")
    classes = _classes(df, doc_id, text, **options)
    keepers = classes.select("keeper").distinct().select(F.col("keeper.doc_id").alias(r_id), F.col("keeper.id").alias(r_node))
    rows = df.withColumn(node, text_id(text))
    kept = rows.join(keepers, (F.col(node) == F.col(r_node)) & col(doc_id).eqNullSafe(F.col(r_id)) & col(text).isNotNull(), "left")
    kept = kept.filter(F.col(r_node).isNotNull() | col(text).isNull())
    again = df.filter(col(text).isNotNull()).groupBy(text_id(text).alias(r_node), col(doc_id).alias(r_id)).count().filter("count > 1").drop("count")
    if again.isEmpty():
        return kept.select(*[col(c) for c in df.columns])
    once = kept.withColumn(serial, F.when(col(text).isNull(), F.monotonically_increasing_id()))
    return once.dropDuplicates([doc_id, node, serial]).select(*[col(c) for c in df.columns])
