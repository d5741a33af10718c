"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words; only the words at its ones are hashed, so a substituted word at a zero does not
hide a match. The windows of all training texts are hashed under each mask, once; those that a bitmap of the benchmark's seeds
does not rule out join the seeds of the items. Around each hit the two texts are compared word by word along the
diagonal (the place in the text less the place in the item), whose longest stretch with enough equal words decides. Items
shorter than a stretch are compared as a whole and have masks of their own, each of which ignores a part of the item.

The bitmap has a fixed largest size, so a benchmark of any size is one pass over the corpus: the larger it is, the more seeds
the join has to sort out. Seeds meet as one row for each text, item and hash with the places of both, so texts and items that
repeat themselves make no products.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import BROADCAST_ROWS, col, fresh, map_arrow, within_rows, written
from medialens.llm.words import U64, Words, blocks, hash_words, mix

#: A stretch counts from so many words (or the whole item, if that is shorter) ...
MIN_OVERLAP = 13
#: ... of which so many in a hundred are equal.
MIN_PERCENT = 80
#: Fixed values, found by search: each hashes eight words and ignores others, and every stretch that counts has one of them in some
#: place, wherever its changed words are. It is enough that they fit all stretches of 13 to 25 words: a longer one has such a part.
MASKS = ("1011011111", "111111011", "11100001010111", "110111000111", "1100111111", "11101011011", "11010001001111", "1101110001011", "10100101101011", "11110011011", "1111010000111")
#: A whole item is cut into so many parts; a mask ignores as many of them as words may be changed.
PARTS = 5
#: Words of benchmark items that one text is compared with at a time.
BLOCK_WORDS = 250_000
#: Words that are compared at a time.
CELLS = 1 << 20
#: Bits of the bitmap for each seed, of which each has two, and the logarithm of its largest size: 64 MB.
BITS_PER_SEED, MAX_BITMAP = 64, 29
#: Odd factors for the first, second, ... word of a seed.
FACTORS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) + 0x2545F4914F6CDD1C * k) % 2**64 | 1 for k in range(MIN_OVERLAP))


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def whole_masks(n: int, percent: int = MIN_PERCENT) -> list[tuple[int, ...]]:
    """The words that each mask of an item of n words keeps: whatever words are changed, if not too many, one mask ignores them all."""
    changed = n * (100 - percent) // 100
    parts = np.array_split(np.arange(n), max(1, min(n, PARTS)))
    return [tuple(np.concatenate([parts[k] for k in kept]).tolist()) for kept in itertools.combinations(range(len(parts)), max(1, len(parts) - changed))]


def _kinds(shorter: tuple[int, ...]) -> list[tuple[int, tuple[int, ...], int, int]]:
    """(salt, offsets, words of the item or 0, place of the first word in it) of all masks and of whole items of so many words."""
    kinds = [(i + 1, _offsets(m), 0, 0) for i, m in enumerate(MASKS)]
    return kinds + [(1000 * n + i, tuple(k - kept[0] for k in kept), n, kept[0]) for n in shorter for i, kept in enumerate(whole_masks(n))]


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + U64(salt) * U64(0x9E3779B97F4A7C15))


def _by_hash(owner: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(owner, hash, list of places) of the distinct pairs of owner and hash."""
    order = np.lexsort((at, h, owner))
    owner, h, at = owner[order], h[order], at[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return owner[new], h[new], pa.ListArray.from_arrays(pa.array(np.append(new, len(h)).astype(np.int32)), pa.array(at.astype(np.int32)))


def longest_stretch(equal: np.ndarray, percent: int = MIN_PERCENT) -> tuple[int, int]:
    """Start and end of the longest stretch with at least `percent` equal words that starts and ends on equal ones."""
    if not equal.any():
        return 0, 0
    n = len(equal)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    # for each end, the first start from which the sum does not fall, then the first equal word from there on
    low, ends = np.minimum.accumulate(sums[:-1]), np.flatnonzero(equal) + 1
    following = np.minimum.accumulate(np.where(equal, np.arange(n), n)[::-1])[::-1]
    starts = following[np.searchsorted(-low, -sums[ends], "left")]
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


def reaching(equal: np.ndarray, need: int, percent: int = MIN_PERCENT) -> np.ndarray:
    """Which rows have `need` words or more in a row of which at least `percent` in a hundred are equal, whatever words these begin and end with."""
    sums = np.zeros((len(equal), equal.shape[1] + 1), np.int64)
    np.cumsum(np.where(equal, 100 - percent, -percent), axis=1, out=sums[:, 1:])
    return (sums[:, need:] >= np.minimum.accumulate(sums, axis=1)[:, : sums.shape[1] - need]).any(1)


def best_overlap(text: np.ndarray, item: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray]], min_overlap: int = MIN_OVERLAP, percent: int = MIN_PERCENT) -> tuple[int, int, int, int] | None:
    """(equal words, words of the stretch, its start in the text, its start in the item) of the stretch with most equal
    words (then the first) on the diagonals of the hits (places in the text, places in the item); None if none counts.

    A stretch is min_overlap words of the item, or all it has, with enough equal ones; words beyond the ends of the text are changed ones. It is
    reported from its first to its last equal word. All diagonals are tried in blocks, and those that count are measured until none left has as many equal words.
    """
    size = len(item)
    marks = np.zeros(len(text) + 2 * size, bool)
    for places, own in hits:
        few, many, sign = (own, places, -1) if len(own) <= len(places) else (places, own, 1)
        for k in few.tolist():
            marks[(many - k if sign < 0 else k - many) + size] = True
    need, best = min(min_overlap, size), None
    other = next(U64(x) for x in range(size + 1) if U64(x) not in item)
    outside = np.full(size, other)
    along = np.lib.stride_tricks.sliding_window_view(np.concatenate([outside, text, outside]), size)
    starts, counts = np.flatnonzero(marks), []
    kept = []
    for at in range(0, len(starts), max(1, CELLS // size)):
        some = starts[at : at + max(1, CELLS // size)]
        equal = along[some] == item
        good = np.flatnonzero(reaching(equal, need, percent))
        kept.append(some[good])
        counts.append(equal[good].sum(1))
    kept, counts = np.concatenate(kept or [starts]), np.concatenate(counts or [starts])
    for k in np.lexsort((kept, -counts)).tolist():
        start = int(kept[k]) - size
        if best and (counts[k] < best[0] or counts[k] == best[0] and start > best[2] - best[3]):
            break
        a, b = longest_stretch(along[kept[k]] == item, percent)
        found = (int((along[kept[k]][a:b] == item[a:b]).sum()), b - a, start + a, a)
        if best is None or found[0] > best[0] or found[0] == best[0] and start < best[2] - best[3]:
            best = found
    return best


def _item_words(items: DataFrame) -> DataFrame:
    """item, words (hashes) of (item, text); items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                words = hash_words(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["item", "words"]).filter(pa.array(np.diff(words.first) > 0))

    return map_arrow(items, run, "item bigint, words array<bigint>")


def _item_seeds(items: DataFrame) -> DataFrame:
    """hash, item, i_at (places) of the seeds of (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                words = hash_words(part.column(1))
                sizes = np.diff(words.first)
                found, windows = [], _windows(words)
                for salt, offsets, n, lead in _kinds(tuple(np.unique(sizes[(sizes > 0) & (sizes < MIN_OVERLAP)]).tolist())):
                    h, at = windows(offsets)
                    row = words.row[at]
                    fits = (sizes[row] == n) & (at - words.first[row] == lead) if n else sizes[row] >= MIN_OVERLAP
                    found.append((row[fits], _salted(h[fits], salt), at[fits] - words.first[row[fits]]))
                owner, h, at = _by_hash(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(pa.array(owner)), at], names=["hash", "item", "i_at"])

    return map_arrow(items, run, "hash bigint, item bigint, i_at array<int>")


def _windows(words: Words):
    """A function from offsets to (hash, first word) of the windows that lie within one text. The words times each factor are made once."""
    with np.errstate(over="ignore"):
        times = [words.hash * U64(f) for f in FACTORS]

    def windows(offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(words.hash) - offsets[-1])
        h = np.zeros(n, U64)
        with np.errstate(over="ignore"):
            for k, o in enumerate(offsets):
                h += times[k][o : o + n]
        at = np.flatnonzero(words.row[:n] == words.row[offsets[-1] :])
        return h[at], at

    return windows


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bits of two remainders of each seed's hash by the size, which is a power of two that goes by the number of seeds up to a limit."""
    size = 1 << min(MAX_BITMAP, max(16, math.ceil(math.log2(BITS_PER_SEED * max(1, seeds.count())))))
    slots = F.array(F.col("hash").bitwiseAND(size - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(size - 1))
    slot = F.col("slot")
    parts = seeds.select(F.explode(slots).alias("slot")).groupBy(F.shiftright(slot, 15).alias("k")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for k, bits in parts.toLocalIterator():
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _text_seeds(rows: DataFrame, bitmap: np.ndarray, shorter: tuple[int, ...]) -> DataFrame:
    """hash, doc_id, text_key, d_at (places) of those seeds of (doc_id, text_key, text) that the bitmap does not rule out."""
    kinds, mask = _kinds(shorter), U64(len(bitmap) * 8 - 1)

    def there(h: np.ndarray) -> np.ndarray:
        slot = h & mask
        return (bitmap[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                words = hash_words(part.column(2))
                found, windows = [], _windows(words)
                for salt, offsets, _, _ in kinds:
                    h, at = windows(offsets)
                    h = _salted(h, salt)
                    near = np.flatnonzero(there(h))
                    near = near[there(h[near] >> U64(32))]
                    found.append((words.row[at[near]], h[near], at[near] - words.first[words.row[at[near]]]))
                owner, h, at = _by_hash(*(np.concatenate(x) for x in zip(*found, strict=True)))
                if len(h):
                    owner = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(owner), part.column(1).take(owner), at], names=["hash", "doc_id", "text_key", "d_at"])

    return map_arrow(rows, run, f"hash bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key bigint, d_at array<int>")


def leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_overlap: int = MIN_OVERLAP, percent: int = MIN_PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document row and item that it leaks: doc_id, item_id, n_equal, n_overlap, doc_start, item_start.

    Words are runs of letters and digits, in lower case. An item is leaked by a stretch of min_overlap words, or as many as it
    has, of which `percent` in a hundred agree along one alignment, down to items of one word; which words differ does not matter, and words that the
    text lacks at its ends count as different. Seeds miss nothing for the default numbers or higher ones. Starts count words; a
    stretch is reported from its first to its last equal word. Of several stretches of one item in a row the one with most equal words is
    reported (then the first). Null and empty texts leak nothing, nor do items without words; equal items are reported each;
    repeated rows each; an empty table on either side gives an empty result. Texts are read a second time only where
    seeds met; only those shuffle.
    """
    plain = [doc_id, text]
    rows = df.select(*[col(c).alias(a) for c, a in zip(plain, ("doc_id", "text"), strict=True)]).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = _leaks(rows, benchmark, item_id, item_text, min_overlap, percent, block_words)
    return found.select("doc_id", "item_id", "n_equal", "n_overlap", "doc_start", "item_start")


def _leaks(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, min_overlap: int, percent: int, block_words: int) -> DataFrame:
    """leaks() of (doc_id, text_key, text), with text_key."""
    items = benchmark.select(col(item_id).alias("item_id"), col(item_text).alias("text")).filter("text IS NOT NULL")
    items = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    words = written(_item_words(items.select("item", "text")), "item-words")
    seeds = written(_item_seeds(items.select("item", "text")), "item-seeds")
    sizes = words.groupBy(F.least(F.size("words"), F.lit(MIN_OVERLAP)).alias("n")).agg(F.sum(F.size("words")).alias("words")).collect()
    shorter = tuple(sorted(r["n"] for r in sizes if r["n"] < MIN_OVERLAP))
    chunks = -(-sum(r["words"] for r in sizes) // block_words) or 1

    met = _text_seeds(rows, _bitmap(seeds), shorter).join(seeds, "hash")
    pairs = met.groupBy("doc_id", "text_key", "item").agg(F.collect_list(F.struct("d_at", "i_at")).alias("hits"))
    named = pairs.join(words, "item").join(items.select("item", "item_id"), "item")
    # a text meets the items in chunks, so that one which leaks a large benchmark is no row of unbounded size
    packs = named.groupBy("doc_id", "text_key", F.pmod("item", F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("item_id", "words", "hits")).alias("items"))
    packs = written(packs.select(F.col("doc_id").alias("p_doc"), F.col("text_key").alias("p_key"), "items"), "candidates")
    same = (F.col("text_key") == F.col("p_key")) & F.col("doc_id").eqNullSafe(F.col("p_doc"))
    keys = packs.select("p_doc", "p_key").distinct()
    keys = F.broadcast(keys) if within_rows(keys, BROADCAST_ROWS) else keys
    both = rows.join(keys, same, "left_semi").join(packs, same).select("doc_id", "text_key", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                yield _verified(part, min_overlap, percent)

    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    return map_arrow(both, run, f"doc_id {kinds['doc_id']}, text_key bigint, item_id {kinds['item_id']}, n_equal bigint, n_overlap bigint, doc_start bigint, item_start bigint")


def _verified(part: pa.RecordBatch, min_overlap: int, percent: int) -> pa.RecordBatch:
    """Leaks among the candidates of (doc_id, text_key, text, items)."""
    texts, lists = hash_words(part.column(2)), part.column(3)
    items = lists.values
    ends, item_words, hits = np.asarray(lists.offsets), items.field("words"), items.field("hits")
    word_ends, word_values = np.asarray(item_words.offsets), np.asarray(item_words.values).view(U64)
    hit_ends, hit = np.asarray(hits.offsets), hits.values
    places = [(np.asarray(hit.field(c).offsets), np.asarray(hit.field(c).values)) for c in ("d_at", "i_at")]
    of, item, values = [], [], []
    for row in range(part.num_rows):
        text = texts.hash[texts.first[row] : texts.first[row + 1]]
        for k in range(ends[row], ends[row + 1]):
            met = [tuple(v[o[j] : o[j + 1]] for o, v in places) for j in range(hit_ends[k], hit_ends[k + 1])]
            best = best_overlap(text, word_values[word_ends[k] : word_ends[k + 1]], met, min_overlap, percent)
            if best:
                of.append(row)
                item.append(k)
                values.append(best)
    table = np.array(values, np.int64).reshape(-1, 4)
    at = pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), items.field("item_id").take(pa.array(item, pa.int64())), *[pa.array(table[:, j]) for j in range(4)]], names=["doc_id", "text_key", "item_id", "n_equal", "n_overlap", "doc_start", "item_start"])


def without_leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_overlap: int = MIN_OVERLAP, percent: int = MIN_PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of df that leak no item, all columns as they were. Same rules as leaks(); the leaking rows' keys are broadcast
    if they are few, else the texts shuffle once."""
    key, l_id, l_key = fresh(df, "key", "l_id", "l_key")
    rows = df.select(col(doc_id).alias("doc_id"), col(text).alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    bad = _leaks(rows, benchmark, item_id, item_text, min_overlap, percent, block_words)
    bad = written(bad.select(F.col("doc_id").alias(l_id), F.col("text_key").alias(l_key)).distinct(), "leaks")
    side = F.broadcast(bad) if within_rows(bad, BROADCAST_ROWS) else bad
    tagged = df.select(*[col(c) for c in df.columns], F.xxhash64(col(text)).alias(key))
    return tagged.join(side, (F.col(key) == F.col(l_key)) & col(doc_id).eqNullSafe(F.col(l_id)), "left_anti").select(*[col(c) for c in df.columns])
