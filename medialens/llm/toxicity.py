"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, back off from pairs of words to words, to stems (the first eight
down to four bytes of a word) and at last to one distribution that both share. How an expression spreads
over its longer forms is also shared: by continuation counts, in how many different contexts it stands in the
whole corpus. They are a written table of all words and stems of all documents, which grows with the corpus.
Expressions that the labelled rows hold too rarely are read by their stem in both models: without counts of the
classes their shared counts cancel out in the ratio. A text's score comes from its length-normalised log-likelihood ratios, over all of it and
over its most toxic window, through a logistic fit on labelled rows that the counts never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, map_arrow, written
from medialens.llm.words import U64, Words, blocks, hash_words, mix

#: Bytes of the stems, from short to long; a shorter word is its own stem.
STEMS = (4, 5, 6, 7, 8)
#: Levels of expressions: the stems, words, pairs of words.
WORD, PAIR = len(STEMS), len(STEMS) + 1
#: Most labelled rows that are learned from; of more, those with the lowest hashes are (about) taken.
MAX_LABELLED = 20_000
#: An expression is kept if the labelled rows hold it so often; rarer ones use the shared counts alone.
MIN_COUNT = 5
DISCOUNT = 0.75
WINDOW = 16
FOLDS = 5
#: Share of the labelled rows, one in so many, that fits the logistic curve instead of the counts.
CURVE_ONE_IN = 5
_REGISTERS = 16
_TOTAL_REGISTERS = 1 << 12
#: Most cells of registers that a task holds before it sends them on.
_HELD_CELLS = 2_000_000


def words_of(texts: pa.Array) -> Words:
    return hash_words(texts, prefixes=STEMS)


def keys_of(words: Words, level: int) -> np.ndarray:
    """Key of each word at a level below pairs."""
    return mix((words.hash if level == WORD else words.prefix[STEMS[level]]) + U64(level + 1))


def pairs_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the second word, key of the pair) for adjacent words of one text."""
    h = words.hash
    at = np.flatnonzero(words.row[1:] == words.row[:-1]) + 1 if len(h) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return at, mix(h[at - 1] * U64(0x9FB21C651E98DF25) + h[at])


@dataclass
class Model:
    """Log-likelihood ratios of known expressions, and the curve. `unknown` has the ratio of a word of which no
    stem is known, and `missing` what each level adds when only the levels below it are known. Sizes are
    bounded by the labelled rows' words over MIN_COUNT."""

    keys: list[np.ndarray]
    ratios: list[np.ndarray]
    missing: list[float]
    context_ratio: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def word_ratios(self, words: Words) -> np.ndarray:
        n = len(words.hash)
        ratio, rest, added = np.zeros(n), np.arange(n), 0.0
        context = np.zeros(n)
        for level in range(WORD, -1, -1):
            slot, known = find(self.keys[level], keys_of(words, level)[rest])
            ratio[rest[known]] = self.ratios[level][slot[known]] + added
            if level == WORD:
                context[known] = self.context_ratio[slot[known]]
            rest = rest[~known]
            added += self.missing[level]
        ratio[rest] = added
        at, pair = pairs_of(words)
        ratio[at] += context[at - 1]
        slot, known = find(self.keys[PAIR], pair)
        ratio[at[known]] = self.ratios[PAIR][slot[known]]
        return ratio

    def features(self, words: Words, n_rows: int) -> np.ndarray:
        """Of each text: mean ratio, best window's mean ratio, log of the number of words."""
        out = np.zeros((n_rows, 3))
        n = len(words.hash)
        if not n:
            return out
        sums = np.concatenate([[0.0], np.cumsum(self.word_ratios(words))])
        counts = np.diff(words.first)
        some = counts > 0
        out[some, 0] = (sums[words.first[1:]] - sums[words.first[:-1]])[some] / counts[some]
        # windows start at every word and end with the text at the latest; all are taken as of WINDOW words
        end = np.minimum(np.arange(n) + WINDOW, words.first[words.row + 1])
        out[some, 1] = np.maximum.reduceat((sums[end] - sums[:-1]) / WINDOW, words.first[:-1][some])
        out[:, 2] = np.log1p(counts)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.curve):
            return np.zeros(len(features))
        z = np.column_stack([np.ones(len(features)), (features - self.center) / self.scale]) @ self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = np.searchsorted(table, keys)
    slot[slot == len(table)] = 0
    return slot, table[slot] == keys


def _labelled(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_labelled: int) -> DataFrame:
    """text, toxic, for_curve of the labelled rows outside the held-out fold."""
    known = labels.select(col(doc_id).alias("l_id"), col(label).alias("toxic")).filter("l_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.filter(held_out_fold("l_id") != 0).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    order = F.xxhash64("l_id", F.lit("toxicity"))
    share = min(1.0, max_labelled / max(n, 1))
    known = known.withColumn("draw", (F.shiftrightunsigned(order, 11).cast("double") * F.lit(2.0**-53)))
    known = known.filter(F.col("draw") < share)
    rows = df.select(col(doc_id).alias("doc_id"), col(text).alias("text")).filter("text IS NOT NULL")
    side = F.broadcast(known) if max_labelled <= 100_000 else known
    return rows.join(side, F.col("doc_id") == F.col("l_id")).select("text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("l_id"), F.lit(CURVE_ONE_IN)) == 0).alias("for_curve"))


def held_out_fold(doc_id: str):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS))


def _class_counts(labelled: DataFrame) -> DataFrame:
    """level (-1: the total), key, parent (key one level below), context (key of a pair's first word), ordinary
    and toxic (long) over the labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0, 3_000_000):
                words = words_of(part.column(0))
                toxic = np.asarray(part.column(1)).astype(bool)[words.row]
                at, pairs = pairs_of(words)
                none = np.zeros(len(words.hash), U64)
                below = [keys_of(words, k) for k in range(WORD + 1)]
                levels = [(-1, none, none, none, toxic)] + [(k, below[k], below[k - 1] if k else none, none, toxic) for k in range(WORD + 1)]
                levels.append((PAIR, pairs, below[WORD][at], below[WORD][at - 1], toxic[at]))
                for level, keys, parents, contexts, of in levels:
                    names, first, back = np.unique(keys, return_index=True, return_inverse=True)
                    counts = [np.bincount(back[m], minlength=len(names)) for m in (~of, of)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), level, np.int32)), *[pa.array(x.view(np.int64)) for x in (names, parents[first], contexts[first])], *[pa.array(c.astype(np.int64)) for c in counts]], names=["level", "key", "parent", "context", "ordinary", "toxic"])

    counted = map_arrow(labelled.select("text", "toxic"), run, "level int, key bigint, parent bigint, context bigint, ordinary bigint, toxic bigint")
    return counted.groupBy("level", "key").agg(F.min("parent").alias("parent"), F.min("context").alias("context"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _rank(h: np.ndarray) -> np.ndarray:
    """Position of the first one bit among the upper 40."""
    return np.minimum(40, 41 - np.frexp((h >> U64(24)).astype(np.float64))[1]).astype(np.uint8)


def _highest(key: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Where the highest rank of each key and register stands; by key, then register. A cell has a rank in its lower 8 bits
    and its register above."""
    order = np.lexsort((cells, key))
    k, s = key[order], cells[order] >> cells.dtype.type(8)
    return order[np.append((k[1:] != k[:-1]) | (s[1:] != s[:-1]), True)] if len(order) else order


@dataclass
class Sketch:
    """Different words, their hashes, and the cells of the registers that each fills: counts[i] cells for word i, in order."""

    names: pa.Array
    hash: np.ndarray
    counts: np.ndarray
    cells: np.ndarray

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of (word, registers), registers and ranks in pairs of bytes. Words stand in order, so that they compress well."""
        ends = np.concatenate([[0], np.cumsum(self.counts)]) * 2
        packed = pa.Array.from_buffers(pa.large_binary(), len(self.names), [None, pa.py_buffer(ends), pa.py_buffer(self.cells.astype(">u2"))])
        rows = pa.RecordBatch.from_arrays([self.names, packed.cast(pa.binary())], names=["word", "registers"]).sort_by("word")
        for at in range(0, rows.num_rows, 50_000):
            yield rows.slice(at, 50_000)


def _best(names: pa.Array, of: np.ndarray, key: np.ndarray, cells: np.ndarray) -> Sketch:
    """Sketch of the highest cells; cell i belongs to the word names[of[i]], whose hash is key[i]."""
    best = _highest(key, cells)
    key, of, cells = key[best], of[best], cells[best]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return Sketch(names.take(pa.array(of[first])), key[first], np.diff(np.append(first, len(key))), cells)


def _sketch(texts: pa.Array, totals: np.ndarray) -> Sketch | None:
    """Sketch of the words before each word that follows another; all pairs fill the registers of totals."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = hash_words(lower, lower=False)
    at, pairs = pairs_of(words)
    if not len(at):
        return None
    np.maximum.at(totals, (pairs & U64(len(totals) - 1)).astype(np.int64), _rank(pairs))
    before = mix(words.hash[at - 1] + U64(7))
    cells = ((before & U64(_REGISTERS - 1)) << U64(8)).astype(np.uint16) | _rank(before)
    # words and the gaps after them in turn, over the buffer that the texts share
    borders = np.stack([words.start, words.end], 1).ravel()
    begin = np.frombuffer(lower.buffers()[1], np.int64, count=1, offset=lower.offset * 8)[0]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), lower.buffers()[2].slice(begin)])
    found = _best(pieces, 2 * at, words.hash[at], cells)
    found.names = found.names.cast(pa.binary())
    return found


def _joined(parts: list[Sketch]) -> Sketch:
    """One sketch with the words of all parts."""
    names, key = pa.concat_arrays([p.names for p in parts]), np.concatenate([p.hash for p in parts])
    of = np.repeat(np.arange(len(key)), np.concatenate([p.counts for p in parts]))
    return _best(names, of, key[of], np.concatenate([p.cells for p in parts]))


def _merge(names: pa.Array, packed: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, keys, estimated counts) from the rows of sketches that have the same stems."""
    total = np.asarray(pc.equal(pc.binary_length(names), 0))
    if total.any():
        registers = np.zeros((1, _TOTAL_REGISTERS), np.uint8)
        for raw in packed.filter(pa.array(total)):
            slot, rank = np.frombuffer(raw.as_buffer(), np.uint16).reshape(-1, 2).T
            np.maximum.at(registers[0], slot, rank.astype(np.uint8))
        yield -1, np.zeros(1, U64), estimate(registers)
    names, packed = names.filter(pa.array(~total)), packed.filter(pa.array(~total))
    if not len(names):
        return
    words = words_of(names)
    of = np.repeat(np.arange(len(names)), np.asarray(pc.binary_length(packed)) // 2)
    cells = np.frombuffer(b"".join(packed.to_pylist()), ">u2").astype(np.uint16)
    for level in range(WORD, -1, -1):
        # what stands before a longer form also stands before its stem, so each level goes on from what the last one left
        key = keys_of(words, level)[of]
        best = _highest(key, cells)
        key, of, cells = key[best], of[best], cells[best]
        first = np.append(True, key[1:] != key[:-1])
        registers = np.zeros((int(first.sum()), _REGISTERS), np.uint8)
        registers[np.cumsum(first) - 1, cells >> 8] = cells & 255
        yield level, key[first], estimate(registers)


def estimate(registers: np.ndarray) -> np.ndarray:
    """Distinct counts from rows of registers, with linear counting while few are used."""
    m = registers.shape[1]
    alpha = 0.673 if m == 16 else 0.7213 / (1 + 1.079 / m)
    raw = alpha * m * m / np.sum(2.0 ** -registers.astype(np.float64), axis=1)
    empty = (registers == 0).sum(axis=1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


def continuation_counts(texts: DataFrame) -> DataFrame:
    """level, key, stands of all words and stems of all texts: in how many contexts they stand, estimated from registers.
    Level -1 has the number of different pairs, if there are any.

    A task sends a row for each of its different words (again each time it holds _HELD_CELLS cells, so that its memory is bounded), so
    a frequent one is as light as others. All forms of a word meet by its shortest stem: one shuffle serves all levels.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held = np.zeros(_TOTAL_REGISTERS, np.uint8), []
        for batch in batches:
            for part in blocks(batch, 0):
                held += [found] if (found := _sketch(part.column(0), totals)) else []
                if sum(len(p.cells) for p in held) > _HELD_CELLS:
                    held = [_joined(held)]
                    if len(held[0].cells) > _HELD_CELLS // 2:
                        yield from held.pop().batches()
        if held:
            yield from _joined(held).batches()
        filled = np.flatnonzero(totals)
        if len(filled):
            packed = np.stack([filled.astype(np.uint16), totals[filled].astype(np.uint16)], 1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([packed], pa.binary())], names=["word", "registers"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("word", pa.binary()), ("registers", pa.binary())])).combine_chunks()
        if len(rows):
            for level, key, stands in _merge(rows["word"].combine_chunks().cast(pa.string()), rows["registers"].combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64)), pa.array(stands)], names=["level", "key", "stands"])

    filled = map_arrow(texts, gather, "word binary, registers binary")
    # in proportion to the input, so that what a task holds is bounded
    n = max(48, 4 * texts.rdd.getNumPartitions())
    return map_arrow(filled.repartition(n, F.substring("word", 1, STEMS[0])), merge, "level int, key bigint, stands double")


def _model(keys: list[np.ndarray], counts: list[np.ndarray], parents: list[np.ndarray], contexts: np.ndarray, totals: np.ndarray, stands: list[np.ndarray], pairs: float) -> Model:
    """Model from counts (columns: ordinary, toxic) of known expressions by level, slots of their parents, and shared counts."""
    totals = np.maximum(totals, 1.0)
    ratio = lambda p: np.log(p[:, 1] / p[:, 0]) if len(p) else np.zeros(0)
    below, missing, ratios, p = np.ones((1, 2)), [], [], None
    for level in range(WORD + 1):
        kept = np.maximum(counts[level] - DISCOUNT, 0.0)
        spare = np.maximum(1.0 - kept.sum(axis=0) / totals, 1e-6)
        if level:
            share = np.minimum(1.0, np.maximum(stands[level], 0.5) / np.maximum(stands[level - 1][parents[level]], 0.5))
            below = p[parents[level]]
        else:
            share = np.maximum(stands[0], 0.5) / max(pairs, 1.0)
            below = np.ones((len(kept), 2))
        p = kept / totals + spare * below * share[:, None]
        ratios.append(ratio(p))
        missing.append(float(np.log(spare[1] / spare[0])))
    kept = np.maximum(counts[PAIR] - DISCOUNT, 0.0)
    seen = np.maximum(counts[WORD], 1.0)
    spent = np.stack([np.bincount(contexts, kept[:, c] / seen[contexts, c], len(seen)) for c in (0, 1)], 1) if len(kept) else np.zeros((len(seen), 2))
    back = np.clip(1.0 - spent, 1e-3, 1.0)
    bigram = kept / seen[contexts] + back[contexts] * p[parents[PAIR]]
    return Model(keys, [*ratios, ratio(bigram)], missing, ratio(back))


def _fit_curve(model: Model, features: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic fit by Newton steps with a small ridge."""
    model.center, model.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(features)), (features - model.center) / model.scale])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ beta)
        beta += step if np.abs(step).max() < 5 else step * (5 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    model.curve = beta


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Model from the labelled rows outside the held-out fold and the continuation counts of all texts.

    Labels other than 0 and 1 are left out; of several labels of a doc_id the larger counts. Without labelled
    rows of both classes every score is 0.
    """
    labelled = written(_labelled(df, labels, doc_id, text, label, max_labelled), "labelled")
    shared = written(continuation_counts(df.select(col(text).alias("text"))), "contexts")
    kept = _class_counts(labelled.filter("NOT for_curve")).filter((F.col("level") < 0) | (F.col("ordinary") + F.col("toxic") >= MIN_COUNT))
    # an expression that only begins texts stands in no context
    found = kept.join(shared, ["level", "key"], "left").fillna(0.0, ["stands"]).toArrow()
    level, key, contexts_of = np.asarray(found["level"]), np.asarray(found["key"]).view(U64), np.asarray(found["stands"])
    both = np.stack([np.asarray(found[c]).astype(np.float64) for c in ("ordinary", "toxic")], 1)
    up = {c: np.asarray(found[c]).view(U64) for c in ("parent", "context")}
    totals, pairs = both[level < 0].sum(axis=0), float(contexts_of[level < 0].sum())
    keys, counts, parents, stands, contexts = [], [], [], [], np.zeros(0, np.int64)
    for k in range(PAIR + 1):
        at = np.flatnonzero(level == k)
        at = at[np.argsort(key[at])]
        # what an expression is made of is held as often as it, so it is kept too
        parents.append(find(keys[k - 1], up["parent"][at])[0] if k else np.zeros(len(at), np.int64))
        if k == PAIR:
            contexts = find(keys[WORD], up["context"][at])[0]
        keys.append(key[at])
        counts.append(both[at])
        stands.append(contexts_of[at])
    model = _model(keys, counts, parents, contexts, totals, stands, pairs)
    seen, toxic = _curve_rows(labelled.filter("for_curve"), model)
    if totals.min() > 0 and 0 < toxic.sum() < len(toxic):
        _fit_curve(model, seen, toxic)
    return model


def _curve_rows(labelled: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0):
                f = model.features(words_of(part.column(0)), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(1), *[pa.array(f[:, j]) for j in range(3)]], names=["toxic", "f0", "f1", "f2"])

    got = map_arrow(labelled.select("text", "toxic"), run, "toxic int, f0 double, f1 double, f2 double").orderBy("f0", "f1", "f2").toArrow()
    return np.stack([np.asarray(got[f"f{j}"]) for j in range(3)], 1), np.asarray(got["toxic"]).astype(np.float64)


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (int) of each row of df; one pass, no shuffle.

    Null and empty texts are texts of no words and get the score of such; repeated rows get equal scores; texts of any
    length are scored whole; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                s = model.scores(model.features(words_of(part.column(2)), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = df.select(col(doc_id).alias("doc_id"), col(text).alias("text")).select("doc_id", (held_out_fold("doc_id") == 0).alias("held_out"), "text")
    return map_arrow(rows, run, f"doc_id {rows.dtypes[0][1]}, held_out boolean, score double, predicted int")
