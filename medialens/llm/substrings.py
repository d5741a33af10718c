"""Substring dedup by sliding sentence spans.

A text is cut into sentences: they end at `.`, `!`, `?` or a line's end between two words. Longer sentences than
`WINDOW` words are cut further: of any so many words in a row without a sentence's start, the one with the lowest hash
(the last of equals) starts a piece. All cuts depend on the words around them only, so a passage is cut alike wherever it
stands, also in the middle of a sentence, and no stretch of so many words goes without one. From each piece on, the shortest
run of at least `span` pieces and `min_words` words is hashed, and the shortest such run that ends with the text. Runs are
grouped by hash over the whole corpus; the first occurrence, by document and place, stays, and sentences that any other occurrence covers are removed.

Copies of a passage share a cut within its first WINDOW + 1 words, and all cuts from there on up to the last WINDOW words.
A run ends at most WINDOW - 1 words late, so every repeated passage of min_words + 3 * WINDOW - 1 = 50 words is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, fresh, map_arrow, map_arrow_rows, written
from medialens.llm.words import U64, Words, blocks, hash_words, mix, powers

SPAN = 3
MIN_WORDS = 24
#: Of so many words in a row one at least starts a piece.
WINDOW = 9
#: Taken off the places of runs that end with their text.
LAST = 1 << 31

_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True


class Spans:
    """Pieces of some texts in order: row, start (byte in the row's text), until (place of the piece after the run that
    starts there); first: as in Words. Runs have the piece that they start with (origin), a hash, a check of 32 more bits, and
    place: that piece's place in the row, less LAST if the run is one that ends with the text."""

    __slots__ = ("row", "start", "until", "first", "origin", "place", "hash", "check")


def piece_starts(words: Words, data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word starts a piece."""
    n = len(words.hash)
    stops = np.concatenate([[0], np.cumsum(_STOPS[data], dtype=np.int64)])
    starts = np.ones(n, bool)
    starts[1:] = (stops[words.start[1:]] > stops[words.end[:-1]]) | (words.row[1:] != words.row[:-1])
    if n >= window:
        key = words.hash.copy()
        key[starts] = 0  # a window that a sentence starts in has its cut already
        low, at = key[: n - window + 1].copy(), np.arange(n - window + 1)
        for k in range(1, window):
            other = key[k : n - window + 1 + k]
            less = other <= low
            low[less] = other[less]
            at[less] = np.flatnonzero(less) + k
        starts[at] = True
    return starts


def spans_of(texts: pa.Array, span: int = SPAN, min_words: int = MIN_WORDS, hashes: bool = True) -> Spans:
    """Pieces and, with hashes, the hashes of their runs."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = hash_words(texts, lower=False)
    n_rows, out = len(texts), Spans()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n_rows + 1, offset=texts.offset * 8) if n_rows else np.zeros(1, np.int64)
    n = len(words.hash)
    if not n:
        out.row = out.start = out.until = out.origin = out.place = np.zeros(0, np.int64)
        out.hash, out.check, out.first = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64)
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    first_word = np.flatnonzero(piece_starts(words, data))
    m = len(first_word)
    row = words.row[first_word]
    out.first = np.searchsorted(row, np.arange(n_rows + 1))
    out.row = row
    out.start = words.start[first_word] - (offsets - offsets[0])[row]
    # a run ends before the first piece that is far enough in pieces and in words, if its row goes so far
    later = np.append(first_word, n)
    until = np.maximum(np.arange(m) + span, np.searchsorted(later, first_word + min_words))
    there = until <= out.first[row + 1]
    until = np.minimum(until, m)
    out.until = until - out.first[row]
    if hashes:
        some = np.append(there[1:] < there[:-1], there[-1]) if m else there  # the last run of a row
        origin, tail = np.flatnonzero(there), np.flatnonzero(some)
        tail = tail[until[tail] < out.first[row[tail] + 1]]
        out.origin = np.concatenate([origin, tail])
        out.place = out.origin - out.first[row[out.origin]]
        out.place[len(origin) :] -= LAST
        starts, ends = first_word[out.origin], later[np.concatenate([until[origin], out.first[row[tail] + 1]])]
        with np.errstate(over="ignore"):
            up, down = powers(n)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(words.hash * up[:n])])
            out.hash = mix((sums[ends] - sums[starts]) * down[starts])
            # of other values, so that runs with one hash have another check
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words.hash ^ U64(0xC2B2AE3D27D4EB4F)) * up[:n])])
            out.check = (mix((sums[ends] - sums[starts]) * down[starts]) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def _hashes(texts: DataFrame, span: int, min_words: int) -> DataFrame:
    """hash, n of the runs of each block of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0):
                s = spans_of(part.column(0), span, min_words)
                names, n = np.unique(s.hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return map_arrow(texts, run, "hash bigint, n bigint")


def _occurrences(rows: DataFrame, span: int, min_words: int) -> DataFrame:
    """hash, check, doc_id, sub (32 bits of the text's hash, then the place) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                s = spans_of(part.column(2), span, min_words)
                of = s.row[s.origin]
                key = np.asarray(part.column(1)).astype(np.int64)[of]
                sub = (key << 32) | (s.place & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(s.hash.view(np.int64)), pa.array(s.check), part.column(0).take(pa.array(of)), pa.array(sub)], names=["hash", "check", "doc_id", "sub"])

    return map_arrow(rows, run, f"hash bigint, check int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, sub bigint")


def repeated_places(df: DataFrame, doc_id: str, text: str, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key (int), places: array of the pieces where a non-first occurrence of a run starts.

    Runs shuffle as numbers, never as text: first their hashes alone, counted with partial sums; then those that are
    repeated meet their places. Both joins go against written tables, which Spark shuffles anew, so that it can split a
    passage that a third of all documents hold. A run counts as the same if 96 bits agree.
    """
    rows = df.select(col(doc_id).alias("doc_id"), F.hash(col(text)).alias("text_key"), col(text).alias("text"))
    often = _hashes(rows.select("text"), span, min_words).groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")
    often = written(often.select("hash"), "repeats")
    hits = written(_occurrences(rows, span, min_words).join(often, "hash", "left_semi"), "hits")
    first = hits.groupBy("hash", "check").agg(F.min(F.struct("doc_id", "sub")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first.select(F.col("hash").alias("f_hash"), F.col("check").alias("f_check"), F.col("first.doc_id").alias("f_doc"), F.col("first.sub").alias("f_sub")), "firsts")
    other = ~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("sub") == F.col("f_sub")))
    later = hits.join(first, (F.col("hash") == F.col("f_hash")) & (F.col("check") == F.col("f_check")) & other)
    places = later.select("doc_id", F.shiftright("sub", 32).cast("int").alias("text_key"), F.shiftright(F.shiftleft("sub", 32), 32).cast("int").alias("place"))
    return places.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", span: int = SPAN, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """df with repeated sentences removed from its texts; all rows and columns stay.

    `length`, if df has it, is set anew to the code points left. With counts, n_sentences and n_removed
    (long) are added, in place of columns so named. The first occurrence is that of the smallest doc_id (null first), then of the text by
    hash, then the first place. Equal rows (id and text) are one document, each keeping what it keeps. A null
    text stays null. A text all of whose sentences are removed becomes ''. An empty table gives an empty one.
    """
    out_cols = [c for c in df.columns if not (counts and c.lower() in ("n_sentences", "n_removed"))]
    key, places, r_id, r_key, n_all, n_gone = fresh(df, "key", "places", "r_id", "r_key", "n_sentences", "n_removed")
    lost = repeated_places(df, doc_id, text, span, min_words).select(F.col("doc_id").alias(r_id), F.col("text_key").alias(r_key), F.col("places").alias(places))
    both = df.select(*[col(c) for c in out_cols], F.hash(col(text)).alias(key)).join(lost, (F.col(key) == F.col(r_key)) & col(doc_id).eqNullSafe(F.col(r_id)), "left")
    both = both.select(*[col(c) for c in out_cols], F.col(places))
    at = out_cols.index(text)
    names = [*[f"c{i}" for i in range(len(out_cols) + 1)], n_all, n_gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at):
                s = spans_of(part.column(at), span, min_words, hashes=False)
                gone = np.zeros(part.num_rows, np.int64)
                texts = part.column(at)
                marked = part.column(len(out_cols))
                hit = np.flatnonzero(np.asarray(marked.is_valid()))
                if len(hit):
                    left = texts.to_pylist()
                    for i in hit.tolist():
                        lo, hi = int(s.first[i]), int(s.first[i + 1])
                        covered = np.zeros(hi - lo, bool)
                        for p in marked[i].as_py():
                            if p < 0:
                                covered[p + LAST :] = True
                            else:
                                covered[p : s.until[lo + p]] = True
                        gone[i] = covered.sum()
                        left[i] = _without(left[i].encode(), s.start[lo:hi], covered)
                    texts = pa.array(left, texts.type)
                columns = [part.column(j) if j != at else texts for j in range(len(out_cols))]
                yield pa.RecordBatch.from_arrays([*columns, marked, pa.array(np.diff(s.first)), pa.array(gone)], names=names)

    done = map_arrow_rows(both, run, f"{n_all} bigint, {n_gone} bigint")
    final = [F.length(col(text)).cast(df.schema[c].dataType).alias(c) if c == length else col(c) for c in out_cols]
    return done.select(*final, *([F.col(n_all).alias("n_sentences"), F.col(n_gone).alias("n_removed")] if counts else []))


def _without(text: bytes, starts: np.ndarray, covered: np.ndarray) -> str:
    """The text without covered sentences, each of which reaches to the next one's first word."""
    ends = np.append(starts[1:], len(text))
    parts = [] if covered[0] else [text[: starts[0]]]
    for a, b in zip(starts[~covered].tolist(), ends[~covered].tolist(), strict=True):
        parts.append(text[a:b])
    return b"".join(parts).decode().rstrip()
