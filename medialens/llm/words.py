"""Hashes of all words of a batch of texts at once, from its UTF-8 buffer.

The texts of an Arrow batch stand one after another in one buffer. Words are found by marking
the bytes that end them; the hash of a word is a polynomial in its bytes modulo 2^64 by an odd base,
taken from running sums over the buffer (the base has an inverse, so a word's hash does not depend on where it
stands), then mixed. No Python object is made for any word but very long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; the tables of powers have so many entries.
CHUNK_BYTES = 1 << 19

#: Longer words are hashed by a cryptographic function.
LONG_BYTES = 256

_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of the base and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES) + 1
        up, down = np.full(size, U64(_BASE)), np.full(size, U64(_INVERSE))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def _classes(letters_only: bool) -> np.ndarray:
    """1 for bytes that are part of words. ASCII punctuation is left out with letters_only."""
    keep = np.ones(256, bool)
    keep[[9, 10, 11, 12, 13, 32]] = False
    if letters_only:
        for c in range(128):
            if not chr(c).isalnum():
                keep[c] = False
    return keep


_BY_SPACE, _BY_LETTER = _classes(False), _classes(True)


class Words:
    """Words of some texts: hash, row (index of the text), start and end (byte offsets in the text's
    buffer), in order; prefix: hashes of their first so many bytes, by that number; `first` has the index of each row's first word and, last, their number."""

    __slots__ = ("hash", "row", "start", "end", "first", "prefix")

    def __init__(self, hashes, rows, starts, ends, n_rows, prefix):
        self.hash, self.row, self.start, self.end, self.prefix = hashes, rows, starts, ends, prefix
        self.first = np.searchsorted(rows, np.arange(n_rows + 1))


def hash_words(texts: pa.Array, letters_only: bool = True, lower: bool = True, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of an array of strings; nulls have none.

    A word is a run of bytes that are not white space or, with letters_only, of ASCII letters,
    digits and bytes of other characters. With lower, case does not matter.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = (_BY_LETTER if letters_only else _BY_SPACE)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[borders] = inside[borders]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    before = borders[borders > 0] - 1
    finish[before] = inside[before]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    hashes = np.empty(len(starts), U64)
    prefix = {k: np.empty(len(starts), U64) for k in prefixes}
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
            piece = data[low : ends[stop - 1]]
            up, down = powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum((piece.astype(U64) + U64(1)) * up[: len(piece)], out=sums[1:])
            a, b = starts[at:stop] - low, ends[at:stop] - low
            hashes[at:stop] = (sums[b] - sums[a]) * down[a]
            for k in prefixes:
                prefix[k][at:stop] = (sums[np.minimum(b, a + k)] - sums[a]) * down[a]
            at = stop
    # polynomials modulo 2^64 collide for long inputs made for it, whatever the base
    for k in np.flatnonzero(ends - starts > LONG_BYTES).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    rows = np.searchsorted(offsets[1:], starts, "right") if len(starts) else np.zeros(0, np.int64)
    return Words(mix(hashes), rows, starts, ends, n, {k: mix(v) for k, v in prefix.items()})


def window_hashes(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Order-dependent hash of the words at i + o for o in offsets, for each i that has them all."""
    n = len(hashes) - max(offsets)
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for o in offsets:
            out = (out ^ hashes[o : o + n]) * U64(0x9FB21C651E98DF25)
            out ^= out >> U64(29)
    return mix(out)


def blocks(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, so that memory is bounded by it or the longest text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
