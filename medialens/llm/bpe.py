"""Byte-pair encoding by speculation and verification.

For each distinct word of a batch a greedy longest match proposes tokens. A proposal is the exact
encoding if every token encodes to itself and every adjacent pair encodes to just that pair; pairs are
looked up for the whole batch at once, in a table that grows with the pairs seen. Only words with a
failing token or pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, map_pandas

#: Code points whose case, category and composition all Unicode versions in use agree on; texts with
#: others are normalised and split by the tokenizers library itself.
_UNSETTLED = regex.compile(r"[^\x00-ԯ‐-‧‰-⁞€]")
#: A rank after that of every merge.
_NONE = 1 << 60
#: Letters that tell how long the tokens that begin with them can be.
_HEAD = 3
#: Words kept with their ids in one worker; beyond it the table starts anew.
CACHED_WORDS = 150_000
CACHED_PAIRS = 300_000


def byte_letters() -> list[str]:
    """The letter of each byte: itself where printable, else the next free one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """Encoder and decoder of one tokenizer file with words that end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for table in (self.vocab, self.special):
            for name, i in table.items():
                self.names[i] = name
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), rank)
            self.made.append(self.vocab[a + b])
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.longest = max(map(len, self.vocab))
        # tokens that end a word, by their letters, and the length of the longest token by its first letters
        self.finals = {name.removesuffix(self.suffix): i for name, i in self.vocab.items() if name.endswith(self.suffix)}
        self.reach: dict[str, int] = {}
        for name in self.vocab:
            self.reach[name[:_HEAD]] = max(len(name), self.reach.get(name[:_HEAD], 0))
        self._raw, self._library = raw, None
        self.cache: dict[str, bytes] = {}
        #: 1 if a token encodes to itself, 0 if not, -1 if not looked at yet
        self.good = np.full(len(self.names), -1, np.int8)
        self._forget_pairs()

    def _forget_pairs(self) -> None:
        """Empties the sorted table of looked-up pairs and whether they hold."""
        self.pairs, self.pair_holds = np.zeros(0, np.int64), np.zeros(0, bool)

    # exact merging

    def symbols(self, word: str) -> list[int]:
        """Ids of the byte letters of a word, the last with the suffix."""
        vocab = self.vocab
        return [*[vocab[c] for c in word[:-1]], vocab[word[-1] + self.suffix]]

    def merge(self, parts: list[int]) -> list[int]:
        """The lowest-ranked adjacent pair, leftmost first, is merged until none is left."""
        if len(parts) > 40:
            return self._merge_long(parts)
        get, none, parts = self.ranks.get, _NONE, list(parts)
        ranked = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranked:
            best = min(ranked)
            if best == none:
                break
            at, new = ranked.index(best), self.made[best]
            parts[at] = new
            del parts[at + 1], ranked[at]
            if at:
                ranked[at - 1] = get((parts[at - 1], new), none)
            if at < len(ranked):
                ranked[at] = get((new, parts[at + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        parts, n = list(parts), len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.ranks.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j], self.made[rank]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    # speculation and verification

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left; the last token carries the suffix."""
        vocab, finals, reach, n, at, out = self.vocab, self.finals, self.reach, len(word), 0, []
        while at < n:
            if n - at <= self.longest and (i := finals.get(word[at:])) is not None:
                out.append(i)
                break
            end = min(n - 1, at + reach.get(word[at : at + _HEAD], _HEAD - 1))
            while (i := vocab.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def letters_of(self, token: int) -> list[int]:
        name = self.names[token]
        return self.symbols(name[: -len(self.suffix)]) if self.suffix and name.endswith(self.suffix) else [self.vocab[c] for c in name]

    def _tokens_hold(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token encodes to itself; tokens not met before are merged once."""
        for t in np.unique(tokens[self.good[tokens] < 0]).tolist():
            self.good[t] = self.merge(self.letters_of(t)) == [t]
        return self.good[tokens] > 0

    def _pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens encodes to just that pair: all looked up in the table at once, new ones merged once."""
        codes, back = np.unique((a << 32) | b, return_inverse=True)
        if len(self.pairs) > CACHED_PAIRS:
            self._forget_pairs()
        new = codes[~np.isin(codes, self.pairs, assume_unique=True)]
        left, right = new >> 32, new & 0xFFFFFFFF
        holds = self._tokens_hold(left) & self._tokens_hold(right)
        for k in np.flatnonzero(holds).tolist():
            pair = [int(left[k]), int(right[k])]
            holds[k] = self.merge(self.letters_of(pair[0]) + self.letters_of(pair[1])) == pair
        at = np.searchsorted(self.pairs, new)
        self.pairs, self.pair_holds = np.insert(self.pairs, at, new), np.insert(self.pair_holds, at, holds)
        return self.pair_holds[np.searchsorted(self.pairs, codes)][back]

    def spelled(self, word: str) -> str:
        """The byte letters of a word; printable ASCII stands for itself."""
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join(map(self.letters.__getitem__, word.encode()))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct pre-token, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        spelled = list(map(self.spelled, words))
        proposals = list(map(self.propose, spelled))
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        left = np.flatnonzero(owner[1:] == owner[:-1])
        fails = np.zeros(len(words), bool)
        fails[owner[left[~self._pairs_hold(flat[left], flat[left + 1])]]] = True
        fails[owner[~self._tokens_hold(flat)]] = True
        for k in np.flatnonzero(fails).tolist():
            proposals[k] = self.merge(self.symbols(spelled[k]))
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        ids = np.fromiter(chain.from_iterable(proposals), "<u4", int(lengths.sum())).tobytes()
        ends = (4 * np.cumsum(lengths)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    # texts

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, before byte letters."""
        if _UNSETTLED.search(text):
            return self._split_by_library(text)
        # the file also makes each run of white space one space, which the pre-tokens never hold
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _split_by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            spec = json.loads(self._raw)
            self._library = Tokenizer.from_str(self._raw).normalizer
            spec["pre_tokenizer"]["pretokenizers"] = spec["pre_tokenizer"]["pretokenizers"][:1]
            self._pre = Tokenizer.from_str(json.dumps(spec)).pre_tokenizer
        return [w for w, _ in self._pre.pre_tokenize_str(self._library.normalize_str(text))]

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens, and ids of the special tokens that stand in the text as they are."""
        if self.marks is None or "<|" not in text and not self.marks.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        wanted = {w for pieces in cut for w in pieces}
        if len(self.cache) > CACHED_WORDS:
            self.cache = {}
        new = [w for w in wanted if w not in self.cache]
        words = [w for w in new if isinstance(w, str)]
        self.cache.update(zip(words, self.encode_words(words), strict=True))
        self.cache.update((w, np.asarray([w], "<u4").tobytes()) for w in new if isinstance(w, int))
        known = self.cache
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with single spaces between, special tokens too (the file has no decoder)."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer at a path that every worker can read; read once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _in_blocks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (array) and decoded (string).

    A row for each row of df, repeated ones too; a null text counts as empty (no ids, empty digest); texts are
    encoded whole whatever their length; other columns of df do not matter. No shuffle: each
    batch is encoded where it is read, in blocks of about block_chars, so memory is bounded
    by the longest text.
    """
    fields = f"doc_id {df.select(col(doc_id)).dtypes[0][1]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer_path)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in _in_blocks(texts, block_chars):
                ids = bpe.encode_batch(texts[lo:hi])
                decoded = map(bpe.decode, ids)
                out = {"doc_id": batch["doc_id"].iloc[lo:hi].array, "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids]}
                if with_ids:
                    decoded = list(decoded)
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                if with_ids:
                    out |= {"ids": [np.frombuffer(x, "<u4").astype("int64") for x in ids], "decoded": decoded}
                yield pd.DataFrame(out)
        bpe.cache = {}  # the worker lives on, maybe for other work

    rows = df.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    return map_pandas(rows, run, fields)
