"""Fill-in-middle transformation: prefix, suffix and middle of a text in the order of prefix-suffix-middle or suffix-prefix-middle.

Code points are counted and cut by the Split pre-tokenizer of the tokenizers library. Its isolated matches are blocks of
64 code points first, whose offsets rank the blocks; only a block that holds the text's end or a cut is split again into single code
points, whose offsets give the number and the cuts. No tokenizer is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, fresh, map_arrow_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, so many stay plain, and of 100 others so many put the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
BLOCK = 64
#: A text goes to the library in pieces of so many code points, as it keeps some thirty bytes for each byte of its input.
PIECE = 1024 * BLOCK


def _splitters():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(rf"[\s\S]{{1,{BLOCK}}}"), "isolated"), Split(Regex(r"[\s\S]"), "isolated")


class Ruler:
    """Counts and cuts texts by code points."""

    def __init__(self) -> None:
        self.blocks, self.points = _splitters()

    def measure(self, text: str) -> tuple[int, list[int]]:
        """The number of code points of text, and where each of its blocks begins."""
        starts, n = [], 0
        for at in range(0, len(text), PIECE):
            offsets = [x[1] for x in self.blocks.pre_tokenize_str(text[at : at + PIECE])]
            starts += [at + first for first, _ in offsets]
            n = (len(starts) - 1) * BLOCK + len(self.points.pre_tokenize_str(text[starts[-1] :]))
        return n, starts

    def place(self, text: str, starts: list[int], k: int) -> int:
        """Where the k-th code point begins; the text's end for k = n."""
        if not starts:
            return 0
        block = min(k // BLOCK, len(starts) - 1)
        inside = self.points.pre_tokenize_str(text[starts[block] : starts[block] + BLOCK])
        rank = k - block * BLOCK
        return starts[block] + (inside[rank][1][0] if rank < len(inside) else inside[-1][1][1])


def _cut(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds the columns `names`, which are n, prefix, middle and suffix, by the last three: text and the two draws."""
    ruler = Ruler()
    for batch in batches:
        texts, lows, highs = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
        counts, parts = [], ([], [], [])
        for text, h1, h2 in zip(texts.to_pylist(), lows.to_pylist(), highs.to_pylist(), strict=True):
            n, starts = ruler.measure(text)
            one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = ruler.place(text, starts, one), ruler.place(text, starts, two)
            counts.append(n)
            for part, piece in zip(parts, (text[:a], text[a:b], text[b:]), strict=True):
                part.append(piece)
        arrays = [*batch.columns, pa.array(counts, pa.int64()), *[pa.array(p, pa.string()) for p in parts]]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])


def _draw(key: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the key's digest, as a number."""
    return F.conv(F.substring(key, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    A null or empty text is plain with an empty output, and so is a text that contains a control string. A null id draws like an
    empty one. Repeated rows are cut alike. Other columns pass; those with the names of the added ones are replaced.
    """
    df = documents.drop("n", "form", "prefix_chars", "middle_chars", "output")
    names = fresh(df, "digest", "whole", "low", "high", "n", "prefix", "middle", "suffix", "form")
    digest, whole, low, high, n, prefix, middle, suffix, form = names
    keyed = df.withColumn(digest, F.sha2(F.concat(F.lit("1:"), F.coalesce(col(doc_id).cast("string"), F.lit(""))), 256))
    keyed = keyed.withColumns({whole: F.coalesce(col(text), F.lit("")), low: _draw(F.col(digest), 1), high: _draw(F.col(digest), 2)})
    kept = [x for x in keyed.columns if x not in (text, whole, low, high)]
    cut = map_arrow_rows(keyed.select(*map(col, kept), whole, low, high), partial(_cut, names=[n, prefix, middle, suffix]), f"{n} long, {prefix} string, {middle} string, {suffix} string")
    marked = F.col(whole).contains(PREFIX) | F.col(whole).contains(SUFFIX) | F.col(whole).contains(MIDDLE)
    plain = (F.col(whole) == "") | marked | (_draw(F.col(digest), 3) % 100 >= 100 - PLAIN_PERCENT)
    suffix_first = _draw(F.col(digest), 4) % 100 < SUFFIX_FIRST_PERCENT
    formed = cut.withColumn(form, F.when(plain, "plain").when(suffix_first, "spm").otherwise("psm"))
    p, s, m = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix), F.concat(F.lit(MIDDLE), middle)
    output = F.when(F.col(form) == "plain", F.col(whole)).when(F.col(form) == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    size = lambda x: F.when(F.col(form) != "plain", F.length(x)).cast("long")
    own = [F.col(whole).alias(text) if x == text else col(x) for x in df.columns]
    return formed.select(*own, F.col(n).alias("n"), F.col(form).alias("form"), size(prefix).alias("prefix_chars"), size(middle).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form: no part contains a control string, and none of these begins as it ends."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = parts[1], parts[2], parts[3]
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, third, first)).otherwise(F.concat(first, third, second))


def digests(formed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The columns of fill_in_middle() with digests of the output and of the text rebuilt from it."""
    out = F.col("output")
    return formed.select(col(doc_id), "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, F.col("form")), 256).alias("restored_sha256"))
