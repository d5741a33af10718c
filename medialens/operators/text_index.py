"""An inverted index for ranked search: postings by term, in blocks with bounds of what a document in them can score.

Documents are dealt into blocks of like lengths. A term's postings are one row for each block, with the largest frequency and the smallest length
in it; together they bound the score of any document of the block for any query and any later state of the collection. A search
reads the bounds of its terms' partitions, scores the best blocks, and then only those whose bound reaches the k-th score.

Batches are written beside each other. One counts from the moment at which the table of totals names it; what a lost writer left is never read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.functions.frames import ship, small_side
from medialens.operators.graph import stored
from medialens.sources.snapshot import SnapshotTable

#: Partitions of the terms, documents and words of a block (about; a longer document is a block), and blocks that are scored first.
SHARDS, BLOCK_DOCS, BLOCK_WORDS, FIRST_BLOCKS = 64, 256, 1 << 20, 16
#: Up to so many blocks are named in the scan's filter, beyond they join.
LISTED_BLOCKS = 4096
SLACK = 1e-9


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _block_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of one block's documents (block, key, length, words); words are parted by spaces, and each document has one."""
    docs = pa.Table.from_batches(list(batches)).sort_by("key").combine_chunks()
    words, length = pc.split_pattern(docs["words"].combine_chunks(), " "), docs["length"].to_numpy()
    terms = words.flatten().dictionary_encode()
    pairs, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(docs) + pc.list_parent_indices(words).to_numpy(), return_counts=True)
    term, doc = np.divmod(pairs, len(docs))
    length = length[doc]
    ends = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    each = pa.StructArray.from_arrays([docs["key"].combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(length)], names=["key", "tf", "length"])
    yield pa.RecordBatch.from_arrays(
        [
            docs["block"].combine_chunks().take(pa.array(np.zeros(len(ends) - 1, np.int64))),
            terms.dictionary,
            pa.array(np.diff(ends)),
            pa.array(np.maximum.reduceat(tf, ends[:-1]).astype(np.int32)),
            pa.array(np.minimum.reduceat(length, ends[:-1])),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each),
        ],
        names=["block", "term", "docs", "most", "shortest", "postings"],
    )


class TextIndex:
    """Postings, documents and totals below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", shards: int = SHARDS, k1: float = 1.2, b: float = 0.75):
        self.spark, self.path, self.key_type, self.shards, self.k1, self.b = spark, path.rstrip("/"), key_type, shards, k1, b
        self.totals = SnapshotTable(spark, f"{self.path}/totals")

    def batches(self) -> list[tuple[str, int, int]]:
        """(name, documents, words) of each batch that counts."""
        rows = self.totals.read()
        return [] if rows is None else [tuple(r) for r in rows.select("batch", "docs", "words").orderBy("batch").collect()]

    def _read(self, what: str, schema: str) -> DataFrame:
        names = [b for b, *_ in self.batches()]
        if not names:
            return self.spark.createDataFrame([], f"{schema}, batch string" + (", shard int" if what == "postings" else ""))
        schema = f"{schema}, batch string" + (", shard int" if what == "postings" else "")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/batch={n}" for n in names])

    def documents(self) -> DataFrame:
        return self._read("documents", f"key {self.key_type}, length int, block bigint")

    @property
    def _posted(self) -> str:
        return f"block bigint, term string, docs bigint, most int, shortest int, postings array<struct<key:{self.key_type},tf:bigint,length:int>>"

    def postings(self) -> DataFrame:
        return self._read("postings", self._posted)

    def _once(self, rows: DataFrame) -> DataFrame:
        """rows (key, text) of keys that the index has not, each once; texts are grouped only where a key stands twice."""
        if self.batches():
            rows = rows.join(self.documents().select("key"), "key", "left_anti")
        twice = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
        if twice.isEmpty():
            return rows
        twice = small_side(twice)
        least = rows.join(twice, "key", "left_semi").groupBy("key").agg(F.min(F.struct("text")).alias("d")).select("key", F.col("d.text").alias("text"))
        return rows.join(twice, "key", "left_anti").unionByName(least)

    def _blocks(self, placed: DataFrame) -> DataFrame:
        """The postings of documents (key, length, words, block): these are shuffled by block, and their words counted there."""
        ship(self.spark)
        return placed.filter("length > 0").select("block", "key", "length", "words").groupBy("block").applyInArrow(_block_postings, self._posted)

    def add(self, docs: DataFrame, key: str, text: str) -> int:
        """Adds the documents whose key the index has not yet (of equal keys the one with the smallest text, null first) and returns how many these are. Null keys are left
        out; a null text is a document without words."""
        rows = docs.select(F.col(key).cast(self.key_type).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL")
        rows = self._once(rows).select("key", words_of(F.col("text")).alias("words"))
        rows = stored(rows.select("key", F.size("words").alias("length"), F.array_join("words", " ").alias("words")))
        grade = F.floor(F.log2(F.col("length") + 1) * 8).cast("int")
        grades = rows.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).collect()  # some hundred rows at most
        if not grades:
            return 0
        known = self.batches()
        first, start = {}, 2**40 * len(known)
        for r in sorted(grades, key=lambda r: r.grade):
            first[r.grade] = (start, max(-(-r.n // BLOCK_DOCS), -(-r.words // BLOCK_WORDS)))
            start += first[r.grade][1]
        pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for g, v in first.items() for x in (g, v[k])]), grade)
        placed = rows.withColumn("block", pick(0) + F.pmod(F.xxhash64("key"), pick(1)))
        batch = f"{len(known):06d}-{uuid.uuid4().hex[:8]}"
        placed.select("key", "length", "block").write.parquet(f"{self.path}/documents/batch={batch}")
        blocks = self._blocks(placed).withColumn("shard", _shard(F.col("term"), self.shards)).repartition("shard", F.pmod("block", F.lit(8))).sortWithinPartitions("shard", "term", "block")
        blocks.write.partitionBy("shard").parquet(f"{self.path}/postings/batch={batch}")
        n, words = sum(r.n for r in grades), sum(r.words for r in grades)
        new = self.spark.createDataFrame([*known, (batch, n, words)], "batch string, docs bigint, words bigint")
        self.totals.write(new)
        return n

    def _of(self, terms: list[str]) -> DataFrame:
        """The postings of the terms; only their partitions are read."""
        shards = sorted(set(self.spark.range(1).select(F.array(*[_shard(F.lit(t), self.shards) for t in terms])).first()[0]))
        return self.postings().filter(F.col("shard").isin(shards) & F.col("term").isin(terms))

    def search(self, terms: Sequence[str], k: int = 10) -> DataFrame:
        """key, score of the k best documents that hold a term, ties by key."""
        return self._search(terms, k)[0]

    def _search(self, terms: Sequence[str], k: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """search(), the blocks that hold a term with their bounds, and those of them that are scored."""
        nothing = self.spark.createDataFrame([], f"key {self.key_type}, score double"), None, None
        terms, batches = list(dict.fromkeys(terms)), self.batches()
        n, words = sum(b[1] for b in batches), sum(b[2] for b in batches)
        if not terms or not words or k < 1:
            return nothing
        postings = self._of(terms)
        heads = postings.select("block", "term", "docs", "most", "shortest").persist()
        counts = {r.term: r.df for r in heads.groupBy("term").agg(F.sum("docs").alias("df")).collect()}
        if not counts:
            return nothing
        idf = F.create_map(*[F.lit(x) for t, df in counts.items() for x in (t, math.log(1 + (n - df + 0.5) / (df + 0.5)))])
        gain = lambda tf, length: F.element_at(idf, F.col("term")) * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / F.lit(words / n)))
        bounds = heads.groupBy("block").agg(F.sum(gain(F.col("most"), F.col("shortest"))).alias("bound"))

        def best(blocks: list[int] | DataFrame) -> DataFrame:
            kept = postings.filter(F.col("block").isin(blocks)) if isinstance(blocks, list) else postings.join(blocks, "block", "left_semi")
            each = kept.select("term", F.explode("postings").alias("p"))
            return each.groupBy(F.col("p.key").alias("key")).agg(F.sum(gain(F.col("p.tf"), F.col("p.length"))).alias("score")).orderBy(F.round("score", 9).desc(), "key").limit(k)

        first = best([r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]).collect()
        bar = first[-1].score if len(first) == k else -math.inf
        left = bounds.filter(F.col("bound") >= bar - SLACK).select("block")
        some = [r.block for r in left.limit(LISTED_BLOCKS + 1).collect()]
        return best(some if len(some) <= LISTED_BLOCKS else left), bounds, left
