"""Text and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.vectors import bound, cosine
from medialens.operators.graph import checkpointed


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, length of each document's words."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return rows.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def _term_count(words, term: str):
    return F.struct(F.lit(term).alias("term"), F.size(F.filter(words, lambda w: w == term)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that hold a term. Only rows of the terms are counted and shuffled."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    seen = lambda w: F.struct(F.size(w).alias("length"), F.array(*[_term_count(w, t) for t in dict.fromkeys(terms)]).alias("hits"))
    rows = docs.select(key, bound(words, seen).alias("s")).select(key, "s.length", "s.hits")
    # read twice: once for the whole collection's numbers, once for the rows that hold a term
    rows = checkpointed(rows)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    found = rows.select(key, "length", F.explode(F.filter("hits", lambda h: h["tf"] > 0)).alias("h")).select(key, "length", "h.*")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    both = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return both.groupBy(key).agg(F.sum(part).alias("score"))


def similar(vectors: DataFrame, key: str, query: DataFrame) -> DataFrame:
    """key, score: cosine to the one vector in query (v)."""
    q = query.select(F.col("v").alias("__q")).limit(1)
    return vectors.crossJoin(F.broadcast(q)).select(key, cosine(F.col("v"), F.col("__q")).alias("score"))


def fused(rankings: dict[str, DataFrame], key: str, k: int = 60, depth: int = 100) -> DataFrame:
    """key, score, sources by reciprocal ranks: each ranking (key, score) gives 1 / (k + rank) to its first `depth` rows."""
    parts = None
    for name, r in rankings.items():
        top = r.orderBy(F.desc("score"), key).limit(depth)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, F.lit(name).alias("source"), (1.0 / (k + F.col("rank"))).alias("part"))
        parts = ranked if parts is None else parts.union(ranked)
    return parts.groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
