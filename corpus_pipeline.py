"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, other columns of docs included, whatever
their names. An empty table gives an empty one. Each stage states below what it does with nulls, empty texts, ties and
repeated rows; the operators behind them say more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medialens.llm import bpe, decontamination, minhash, quality, substrings
from medialens.llm.queries import table, tokenizer_path
from medialens.llm.runtime import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and frequent lines go from those that stay.

    Null and empty texts are rejected as too short. A null source is a host of its own. Repeated rows and copies count once for
    a line and get the same verdict. A very long text is measured whole, in its row.
    """
    return quality.apply_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest doc_id (null goes first, then by
    the text's hash).

    Of equal rows one stays. Null texts are no copies of each other and all stay; texts without words go only as exact copies.
    """
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go from all documents but the first that has them, by doc_id (null first), then the text's
    hash; all rows stay.

    A null text stays null; one of which nothing is left becomes ''. Equal rows are one document.
    """
    return substrings.dedup_substrings(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts, and items without words, leak nothing. Repeated rows stay or go together. An empty benchmark lets all stay.
    """
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document, repeated rows each; a null text has no ids."""
    return bpe.encode(docs, tokenizer_path(), with_ids=True).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding", encode),
]

#: Signatures, seeds and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
