"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.llm import bpe, chat, decontamination, html, infill, minhash, quality, sharding, stamps, substrings, topk, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = [f"shard-{i:03d}" for i in range(64)]
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: the text left, its sentences and how many of them were removed."""
    done = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return done.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("bigint").alias("n_chars_left"), "text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(documents, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -1, whose two turns say nothing but control strings."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(*chat.format_chats(with_probe(table(spark, sf_dir, "conversations"))))


def tokenizer_path() -> str:
    """The place of the public vocabulary file; the operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalise(table(spark, sf_dir, "stamps"), keep=["stamp_id"])


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sharding": op2_sharding,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filters": op4_url_filters,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_decontamination": op6_decontamination,
        "op7_toxicity": op7_toxicity,
        "op8_near_dedup": op8_near_dedup,
        "op9_bpe": op9_bpe,
        "op10_html_extraction": op10_html_extraction,
        "op11_timestamps": op11_timestamps,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_exact_topk": op13_exact_topk,
        "pipeline": pipeline,
    }
