"""The queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sondage.llm import bytebpe, chat, exact, hpylm, htmltext, jaccard, packing, quality, relative, repair, resample, tokenfile, warc
from sondage.llm.base import documents, scratch
from sondage.llm.sql import ORACLE  # noqa: F401


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir), k=5, percent=75)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talks.schema)
    return chat.read_back(chat.format_conversations(talks.unionByName(own)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir), keep="largest")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scratch(spark, "tokens")
    tokenfile.write_tokens(documents(spark, sf_dir), files, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_tokens(spark, files, with_ids=False)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages -> WARC responses -> derived WARC records, written and read back; a row for each derived record."""
    sources, derived = scratch(spark, "responses"), scratch(spark, "derivatives")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.respond(pages, "2024-01-01T00:00:00Z", packed=True).write.option("compression", "none").parquet(sources)
    warc.derive_blocks(spark.read.parquet(sources)).write.option("compression", "none").parquet(derived)
    return warc.digest_blocks(spark.read.parquet(derived))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1, buckets=10_000, percent=10)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.report(documents(spark, sf_dir), window=13)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.report(repair.damage(talks), ids=talks)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_chat_formatting, op3_quality_rules, op4_lm_scoring, op5_exact_dedup, op6_token_ids,
        op7_byte_bpe, op8_html_extraction, op9_warc_derivatives, op10_best_fit_packing, op11_importance_resampling,
        op12_substring_dedup, op13_conversation_repair)}
