"""The registered queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents")).drop("redact")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.bpe_codec import codec_digests

    return codec_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.quality_classifier import quality_scores, train

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweft.llm.media_columns import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
