"""Training-data pipeline: five of the operators in a row, each stage over all its predecessor kept.

1. quality classifier: rejected documents go;
2. line dedup: repeated lines go, but for one occurrence in the corpus;
3. SimHash near-dedup: one document of each group stays;
4. secret scan: live-looking credentials are masked;
5. best-fit packing: the pieces of the training sequences.

Every stage but the last returns the columns of its input, with ``n_chars`` recounted where
it changes texts.  Nulls, empty texts, repeated rows and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweft.llm import line_dedup, packing, quality_classifier, secrets, simhash
from lakeweft.llm.common import drop_written, written
from lakeweft.llm.queries import vocabulary


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.accepted(docs, quality_classifier.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.line_dedup(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Trained weights, fingerprint components and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if k:
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
