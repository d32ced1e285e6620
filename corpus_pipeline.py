"""The corpus pipeline: documents through language ID, quality rules, near-dedup, mixing, encoding and decoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.llm import language_id, line_quality, mixing, pieces, simhash
from wayfinder.llm.common import forget, last_one_stays, stored

#: Texts whose language is less certain than this go; clean texts of a learned language lie well above.
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs), MIN_LANGUAGE_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality.keep_good(docs, line_quality.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), [F.col("doc_id"), F.col("source")], decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: Models, near-duplicates and draws have no SQL. The tests hold what each stage keeps against the operator's own verdict on
#: every row (language, quality, mix) or against brute force (near-duplicates, encoding), and the models against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with last_one_stays():
            docs = stored(stage(spark, before, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
