"""A training-data pipeline over the table documents, in five stages: drop low quality, keep one of each
group of near-duplicates, generalise personal data, mix sources to target weights, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the
columns of documents, the last doc_id, ids (the tokens) and decoded (their text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relog.llm import bpe, mixing, pii, quality, simhash
from relog.llm.common import checkpoint, documents
from relog.llm.queries import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", generalise_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: No stage of these fits DuckDB's SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are cut off by a reliable checkpoint."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
