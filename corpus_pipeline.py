"""A corpus pipeline of five operators: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns a DataFrame that is written as Parquet
and read again. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import keep_until_exit, read, shared_dir
from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.language import without_rejected
from tidemark.llm.mixing import mix_documents
from tidemark.llm.neardup import keep_representatives
from tidemark.llm.sharding import kd_shards


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return without_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Five-word shingles, similarity 0.8 or more."""
    return keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often, and with those of their words, as the mix takes."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of the mix."""
    return kd_shards(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The learned language model cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's rows written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/tidemark-stage{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        keep_until_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
