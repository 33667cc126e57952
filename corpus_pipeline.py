"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowlens.llm.common import staged
from rowlens.llm.mixing import take_mix
from rowlens.llm.packing import pack
from rowlens.llm.quality import keep_quality
from rowlens.llm.queries import tokenizer_path
from rowlens.llm.simhash import drop_near_copies
from rowlens.llm.substrings import keep_unrepeated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_unrepeated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]

# Tokenisation, XXH64 and the linear program have no SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
