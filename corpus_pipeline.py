"""From `documents` to shards of training data: every stage calls one operator of civiclink.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civiclink.llm.common import read, stored
from civiclink.llm.decontaminate import decontaminated
from civiclink.llm.langid import identified, train
from civiclink.llm.mixing import mixture
from civiclink.llm.sharding import sharded
from civiclink.llm.simhash import drop_near_duplicates

SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without letters, and those hardly any of whose
    n-grams belong to a language, go. The model learns from the documents that carry a language."""
    return identified(docs, train(docs), min_score=0.1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return drop_near_duplicates(docs, shingle=3, distance=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; benchmark passages are cut out of its text."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"), length_col="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target has it: not at all, once or twice."""
    mix = mixture(docs, weights=(3.0, 1.0, 2.0), share=1.5, limit=2.0, shards=SHARDS)
    return mix.select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it."""
    return sharded(docs, [1.0] * SHARDS, order=["doc_id", "text"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# SQL can express neither the n-gram filters nor the 64-bit hashes; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
