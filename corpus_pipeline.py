"""The corpus pipeline: five stages from ``documents`` to shards of a clean, mixed corpus.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it
kept.  All but the last return the columns of ``documents``; the last adds the shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, kernels, mixing, neardup, sharding, toxicity
from tidelog.llm.queries import MIX, SHARD_BYTES

#: Several stages have models, links and hashes that SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None

#: Word shingles of the near-duplicate stage.
SHINGLE = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 of their shingles stays: the one with the smallest id."""
    return neardup.keep_one(docs, shingle=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the hierarchical token budget takes them."""
    return mixing.mixed_documents(docs, MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the extendible-hashing shard that it belongs to."""
    return sharding.shards(docs, SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_to_target_weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{kernels.checkpoint_dir(spark).rstrip('/')}/tidelog-pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
