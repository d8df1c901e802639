"""From raw documents to training shards: score, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns they came with; the last adds shard and
slot. What a stage returns is written as Parquet and read again as the next one's documents.

Edge cases are those of the operators: null and empty texts pass the classifier by their score like any other text, are
alone in deduplication, are never contaminated, keep their source's rate and weigh one byte in a shard. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from twinfold.llm.frames import Scratch, col, table

#: SQL has no tree ensembles: the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*[col(c) for c in docs.columns])


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("near-duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark_texts),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; rows of the last."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
            scratch.drop_but(docs)
    return docs
