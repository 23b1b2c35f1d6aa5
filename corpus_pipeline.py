"""The training-data pipeline over `documents`: STAGES in order, each written and read again by the driver.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
Every stage keeps extra columns, whatever their names, and gives no rows for none. ORACLE_SQL is None: a learnt classifier can't
be put in SQL, so tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, mixing, near_dedup, quality, sharding
from corpusmill.llm._common import documents, staged

SHARDS = 16


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier scores below 0.5; a null text is scored like an empty one, identical rows alike."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of near copies; texts without words are like nothing and stay, identical rows stay or go together."""
    return near_dedup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more; cuts hits of over 50 words from the others. Texts without words stay."""
    return decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words meet its target: a document comes as often as the mix takes it, a part of half or more counted as whole, in the order of the schedule. Texts without words aren't taken."""
    return mixing.repeated(docs, mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix to shards of near equal bytes: the columns of docs (but for ones named shard or slot), shard, slot. Null texts have size 1; identical rows stand together."""
    return sharding.shard(docs, SHARDS)


STAGES = [("quality_classifier", classify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("source_mix", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
