"""The corpus pipeline: documents to a mixed, sharded training set.

Each stage reads what its predecessor wrote. Quality rules, near-dedup and
decontamination drop documents; mixing writes the rest in the order of the
mixture; sharding numbers each shard's documents in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.catalog import MIX_WEIGHTS, SHARDS, table
from mediacat.llm.decontaminate import without_contaminated
from mediacat.llm.minhash_dedup import without_near_duplicates
from mediacat.llm.mixing import mixed, source_weights
from mediacat.llm.quality_rules import keep_good
from mediacat.llm.sharding import shard_documents
from mediacat.operators.materialize import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5 words, 0.8)."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixed(docs, source_weights(docs, MIX_WEIGHTS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard, with slots in the order in which the mixture
    was written: part files by name, rows as they stand in them."""
    return shard_documents(docs, SHARDS, order=[F.col("_metadata.file_name"), F.col("_metadata.row_index")])


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: the near-dedup, decontamination and sharding stages are beyond SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
