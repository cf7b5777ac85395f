"""From raw documents to shards: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the
cluster's shared folder and gives what is read back to the next stage. All stages but the
last return the columns of ``documents``; the last adds ``shard`` and ``slot``.

Nulls, empty and long texts, repeated rows and empty tables are handled as the operators'
docstrings say: a null or short text fails the quality rules; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netvigil.llm import decontaminate, jaccard, mixing, quality, sharding
from netvigil.llm.common import stored, table

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the smallest id: five words, 0.8 or more."""
    return jaccard.one_per_group(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.mix(docs)


def sharding_uniformly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("sharding", sharding_uniformly),
]

# Components, rounding and shuffling cannot be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
