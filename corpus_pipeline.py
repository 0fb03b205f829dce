"""The corpus pipeline: five operators of ``terraspan.llm`` in a row, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraspan import shipping
from terraspan.llm import decontamination, langid, mixing, near_dedup, sharding
from terraspan.llm.common import bounded_batches, scratch, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# What all stages have in common: any column may be null, texts may be empty or very long (they are read whole), rows may
# be repeated, and columns may have any name beside those of documents; an empty table gives an empty one.


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a letter (null and empty ones too), and those too far from every centroid.

    Every row is judged by its text alone, so repeated rows go or stay
    together; among equally near languages the first in order counts. If no
    row has a language to learn from, nothing can be told and all go.
    """
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Null, empty and wordless texts are like nothing and stay; of rows that
    share the id that stays, one does; rows without an id stay.
    """
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none and stay, repeated rows go or stay together."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, up to three.

    Documents without words stay once; a null source is a source of its own;
    rows alike in id, source and size are taken alike; ties are settled by a hash.
    """
    return mixing.mixed_documents(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: every row of the mix, whole, with size, text_crc32, law, its shard of 24, its slot there, and grown_shard.

    Columns of those names are replaced. Repeated rows are placed one by one, apart from each other.
    """
    return sharding.corpus(docs, shards=24)


def shipped(stage: Stage) -> Stage:
    """The stage, after the package has been sent to the executors, with small batches for Python: its workers and what they were sent stay in memory through the later stages."""
    return lambda spark, docs, sf_dir: stage(bounded_batches(shipping.ensure(spark)), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", shipped(identify_languages)),
    ("near_dedup", shipped(drop_near_duplicates)),
    ("decontamination", shipped(drop_contaminated)),
    ("mixing", shipped(mix_sources)),
    ("sharding", shipped(deal_into_shards)),
]

#: Neither sketches nor entropy balancing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole ``documents``, each one's result written to the shared folder and read by the next; what a stage wrote for itself is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
