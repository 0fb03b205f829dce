"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, langid, licenses, line_dedup, mixing, near_dedup, quality, sharding, warc
from .common import materialize, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # words are counted once; the mix itself then works on three narrow columns
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mixing.mix(sized, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


def op4_fast_similarity_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.digest(table(spark, sf_dir, "documents"))
    placed = sharding.shard(rows, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_zip_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_fuse_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = langid.predict(docs, langid.fit(docs))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_entropy_mix, op2_simhash_decontamination, op3_site_spread_lines, op4_fast_similarity_near_dedup, op5_hypergeometric_shards,
        op6_zip_warc_round_trip, op7_fuse_filter_dedup, op8_quadratic_quality, op9_centroid_langid, op10_rare_token_licenses,
    )
}
