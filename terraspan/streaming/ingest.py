"""An extension: detections that arrive as files, counted per class and hour as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hourly_counts(detections: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, class, n) of tumbling hours; rows later than the watermark are left out. State is bounded by the watermark."""
    timed = detections.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = timed.groupBy(F.window("_t", "1 hour").alias("w"), "class").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "class", "n")


def start(counts: DataFrame, path: str, checkpoint: str):
    """Append finished hours to a Parquet folder; exactly once, by the checkpoint."""
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
