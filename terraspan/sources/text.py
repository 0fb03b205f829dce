"""Detection labels and photo metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image, class_id, cx, cy, w, h) of label files, one box a line, sizes as shares of the image; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("p", parts).filter(F.size("p") == 5)
    image = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    out = lines.select(image.alias("image"), F.get("p", F.lit(0)).try_cast("int").alias("class_id"), *[F.get("p", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])
    return out.filter("class_id is not null and cx is not null and cy is not null and w is not null and h is not null")


def read_photo_metadata(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(path, one double a key) of ``key="number"`` in the first 200 kB of each photo; null where a key is missing."""
    head = F.decode(F.substring("content", 1, 200_000), "ISO-8859-1")
    files = spark.read.format("binaryFile").load(path).select("path", head.alias("t"))
    number = lambda k: F.regexp_extract("t", rf'{k}="([+-]?[0-9.]+)"', 1).try_cast("double")
    return files.select("path", *[number(k).alias(k) for k in keys])
