"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder stands in for a single local process only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to a shared table and read back."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "uncompressed").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def unused(spark: SparkSession, folder: str) -> str:
    """``folder``, or with a number behind it if there is one already."""
    name, n = folder.rstrip("/"), 1
    while (place := _place(spark, name))[0].exists(place[1]):
        n += 1
        name = f"{folder.rstrip('/')}_{n}"
    return name


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """One file on the file system that the path names, part by part."""
    store, where = _place(spark, path)
    out = store.create(where, True)
    try:
        for data in parts:
            out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, [text.encode("utf-8")])


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
