"""What the corpus operators share: shared-folder tables, global ranks, words."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and Spark runs in a single local process
    does a temporary folder stand in; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: The folder under the application's one where tables are written now.
_scope: ContextVar[str] = ContextVar("scope", default="")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}{_scope.get()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end; what is to last must have been written elsewhere by then."""
    token = _scope.set(f"{_scope.get()}/scratch-{uuid.uuid4().hex}")
    path = f"{application_dir(spark)}{_scope.get()}"
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application has written; results must have been consumed."""
    delete(spark, application_dir(spark))


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name``, the row's place from 0 in ``order`` (whole rows' ties are arbitrary).

    Rows are range-partitioned, ranked inside each partition and shifted by
    the sizes of the partitions before it, so no task sees all rows. Only one
    count per partition reaches the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    w = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.row_number().over(w) - 1)
        .drop("_part", "_start")
    )


#: Bytes of rows that go to a Python worker at a time (Spark's own bound is 64 MB); a longer row goes alone.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, handing rows to Python about BATCH_BYTES at a time unless it has a bound of its own.

    A batch is held in the executor's direct memory and, read and written, in
    the worker, for each running task, and neither gives all of it back. Which
    rows share a batch makes no difference to any operator.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


#: Keys that a broadcast screen holds at most, at two bytes each.
SCREEN_KEYS = 30_000_000
_BITMAP = 32_768


def flagged(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: true on all rows whose ``column`` is among ``keys`` (one column of that name) and on about 1 in 16 others.

    The flag comes from a bitmap of 16 bits a key, broadcast in pieces of 4 KB,
    so that a wide table needn't be shuffled to meet a few keys. With more keys
    than SCREEN_KEYS every row is flagged: the join behind it decides alone.
    """
    n = keys.count()
    if n > SCREEN_KEYS:
        return df.withColumn(name, F.lit(True))
    pieces = max(1, math.ceil(n * 16 / _BITMAP))
    place = F.pmod(F.xxhash64(column), F.lit(pieces * _BITMAP))
    put = keys.select(F.floor(place / _BITMAP).alias("_piece"), F.bitmap_bit_position(place % _BITMAP + 1).alias("_bit"))
    bits = put.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = place % _BITMAP
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_piece", F.floor(place / _BITMAP)).join(F.broadcast(bits), "_piece", "left")
    return met.withColumn(name, F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))).drop("_piece", "_bits")


def screen(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``keys``: all that are and about 1 in 16 others."""
    return flagged(df, column, keys, "_may").filter("_may").drop("_may")


#: Rows of a lookup table that are broadcast at most; the widest take 250 bytes each, 50 MB in all.
LOOKUP_ROWS = 200_000


def lookup(df: DataFrame) -> DataFrame:
    """``df``, a table at rest, ready to be joined: broadcast where it has LOOKUP_ROWS rows at most, else merged."""
    return F.broadcast(df) if df.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else df.hint("merge")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply rounds) over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word -> 64-bit hash, remembered for up to ``limit`` words so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes | str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers that tell a shingle's places apart.
PLACES = mix64(np.arange(1, 65, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingle_hashes(ids: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each run of ``k`` words in order; of the whole sequence where it is shorter; none for no words."""
    n = len(ids)
    if n == 0:
        return ids
    width = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, np.uint64(width) * GOLDEN, np.uint64)
        for j in range(width):
            total += ids[j : n - width + 1 + j] * PLACES[j]
    return mix64(total)


def ascii_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.lower().split()


def values(column: pa.Array) -> Iterator:
    """A column's values one at a time, so that no second copy of a batch's texts is held."""
    return (v.as_py() for v in column)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))
