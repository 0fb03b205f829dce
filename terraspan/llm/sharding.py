"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are first dealt into logical partitions by a hash of their content and of
their number among equal rows, so that copies go ways of their own. How many
rows of each partition go to each shard is drawn from the multivariate
hypergeometric law: exactly the law that a uniform shuffle of all rows would
give. Each partition then permutes its rows and sends the first of them to the
first shard, the next to the second and so on; each shard permutes what it got.
Every shard has its exact size, and every arrangement is equally likely up to
the quality of the hash.

The matrix holds one row per partition (about two million rows of input each)
and one column per shard, MATRIX_CELLS at most; only counts per partition and
per block reach the driver. All work on rows is DataFrame expressions, on 28
bytes a row; whole rows are moved once, to join their places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, materialize

PARTITION_ROWS = 2_000_000
#: Partitions of small tables; fixed, so that places don't depend on the session's shuffle partitions.
LEAST_PARTITIONS = 64
#: Counts in the matrix, which is broadcast: 32 MB.
MATRIX_CELLS = 4_000_000
#: Copies of one row that one task numbers at a time: two to that power at most.
SLICE_BITS = 17


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among ``n`` drawn without replacement, by inversion around the mode, for populations of any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    deviation = (n * (good / total) * (bad / total) * max(0.0, (total - n) / max(1, total - 1))) ** 0.5
    reach = int(14 * deviation) + 30  # beyond 14 deviations lies less than a double can tell
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), last - first)


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Exact counts [partition, shard] with these row and column sums."""
    rng, left, out = np.random.default_rng(seed), list(shards), np.zeros((len(rows), len(shards)), dtype=np.int64)
    for p, n in enumerate(rows):
        rest = sum(left)
        for s, room in enumerate(left):
            rest -= room
            out[p, s] = take = draw_hypergeometric(rng, room, rest, n)
            left[s] -= take
            n -= take
    return out


def partitions_for(rows: int, shards: int, partition_rows: int = PARTITION_ROWS) -> int:
    """How many logical partitions: by the number of rows and shards alone."""
    return max(1, min(max(LEAST_PARTITIONS, blocks_for(rows, partition_rows)), MATRIX_CELLS // shards))


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (at, h) with ``again``: 0, 1, ... among the rows of the same ``h``.

    Copies are numbered slice by slice of ``at`` and the slices' sizes summed,
    so that no task sees all copies of a row. Which copy gets which number is arbitrary.
    """
    sliced = rows.withColumn("part", F.shiftright("at", SLICE_BITS))
    several = sliced.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("h").orderBy("part")) - F.col("n")
    starts = several.select("h", "part", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("h", "part").orderBy("at"))
    return sliced.withColumn("again", rank - 1).join(starts.hint("merge"), ["h", "part"]).select("at", "h", (F.col("again") + F.col("start")).alias("again"))


def shard(docs: DataFrame, *, shards: int = 24, seed: int = 7, key: list[str] | None = None, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shards differ by one row at most. ``key`` names the columns whose hash
    places the rows (all columns that can be hashed unless given). Rows alike
    in all of them are placed apart, each by its number among them, and are
    interchangeable; which of them comes where is arbitrary. The same rows get
    the same places again, whatever their partitioning and the session's
    settings. Null keys are a value like any other; empty and very long texts
    are values too; an empty table gives an empty one. Columns named shard or
    slot are replaced; any other name may occur.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    column = lambda c: F.col(f"`{c.replace('`', '``')}`")
    key = key or [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    hashed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"), F.xxhash64(*[column(c) for c in key], F.lit(seed)).alias("h"))
    hashed = materialize(hashed, "to_shard")  # ``at`` is settled once it is written
    n = hashed.count()
    cut = partitions_for(n, shards, partition_rows)
    dealt = numbered_copies(hashed.select("at", "h")).withColumn("g", F.xxhash64("h", "again", F.lit(seed)))
    dealt = materialize(dealt.select("at", "g", F.pmod(F.xxhash64("g"), F.lit(cut)).cast("int").alias("p")), "dealt")
    counts = {r["p"]: r["n"] for r in dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = sorted(counts)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    ends = communication_matrix([counts[p] for p in held], sizes, seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(p, [int(x) for x in row]) for p, row in zip(held, ends, strict=True)], "p int, ends array<long>")
    rank = F.row_number().over(Window.partitionBy("p").orderBy("g"))
    # broadcast: MATRIX_CELLS counts at most
    sent = dealt.withColumn("rank", rank).join(F.broadcast(matrix), "p").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int"))
    # the second permutation: shards are cut into blocks by another hash, so that no task holds a whole shard
    blocks = max(1, cut // shards)
    sent = sent.withColumn("turn", F.xxhash64("g", F.lit(seed + 1))).withColumn("block", F.pmod(F.col("turn"), F.lit(blocks)).cast("int"))
    sent = materialize(sent.select("at", "g", "shard", "turn", "block"), "sharded")
    starts, total = [], dict.fromkeys(range(shards), 0)
    for r in sorted(sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["shard"], r["block"])):
        starts.append((r["shard"], r["block"], total[r["shard"]]))
        total[r["shard"]] += r["n"]
    offsets = spark.createDataFrame(starts, "shard int, block int, start long")
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "block").orderBy("turn", "g")) - 1
    placed = sent.join(F.broadcast(offsets), ["shard", "block"]).select("at", "shard", slot.alias("slot"))
    return hashed.select("row", "at").join(placed.hint("merge"), "at").select("row.*", "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 8) and text_crc32 (of the text, the empty one for null)."""
    return docs.select("doc_id", *measures(F.col("text")))


def measures(text: Column) -> tuple[Column, Column]:
    """size and text_crc32."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")


def corpus(docs: DataFrame, **options) -> DataFrame:
    """Whole rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard; columns of those names are replaced.

    Null, empty and very long texts, repeated rows and empty tables are as in ``shard``.
    """
    placed = shard(docs.drop("size", "text_crc32", "law", "grown_shard"), **options)
    rest = [c for c in placed.columns if c not in ("shard", "slot")]
    return placed.select(*[F.col(f"`{c}`") for c in rest], *measures(F.col("text")), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write whole rows as Parquet, one folder for each shard, in the order of their slots."""
    placed = shard(docs, **options)
    placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
