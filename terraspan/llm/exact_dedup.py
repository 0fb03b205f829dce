"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

A snapshot is a table of digest groups (digest, keep_id, n) that never changes
once written, cut into buckets by the digest, with one binary-fuse filter
(three places, 16-bit fingerprints) for each bucket. An incoming batch is
first grouped within itself. The digests of its groups are then probed: a
negative is new for certain; positives (members and about 1 in 65,536 others)
are joined with the exact bucket and confirmed byte for byte on the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, materialize, mix64
from .common import screen as screen_rows

#: Digests in a bucket of a snapshot, on average.
BUCKET_KEYS = 200_000
FINGERPRINT = np.uint64(0xFFFF)


def fuse_layout(n: int) -> tuple[int, int]:
    """(segment length, number of segments) for ``n`` keys, by the sizing rule published for three-wise binary-fuse filters."""
    if n <= 1:
        return 4, 3
    length = min(1 << 18, max(4, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(n))
    return length, max(3, int(np.ceil(n * factor / length)) + 2)


def fuse_places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, in three consecutive segments, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
        inner = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
    mask, width = np.uint64(length - 1), np.uint64(length.bit_length() - 1)
    slots = np.stack([(first + np.uint64(j)) * np.uint64(length) + ((inner >> (width * np.uint64(j))) & mask) for j in range(3)])
    return slots.astype(np.int64), ((h ^ (h >> np.uint64(32))) & FINGERPRINT).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, table) of a filter that holds all ``keys`` (uint64, made distinct here).

    All slots used by a single key are peeled at once, layer after layer;
    fingerprints are then laid in the reverse order. A core that can't be
    peeled means another seed.
    """
    keys = np.unique(keys)
    length, segments = fuse_layout(len(keys))
    for seed in range(1, 200):
        slots, prints = fuse_places(keys, seed, length, segments)
        size = length * segments
        count = np.zeros(size, np.int64)
        which = np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for row in slots:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(which, row, index)
        layers, left = [], len(keys)
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            peeled, at = np.unique(which[single], return_index=True)
            layers.append((peeled, single[at]))
            for row in slots[:, peeled]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, peeled)
            left -= len(peeled)
        if not left:
            table = np.zeros(size, np.uint16)
            for peeled, own in reversed(layers):
                a, b, c = (table[row] for row in slots[:, peeled])
                table[own] = prints[peeled] ^ a ^ b ^ c  # a key's own slot is still 0 here
            return seed, length, segments, table
        if seed % 20 == 0:
            segments += max(1, segments // 10)
    raise RuntimeError("no seed lets the filter be built")


def probe_fuse(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    slots, prints = fuse_places(keys, seed, length, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), np.uint64)


def _filter_of(group: pd.DataFrame) -> pd.DataFrame:
    seed, length, segments, table = build_fuse(_keys(group["digest"]))
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "slots": [table.tobytes()]})


def _probe(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(batch) or not len(filters):
        return batch.assign(hit=False)
    f = filters.iloc[0]
    return batch.assign(hit=probe_fuse(_keys(batch["digest"]), int(f["seed"]), int(f["length"]), int(f["segments"]), np.frombuffer(f["slots"], np.uint16)))


@dataclass(frozen=True)
class Snapshot:
    """Digest groups (digest binary, keep_id, n, bucket), their filters (one row a bucket) and the texts behind keep_id."""

    groups: DataFrame
    filters: DataFrame
    texts: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    """From the digest's last bytes, as its first ones are the filter's keys."""
    return F.pmod(F.xxhash64(F.substring("digest", 17, 16)), F.lit(buckets)).cast("int")


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the UTF-8 text; null counts as empty."""
    return docs.select(*others, "doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"))


def group(digested: DataFrame) -> DataFrame:
    """Rows grouped by digest: keep_id is the largest doc_id, n the number of rows. Counted before the shuffle too, so a hot digest is cheap."""
    return digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def snapshot(docs: DataFrame, digested: DataFrame, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
    groups = materialize(group(digested), "snapshot_groups")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, blocks_for(groups.count(), bucket_keys))
    groups = groups.withColumn("bucket", _bucket(buckets))
    filters = materialize(
        groups.select("bucket", "digest").groupBy("bucket").applyInPandas(_filter_of, "bucket int, seed int, length int, segments int, slots binary"), "snapshot_filters"
    )
    return Snapshot(groups, filters, docs.select("doc_id", "text"), buckets)


def screen(batch: DataFrame, base: Snapshot) -> DataFrame:
    """Groups of an incoming batch with ``hit``: whether the snapshot may hold their digest."""
    schema = "digest binary, keep_id long, n long, bucket int, hit boolean"
    probe = lambda left, right: _probe(left, right)[["digest", "keep_id", "n", "bucket", "hit"]]
    return batch.withColumn("bucket", _bucket(base.buckets)).groupBy("bucket").cogroup(base.filters.groupBy("bucket")).applyInPandas(probe, schema)


def confirmed(hits: DataFrame, base: Snapshot, incoming: DataFrame) -> DataFrame:
    """(digest, snap_id, snap_n) of those hits that the snapshot's exact bucket holds with the very same bytes."""
    exact = hits.select("bucket", "digest", "keep_id", "n").join(
        base.groups.select("bucket", "digest", F.col("keep_id").alias("snap_id"), F.col("n").alias("snap_n")), ["bucket", "digest"]
    )
    exact = materialize(exact, "exact_hits")
    blob = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    def side(docs: DataFrame, who: str, name: str) -> DataFrame:
        """One text for each positive group. Others are screened off before the join, which so moves few texts."""
        rows = screen_rows(docs.select(F.col("doc_id").alias(who), blob.alias(name)), who, exact.select(who).filter(F.col(who).isNotNull()))
        # by id and digest, so that rows that share an id don't mix
        same = rows.join(exact.select(who, "digest"), who).filter(F.unhex(F.sha2(name, 256)) == F.col("digest"))
        return same.groupBy("digest").agg(F.max(name).alias(name))

    both = side(incoming, "keep_id", "new_bytes").join(side(base.texts, "snap_id", "old_bytes"), "digest")
    checked = both.filter("new_bytes = old_bytes").select("digest")
    # a group without any id has no row to fetch; its digest decides
    checked = checked.unionByName(exact.filter("keep_id is null or snap_id is null").select("digest"))
    return exact.join(checked, "digest").select("digest", "snap_id", "snap_n")


def deduplicate(docs: DataFrame, arrived: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``arrived`` tells which rows are the incoming batch, the others being the
    snapshot; unless given, rows are dealt by a hash of their id, half and
    half. The result doesn't depend on it: the row with the largest doc_id of
    each group of equal texts stays, wherever it came from.

    Null text equals the empty text. A null doc_id stays only where its whole
    group has null ids. Repeated rows (same id and text) all carry the same
    answer. An empty table gives an empty one; other columns are ignored.
    """
    arrived = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(False)) if arrived is None else arrived
    docs = docs.withColumn("_new", arrived)
    digested = materialize(digests(docs, "_new"), "digests")
    base = snapshot(docs.filter(~F.col("_new")), digested.filter(~F.col("_new")))
    batch = group(digested.filter("_new"))
    screened = materialize(screen(batch, base), "screened")
    found = confirmed(screened.filter("hit"), base, docs.filter("_new"))
    joined = materialize(
        base.groups.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
        .join(screened.select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n")).join(found.select("digest"), "digest"), "digest", "left")
        .select("digest", F.greatest("old_id", "new_id").alias("keep_id"), (F.col("old_n") + F.coalesce("new_n", F.lit(0))).alias("group_size"))
        .unionByName(screened.join(found, "digest", "left_anti").select("digest", "keep_id", F.col("n").alias("group_size"))),
        "groups",
    )
    return answer(digested, joined)


def answer(digested: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of one row answer for themselves; only those of several are joined back to the rows."""
    several = groups.filter("group_size > 1")
    rows = digested.select("doc_id", "digest").join(several, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
