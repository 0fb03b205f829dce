import random
import zlib
from collections import Counter

import numpy as np
import pytest

from terraspan.llm import sharding

from .cases import empty, frame, rows


@pytest.mark.parametrize("repeat", [1, 4])
def test_sizes_slots_and_reruns(spark, repeat):
    docs = frame(spark)
    for _ in range(repeat - 1):
        docs = docs.union(frame(spark))
    placed = sharding.shard(sharding.digest(docs), shards=24).collect()
    assert len(placed) == repeat * len(rows())
    count = Counter(r["shard"] for r in placed)
    sizes = [count.get(s, 0) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.shard(sharding.digest(docs.repartition(7)), shards=24).collect()
    assert sorted(map(str, placed)) == sorted(map(str, again))


def test_copies_are_placed_like_different_rows(spark, monkeypatch):
    """Three copies of 4,000 rows and 3,000 of one: shards of copies as often the same as chance has it, counts of a shard by chi-square."""
    monkeypatch.setattr(sharding, "SLICE_BITS", 7)
    docs = spark.createDataFrame([(i,) for i in range(4000)] * 3 + [(-1,)] * 3000, "doc_id long")
    placed = sharding.shard(docs, shards=24).collect()
    of = {}
    for r in placed:
        of.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    hot = Counter(s for s, _ in of.pop(-1))
    assert sum((hot[s] - 125) ** 2 / 125 for s in range(24)) < 52  # 23 degrees of freedom, 1 in 2,000
    together = sum(len({s for s, _ in v}) == 1 for v in of.values())
    assert together <= 20  # 7 expected of 4,000
    gaps = [abs(a - b) for v in of.values() for (s, a), (t, b) in zip(sorted(v), sorted(v)[1:]) if s == t]
    assert sum(g == 1 for g in gaps) <= 12  # about 1 in 312
    pairs = Counter((v[0][0], v[1][0]) for v in of.values())
    assert sum((pairs[a, b] - 4000 / 576) ** 2 / (4000 / 576) for a in range(24) for b in range(24)) < 700  # 575 degrees of freedom


def test_places_depend_on_rows_alone(spark):
    docs = frame(spark).union(frame(spark))
    first = sorted(map(str, sharding.shard(docs, shards=5).collect()))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = sorted(map(str, sharding.shard(docs.repartition(2), shards=5).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert first == again


def test_partitions_are_bounded():
    assert sharding.partitions_for(10, 24) == 64 and sharding.partitions_for(2 * 10**9, 24) == 1000
    assert sharding.partitions_for(10**15, 24) * 24 <= sharding.MATRIX_CELLS and sharding.partitions_for(10, 10**7) == 1


def test_names_that_clash(spark):
    names = ["row", "at", "h", "again", "part", "n", "start", "g", "p", "rank", "ends", "turn", "block", "slot", "shard", "a.b"]
    docs = spark.createDataFrame([tuple(range(i, i + len(names))) for i in range(50)] * 2, ", ".join(f"`{n}` int" for n in names))
    placed = sharding.shard(docs, shards=3)
    kept = [n for n in names if n not in ("slot", "shard")]
    assert placed.columns == [*kept, "shard", "slot"] and placed.count() == 100
    assert sorted(tuple(r)[:-2] for r in placed.collect()) == sorted(tuple(r) for r in docs.select(*[f"`{n}`" for n in kept]).collect())


def test_whole_rows_with_their_places(spark):
    docs = frame(spark)
    out = sharding.corpus(docs, shards=4)
    assert out.columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in out.collect()) == Counter((d, t, len((t or "").encode()) + 8) for d, t, *_ in rows())
    assert sharding.corpus(empty(spark)).count() == 0


def test_digest(spark):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert Counter(map(tuple, sharding.digest(frame(spark)).collect())) == want


def test_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0


def test_matrix_margins():
    rows_, shards = [5, 0, 17, 100, 3], [42, 42, 41]
    m = sharding.communication_matrix(rows_, shards, 3)
    assert m.sum(axis=1).tolist() == rows_ and m.sum(axis=0).tolist() == shards and (m >= 0).all()


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = Counter(sharding.draw_hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    reference = random.Random(2)
    want = Counter(sum(x < 6 for x in reference.sample(range(15), 5)) for _ in range(20_000))
    assert all(abs(draws[k] - want[k]) < 450 for k in range(6))
    big = [sharding.draw_hypergeometric(rng, 10**12, 23 * 10**12, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 10**6 / 24) < 60 and 150 < np.std(big) < 250


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = frame(spark).drop("shard")
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=3)
    assert sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out").select(docs.columns).collect())) == sorted(map(str, docs.collect()))
