"""Exact dedup, line dedup and near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terraspan.llm import common, exact_dedup, line_dedup, near_dedup

from .cases import empty, frame, rows, sentence


def test_fuse_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 10, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = exact_dedup.build_fuse(np.concatenate([keys, keys]))
        assert exact_dedup.probe_fuse(keys, *f).all()
        assert exact_dedup.probe_fuse(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64), *f).mean() < 0.001


def exact_truth(data):
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups[t or ""].append(d)
    out = []
    for d, t, *_ in data:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max(ids) if ids else None) if len(groups[t or ""]) > 1 else d
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark):
    data = rows() + rows(6)
    docs = spark.createDataFrame(data, frame(spark).schema)
    want = exact_truth(data)
    assert Counter(map(tuple, exact_dedup.deduplicate(docs).collect())) == want
    for arrived in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") > 30, F.lit(True))):
        assert Counter(map(tuple, exact_dedup.deduplicate(docs, arrived).collect())) == want
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def line_truth(data, least):
    sites = defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, t, s in data:
        for x in (t or "").split("\n"):
            if norm(x):
                sites[norm(x)].add(s)
    out = []
    for d, t, _ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(sites.get(norm(x), ())) < least]
        out.append((d, 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept), t if t is None or len(kept) == len(lines) else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(3)
    shared = [sentence(rng, 6) for _ in range(15)]
    data = [(i, "\n".join([f"own {i}"] + [f"  {x}\t" for k, x in enumerate(shared) if rng.random() < k / 15] + [""] * (i % 2)), rng.choice([None, *[f"s{j}" for j in range(12)]])) for i in range(80)]
    data += [(100, None, "s1"), (101, "", "s2"), (102, "\n\n", "s3")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, source string, n_lines int, _gone int")
    for least in (2, 5, 9):
        got = line_dedup.remove_boilerplate(docs, min_sites=least).select("doc_id", "n_lines", "n_removed", "text").collect()
        assert sorted(map(tuple, got), key=str) == line_truth(data, least)
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_id", "_kept", "kept", "gone", "row", "a", "b", "site", "id", "parts", "n_lines", "a.b"]
    text = "\n".join(["shared", "own"])
    docs = spark.createDataFrame([(i, text + str(i), f"s{i}", *[i] * len(names)) for i in range(8)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = line_dedup.remove_boilerplate(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(i, f"own{i}", f"s{i}", *[i] * (len(names) - 1), 2, 1) for i in range(8)]


def sets_of(data):
    out = {}
    for d, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def near_truth(data):
    sets = sets_of(data)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def near_group(rng, n, words=90, changes=8):
    base = sentence(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(words)] = sentence(rng, 1)
        out.append(" ".join(w))
    return out


def test_near_dedup_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    data = [r for r in rows() if r[0] is not None and r[0] != 40]
    data += [(1000 + i, t) for i, t in enumerate(near_group(rng, 150) + near_group(rng, 60, 60, 4))]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(5)
    want = near_truth(data)
    assert sorted(map(tuple, near_dedup.group(docs).collect())) == want
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)  # buckets cut into blocks answer the same
    assert sorted(map(tuple, near_dedup.group(docs).collect())) == want


def test_near_dedup_with_nulls_and_repeats(spark):
    got = near_dedup.group(frame(spark)).collect()
    assert len(got) == len(rows())
    kept = near_dedup.keep_one(frame(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame(spark).columns and ids.count(40) == 1 and ids.count(None) == 2 and 11 not in ids and 0 in ids and 31 in ids
    assert near_dedup.group(empty(spark)).count() == 0


def test_one_of_each_group_stays_by_either_plan(spark, monkeypatch):
    """Columns whose names clash, and the plan of many keys, give the same rows."""
    names = ["row", "may", "stays", "n", "id", "_piece", "component", "bits", "a.b"]
    docs = frame(spark).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    few = sorted(map(str, near_dedup.keep_one(docs).collect()))
    kept = {r["doc_id"] for r in near_dedup.group(docs).filter("kept").collect()}
    assert near_dedup.keep_one(docs).columns == docs.columns and Counter(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == Counter([*(kept - {None}), None, None])
    monkeypatch.setattr(common, "SCREEN_KEYS", 0)
    assert sorted(map(str, near_dedup.keep_one(docs).collect())) == few
    assert near_dedup.keep_one(empty(spark)).count() == 0


def test_exact_dedup_without_a_screen(spark, monkeypatch):
    docs, want = frame(spark), exact_truth(rows())
    monkeypatch.setattr(common, "SCREEN_KEYS", 0)
    assert Counter(map(tuple, exact_dedup.deduplicate(docs.withColumn("_new", F.lit(3)).withColumn("digest", F.lit("x"))).collect())) == want


def test_every_planted_pair_of_a_shared_bucket_is_met_once():
    """Pairs at 0.75 to 0.76 that reach the last step: each is looked at in exactly one of the buckets that it shares."""
    rng, pairs, met, shared = np.random.default_rng(12), 4000, 0, 0
    for _ in range(pairs):
        n = int(rng.integers(40, 400))
        m = int(np.ceil(1.5 * n / 1.75 / 2 * 2))  # 2 n - m elements in all, m in common: m / (2 n - m) = 0.75 or a little more
        both = rng.integers(0, 1 << 63, 2 * n - m, dtype=np.uint64)
        assert 0.75 <= m / (2 * n - m) < 0.79
        sketches = [near_dedup.sketch(np.sort(x)) for x in (both[:n], both[n - m :])]
        bands, bits = [near_dedup.band_keys(s) for s in sketches], [near_dedup.mix64(s).astype(np.uint8).tobytes() for s in sketches]
        common_bands = np.flatnonzero(bands[0] == bands[1])
        shared += len(common_bands) > 0
        found = 0
        for b in common_bands[:3]:  # later ones are skipped by the same rule
            group = pd.DataFrame([(int(bands[0][b]), 0, 0, i, i, n, 0, bits[i], bands[i]) for i in (0, 1)], columns=["key", "low", "high", "id", "component", "n", "chunk", "bits", "bands"])
            found += len(near_dedup._Block(group, first_band_only=True).a)
        assert found == (len(common_bands) > 0)
        met += found
    assert met == shared and shared >= pairs - 1  # 2 in a million miss each other in all bands


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(4)
    for n in (1, 3, 50, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert near_dedup.sketch(a).max() != 0xFFFFFFFFFFFFFFFF
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 800 / 1200) < 0.13


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    ring = [(200 + i, 200 + (i * 7 + 7) % 23) for i in range(23)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(path + star + ring, "a long, b long")).collect()))
    assert {v for k, v in got.items() if k <= 40} == {0} and {v for k, v in got.items() if 100 <= k < 130} == {100}
    assert got[200] == 200 and got[207] == 200


def test_equal_fragments_are_no_shared_bucket():
    # one component each, every 8-bit fragment equal, but only the bucket of band 3 in common (and band 2 for the last two)
    bands = np.arange(3 * near_dedup.BANDS, dtype=np.int64).reshape(3, -1) * 64 + np.arange(near_dedup.BANDS)
    bands[:, 3] = bands[0, 3]
    bands[2, 2] = bands[1, 2]
    rows = [(int(bands[0, 3]), 0, 0, i, i, 50, 0, bytes(near_dedup.COORDINATES), bands[i]) for i in range(3)]
    group = pd.DataFrame(rows, columns=["key", "low", "high", "id", "component", "n", "chunk", "bits", "bands"])
    block = near_dedup._Block(group, first_band_only=True)
    assert sorted(map(tuple, block.edges(np.arange(len(block.a))).to_numpy().tolist())) == [(0, 1), (0, 2)]


def test_pairs_of_a_hot_leader_are_dealt_over_copies_of_its_set(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = {0: " ".join(words), 200: " ".join(f"v{i}" for i in range(40))} | {i: " ".join(words[: 60 - i % 30]) for i in range(1, 90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edges = spark.createDataFrame([(0, i) for i in range(1, 90)] + [(0, 200), (7, 200), (1, 31)], "a long, b long")
    want = sorted([(0, i) for i in range(1, 90) if 100 * (56 - i % 30) >= 75 * 56] + [(1, 31)])
    for most in (4, 1024):
        monkeypatch.setattr(near_dedup, "PAIRS_A_COPY", most)
        assert sorted(map(tuple, near_dedup.verify(edges, docs).collect())) == want
    assert near_dedup.verify(edges.limit(0), docs).count() == 0
