import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from terraspan.llm import common, mixing

from .cases import empty, frame, rows


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(held.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: held.get(s, level * w[s]) for s in order}
        held.update({s: cap * sizes[s] for s in over})


def check(spark, docs, data):
    got = mixing.mix(docs).select("doc_id", "text", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(data)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    want = expected_targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.51 * longest[s] + 1e-6 * want[s]
    return sorted(map(str, got))


def test_targets_bounds_and_reruns(spark):
    docs = frame(spark)
    assert check(spark, docs, rows()) == check(spark, docs.repartition(5), rows())


def test_merged_lookups_give_the_same(spark, monkeypatch):
    docs = frame(spark)
    broadcast = check(spark, docs, rows())
    monkeypatch.setattr(common, "LOOKUP_ROWS", 3)
    assert check(spark, docs, rows()) == broadcast


def test_names_that_clash(spark):
    names = ["size", "m", "mass", "row", "rate", "copies", "cuts", "salt", "draw", "a.b", "_row", "_copy", "place", "u"]
    docs = spark.createDataFrame([(i, "one two " * (i % 7), "s" + str(i % 2), *[i] * len(names)) for i in range(40)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    plain = {r["doc_id"]: (r["copies"], r["taken"]) for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    got = mixing.mix(docs)
    assert got.columns[-6:] == ["size", "source_size", "target", "rate", "copies", "taken"] and {r["doc_id"]: (r["copies"], r["taken"]) for r in got.collect()} == plain


def test_tilt_and_copies_equal_a_plain_solution(spark):
    """Multipliers by bisection of each source's own constraint; copies by the rule of the running total and the hash, document by document."""
    docs = frame(spark).dropDuplicates(["doc_id", "source", "size"]).drop("size").filter("doc_id is not null and doc_id != 35")
    got = mixing.mix(docs).withColumn("draw", F.xxhash64("doc_id", "source", F.lit(20_231))).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    target = expected_targets({s: sum(r["size"] for r in own) for s, own in by.items()})
    for s, own in by.items():
        mean = sum(r["size"] for r in own) / len(own)
        rates = lambda lam: [min(3.0, math.exp(min(50.0, lam * (2 * r["size"] / (r["size"] + mean) if r["size"] else 0.0)))) for r in own]  # noqa: E731, B023
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            if sum(x * r["size"] for x, r in zip(rates(mid), own)) < target[s]:
                low = mid
            else:
                high = mid
        want = rates((low + high) / 2)
        assert all(abs(r["rate"] - x) < 1e-4 for r, x in zip(own, want))
        left = 0.0
        for size in sorted({r["size"] for r in own}, reverse=True):
            cell = sorted((r for r in own if r["size"] == size), key=lambda r: r["draw"])
            rate = cell[0]["rate"]
            part = len(cell) * (rate - math.floor(rate))
            k = min(len(cell), max(0, math.floor(part + left / size + 0.5))) if size else 0
            left += (part - k) * size
            assert [r["copies"] for r in cell] == [math.floor(rate) + (i < k) for i in range(len(cell))]


def test_dual_meets_its_constraints(spark):
    docs = frame(spark)
    rate = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("f"), F.first("target").alias("t")).collect()
    # rows alike in id, source and size are weighed together, so the tilt of pairs is that of their sum
    assert all(abs(r["f"] - r["t"]) <= 1e-5 * max(1.0, r["t"]) for r in rate)


def test_empty_and_sizeless(spark):
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "  ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


def test_documents_are_repeated_as_taken(spark):
    docs = frame(spark)
    plan = {}
    for r in mixing.mix(docs).collect():
        plan.setdefault((r["doc_id"], r["source"], r["text"]), []).append(r["copies"])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[(r["doc_id"], r["source"], r["text"])] += 1
    assert dict(seen) == {k: sum(v) for k, v in plan.items() if sum(v)}


def test_hot_cell_is_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 200, "a").otherwise("b").alias("source"))
    taken = {r["source"]: (r["t"], r["w"]) for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()}
    assert all(abs(t - w) <= 1.5 for t, w in taken.values())
