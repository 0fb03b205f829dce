import os
import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from terraspan.llm import common, decontamination, langid, near_dedup
from terraspan.llm.oracles import ORACLES
from terraspan.llm.queries import QUERIES

from .test_mixing import expected_targets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == names
        ids, kept = [r["doc_id"] for r in docs.select("doc_id").collect()], [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "language_id":
            gone = {r["doc_id"] for r in langid.predict(docs, langid.fit(docs)).filter("rejected").collect()}
            assert set(kept) == set(ids) - gone and len(kept) == len(ids) - len(gone)
        elif name == "near_dedup":
            assert sorted(kept) == sorted(r["doc_id"] for r in near_dedup.group(docs).filter("kept").collect())
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and set(kept) == set(ids) - bad
        elif name == "mixing":
            assert set(kept) <= set(ids) and max(map(kept.count, kept)) <= 3
        else:
            assert sorted(kept) == sorted(ids)
        before[name] = len(kept)
        docs = out
    run = corpus_pipeline.run(spark, SF)
    assert run.count() == before["sharding"] == before["mixing"]


def awkward(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_awkward_rows_by_plain_rules(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeats and planted copies through all stages; what must come of them is told by plain rules."""
    clean = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect() if r["text"] and len(r["text"]) > 2000][:300]
    text = clean[0][1]
    item = clean[1][1].split()[:40]
    odd = [(900_001, None, "en", "src0", 0), (900_002, "", None, None, None), (900_003, "12 34", "en", None, 5), (None, clean[2][1] + " one more", "en", "src1", 9), (900_004, " ".join([c[1] for c in clean] * 4), "en", "src1", 1)]
    odd += [(900_005, text, "en", "src2", 3), (900_005, text, "en", "src2", 3), (900_006, text + " again", None, "src3", 3), (900_007, clean[3][1] + " " + " ".join(item) + " " + clean[4][1], "en", "src4", 2)]
    gibberish = " ".join("qxzvkj"[i % 6] * 2 + "wqxzjk"[i % 5] + "vbnqxz"[i % 4] * 3 + chr(97 + i % 26) for i in range(300))
    odd += [(900_008, gibberish, None, "src5", 4), (900_009, "我们 他们 你们 " * 50, None, "src5", 4)]
    docs = awkward(spark, clean + odd).repartition(3)
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    kept, tables = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert name == "sharding" or out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        tables[name] = docs.collect()
        kept[name] = Counter(r["doc_id"] for r in tables[name])
    ids = Counter(r[0] for r in clean + odd)
    gone = {900_001, 900_002, 900_003, 900_008, 900_009}
    assert kept["language_id"] == Counter({k: n for k, n in ids.items() if k not in gone})
    copies = {900_005, 900_006} if clean[0][0] < 900_000 else set()
    assert not copies & set(kept["near_dedup"]) and max(kept["near_dedup"].values()) == 1 and kept["near_dedup"][None] == 1 and 900_004 in kept["near_dedup"]
    holds = {r["doc_id"] for r in tables["near_dedup"] if " ".join(item).lower() in " ".join((r["text"] or "").split()).lower()}
    assert 900_007 in holds and 900_004 in holds
    assert not holds & set(kept["decontamination"]) and len(set(kept["near_dedup"]) - holds - set(kept["decontamination"])) <= 2  # near copies of the passage
    sizes, taken = Counter(), Counter()
    for r in tables["decontamination"]:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    for r in tables["mixing"]:
        taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    longest = max(len(r["text"].split()) for r in tables["decontamination"] if r["doc_id"] != 900_004)
    want = expected_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes if s != "src1") and max(kept["mixing"].values()) <= 3
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in tables["sharding"]) == Counter((r["doc_id"], r["text"], len((r["text"] or "").encode()) + 8) for r in tables["mixing"])
    shards = Counter(r["shard"] for r in tables["sharding"])
    assert max(shards[s] for s in range(24)) - min(shards[s] for s in range(24)) <= 1
    assert all(sorted(r["slot"] for r in tables["sharding"] if r["shard"] == s) == list(range(shards[s])) for s in shards)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = awkward(spark, [])
    spark.createDataFrame([(1, "some item of the benchmark")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)


def test_stages_hand_small_batches_to_python(spark):
    """40 texts of 200 kB and one of 5 MB in one partition: no batch is much beyond the bound, whatever its rows; a session's own bound holds."""
    docs = awkward(spark, [(i, "word " * (1_000_000 if i == 7 else 40_000), "en", "a", 0) for i in range(41)]).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield batch.select([0]).append_column("bytes", pa.array([batch.nbytes] * len(batch), pa.int64()))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    stage = corpus_pipeline.shipped(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "doc_id long, bytes long"))
    spark.conf.unset(name)
    of = {r["doc_id"]: r["bytes"] for r in stage(spark, docs, SF).collect()}
    assert set(of) == set(range(41)) and of[7] < common.BATCH_BYTES + 5_250_000 and all(b < common.BATCH_BYTES + 250_000 for b in of.values() if b != of[7])
    try:
        spark.conf.set(name, "500000")
        assert stage(spark, docs, SF).count() == 41 and spark.conf.get(name) == "500000"
    finally:
        spark.conf.unset(name)


def test_scratch_tables_go(spark):
    with common.scratch(spark):
        path = common.shared_path(spark, "x")
        inner = common.materialize(spark.range(3), "x")
        assert inner.count() == 3
    where = path.rsplit("/", 1)[0].removeprefix("file://")
    assert "scratch-" in where and not os.path.exists(where) and "scratch-" not in common.shared_path(spark, "x")


def test_registration():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLES) <= set(QUERIES)
