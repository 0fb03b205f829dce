import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.llm import langid, quality

from .cases import empty, frame, rows, sentence

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    judged = got.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in judged]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())
    # held-out labels teach nothing
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r["doc_id"]: r["score"] for r in quality.score(docs, wrong).collect()}
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(other)


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, 1), (50, 0), (51, None), (52, 0), (53, 1), (55, 0), (999, 1), (None, 1)], "doc_id long, quality int")
    got = quality.score(frame(spark), labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.score(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty(spark), labels).count() == 0


def test_discriminant_scores_are_log_densities():
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    x = {c: rng.normal(c, 1 + c, (400, d)) @ rng.normal(0, 1, (d, d)) for c in (0, 1)}
    moments = {c: np.concatenate([[400], v.sum(axis=0), (v.T @ v).ravel()]) for c, v in x.items()}
    model = quality.discriminant(moments, pooled=0.0, diagonal=0.0, floor=0.0)
    point = x[1][:5]
    logs = []
    for c in (0, 1):
        s = np.cov(x[c].T, bias=True)
        diff = point - x[c].mean(axis=0)
        logs.append(-0.5 * np.linalg.slogdet(s)[1] - 0.5 * (diff @ np.linalg.inv(s) * diff).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
    assert np.allclose(model.scores(point), want, atol=1e-6)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in judged if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(judged) == docs.count() and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_languages_of_awkward_rows(spark):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(train)
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, "中文"), (5, "und"), (6, "of the and " * 300_000), (6, "x"), (None, "und der die das ist nicht")]
    docs = spark.createDataFrame([(*r, "l", 3, True) for r in odd], "doc_id long, text string, lang string, score int, rejected boolean")
    got = sorted(map(tuple, langid.predict(docs, model).collect()), key=str)
    assert [r[0] for r in got if r[1] == "und"] == [1, 2, 3] and all(0 <= r[2] <= 1 for r in got)
    assert {r[0]: r[3] for r in got if r[0] in (1, 2, 3, 4, 5)} == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert langid.predict(empty(spark), model).count() == 0 and langid.keep_known(empty(spark)).count() == 0
    assert {(r["lang_pred"], r["rejected"]) for r in langid.predict(docs, langid.fit(empty(spark))).collect()} == {("und", True)}
    kept = langid.keep_known(docs.withColumn("_share", F.lit(1)).withColumn("n", F.lit(2)))
    assert kept.columns == [*docs.columns, "_share", "n"]  # fitted on rows that are too few to tell; names don't clash


def slow_counts(text):
    """n-gram counts by plain loops over Python integers."""
    clean = b" " + b" ".join(bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()).split()) + b" "
    out = {}
    for i in range(len(clean) - 2):
        tri = clean[i] | clean[i + 1] << 8 | clean[i + 2] << 16
        keys = [tri * 0x9E3779B1 % 2**32 >> 19]
        if i + 3 < len(clean):
            keys.append((tri * 0x85EBCA6B % 2**32 ^ clean[i + 3] * 0xC2B2AE35 % 2**32) * 0x9E3779B1 % 2**32 >> 19)
        for k in keys:
            out[k] = out.get(k, 0) + 1
    return out


def test_predictions_equal_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    middles, several = [2 ** ((b + 0.5) / 2) for b in range(langid.BANDS)], 0
    for r in docs.collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["rejected"]) == ("und", True)
            continue
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in slow_counts(r["text"]).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=lambda i: cos[i])
        if sorted(cos)[-1] - sorted(cos)[-2] > 1e-5:
            several += 1
            assert got[r["doc_id"]]["lang_pred"] == model.langs[model.owner[best]]
            least, place = model.least[model.owner[best]], 2 * math.log2(len(v)) - 0.5
            low = max(0, min(langid.BANDS - 2, math.floor(place)))
            bound = least[low] + (place - low) * (least[low + 1] - least[low]) if len(v) >= middles[0] else 0
            if abs(cos[best] - bound) > 1e-5:
                assert got[r["doc_id"]]["rejected"] == (cos[best] < bound)
        assert abs(got[r["doc_id"]]["score"] - min(1, max(0, cos[best]))) < 1e-4
    assert several > 150


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(i, f"texto{i % 40} palabra{i} cosa", f"l{i % 40:02}") for i in range(4000)], "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_texts=400, max_languages=30)
    assert len(model.langs) == 30 and len(langid.fit(docs).langs) == 40
    assert langid.sample_rows(docs, 1500, 400, 30).count() < 600


def test_long_texts_are_counted_whole():
    text = sentence(random.Random(4), 1000).encode()
    small, langid.PIECE = langid.PIECE, 97
    try:
        pieces = langid.counts(text)
    finally:
        langid.PIECE = small
    assert np.array_equal(pieces, langid.counts(text)) and langid.counts(text).sum() == 2 * (len(text) + 2) - 5


ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SIGNS = ALPHABET + ALPHABET.upper() + "0123456789+/"


def test_gibberish_and_unlearned_languages_are_rejected_and_clean_texts_kept(spark):
    """Fitted on the training rows only; nothing here was learned but the clean ones."""
    rng = random.Random(9)
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(train)
    clean = [r["text"] for r in train.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert sum(model.judge(t)[2] for t in clean) <= 0.004 * len(clean)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    for n in (30, 60, 200, 600, 2000, 8000):
        assert model.judge(words(ALPHABET, n))[2] and model.judge(words("bcdfghjklmnpqrstvwxz", n))[2]
        assert model.judge(words("абвгдежзиклмнопрстуфхцчшщыэюя", n))[2]
    for n in (200, 1000, 4000, 20_000):
        assert model.judge("".join(rng.choice(SIGNS) for _ in range(n)))[2]
    turned = str.maketrans(ALPHABET, ALPHABET[13:] + ALPHABET[:13])
    foreign = [t.lower().translate(turned) for t in clean if len(t) >= 200]
    assert len(foreign) > 300 and np.mean([model.judge(t)[2] for t in foreign]) > 0.99


def test_one_odd_training_text_does_not_set_the_bound():
    near, cells = np.linspace(0.7, 0.9, 100), np.full(100, 1000)
    none = np.full(langid.BANDS, np.nan)
    curve = lambda near, cells: langid.bound_curve(langid.low_quantiles(near, cells), none, (20, 0.1), 0.6)
    odd = curve(np.append(near, 0.05), np.append(cells, 1000))
    assert np.allclose(odd, curve(near, cells), atol=0.01) and (np.diff(odd) >= 0).all() and abs(odd[-1] - 0.6 * 0.71) < 0.01
    assert np.isclose(curve(near[:5], cells[:5])[[16, 20, 26]], [0.03, 0.06, 0.06]).all()  # too few texts for any band; a quarter of the cells, half the bound


def test_an_odd_training_text_gets_no_centroid():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(1, 0.2, (200, 30))) * np.repeat([[1.0] * 15 + [0.2] * 15, [0.2] * 15 + [1.0] * 15], 100, axis=0)
    odd = np.zeros((1, 30))
    odd[0, 3] = 1
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    c = langid.cluster(unit(np.concatenate([x, odd])), 4)
    assert 2 <= len(c) <= 4 and (unit(odd) @ c.T).max() < 0.6 and len(langid.cluster(unit(odd), 4)) == 1


def slow_statistics(text):
    """The features by plain loops."""
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", text) if w]
    if not words:
        return [0.0] * len(quality.FEATURES)
    angle = lambda share: math.asin(math.sqrt(min(1.0, share)))
    letters = lambda chars: sum(text.count(bytes([c])) for c in chars)
    capitals, small, n = letters(range(65, 91)), letters(range(97, 123)), len(words)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    shares = [c / len(text) for c in Counter(text).values()]
    pairs = {(words[i], words[i + 1]) for i in range(n - 1)}
    return [
        math.log(1 + n), math.log(mean), math.log(1 + math.sqrt(sum((x - mean) ** 2 for x in lengths) / n)), angle(capitals / max(1, capitals + small)), angle(letters(b"0123456789") / len(text)),
        angle(letters(b".,;:?'\"-()") / len(text)), angle(letters(b"!#$%&*+/<=>@[\\]^_`{|}~") / len(text)), angle(letters(b"\n") / len(text)), angle(letters(b" \t\r\x0b\x0c") / len(text)),
        angle(letters(range(128, 256)) / len(text)), -sum(p * math.log(p) for p in shares), angle(len(set(words)) / n), angle(len(pairs) / max(1, n - 1)), angle(max(Counter(words).values()) / n),
        angle(sum(x == 1 for x in lengths) / n), angle(sum(x > 15 for x in lengths) / n), angle(sum(w.isupper() for w in words) / n),
    ]


def test_quality_equals_a_plain_discriminant(spark):
    """Statistics by loops, moments and densities by numpy's own functions, over a whole small table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    stats = {d: slow_statistics(t) for d, t in texts.items()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in stats}
    x = {c: np.array([stats[d] for d, q in known.items() if q == c]) for c in (0, 1)}
    n, cov = {c: len(v) for c, v in x.items()}, {c: np.cov(v.T, bias=True) for c, v in x.items()}
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    cov = {c: 0.65 * s + 0.3 * both + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s)) for c, s in cov.items()}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    for d, v in stats.items():
        log = {}
        for c in (0, 1):
            diff = np.array(v) - x[c].mean(axis=0)
            log[c] = math.log(n[c]) - 0.5 * np.linalg.slogdet(cov[c])[1] - 0.5 * diff @ np.linalg.solve(cov[c], diff)
        assert abs(got[d] - 1 / (1 + math.exp(-max(-30, min(30, log[1] - log[0]))))) < 1e-6
