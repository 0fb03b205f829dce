import re
import time
from collections import Counter

from terraspan.llm import licenses

from .cases import empty, frame, rows

TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "released under THE mit License mit license", "Licensed under CC BY-NC 4.0.", "cc by cc by cc",
    "apache  licenses", "xapache license", "apache\tlicense\x00", "é mit license é", "émit license", "the Kit license mİt license", "", None, "gnu general public gnu general public license",
    "Permission is hereby granted free of charge, to any person obtaining a copy of this software", "mit licensé", "all rights\nreserved " * 3, "word " * 50_000 + "mit license", "cc  by", "CC-BY",
]


def truth(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for p, name in licenses.BASE.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {name} if at else set()
    more, best = set(labels), 0.0
    for name, (t, k) in licenses.TEMPLATES.items():
        t, k = t.split(), k.split()
        at = next(j for j in range(len(t)) if t[j : j + len(k)] == k)
        for s in range(-len(t), len(w)):
            if all(0 <= s + at + j < len(w) and w[s + at + j] == x for j, x in enumerate(k)):
                part = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t)) / len(t)
                if part >= 0.8:
                    more.add(name)
                    best = max(best, part)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if places else round(0.9 * best, 9)


def check(spark, data, df):
    got = [(*r[:-1], round(r["score"], 9)) for r in licenses.scan(df).collect()]
    assert Counter(got) == Counter((d, *truth(t)) for d, t in data)


def test_equals_brute_force(spark):
    data = list(enumerate(TEXTS)) + [(1, TEXTS[1]), (None, TEXTS[0])]
    check(spark, data, spark.createDataFrame([(*r, "n", 4) for r in data], "doc_id long, text string, words string, known int").repartition(3))
    check(spark, [r[:2] for r in rows()], frame(spark))
    assert licenses.scan(empty(spark)).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], docs)


def test_words_that_no_document_holds_hide_no_place(spark):
    notice, _ = licenses.TEMPLATES["gpl-terms"]
    data = [(0, notice.replace("you can", "anyone may")), (1, notice.replace("you can redistribute", "anyone may not redistribute")), (2, "nothing to see")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    check(spark, data, df)
    assert {r["doc_id"]: "gpl-terms" in r["labels"].split(",") for r in licenses.scan(df).collect()}[0]


def test_licence_bodies_and_their_edges(spark):
    """Whole bodies, with a fifth of the words wrong and with more, without their key phrase, cut at either end of the text."""
    data = []
    for name in ("mit-body", "isc-body", "bsd-body", "gpl-terms"):
        words, key = (x.split() for x in licenses.TEMPLATES[name])
        at = next(j for j in range(len(words)) if words[j : j + len(key)] == key)
        other = [j for j in range(len(words)) if not at <= j < at + len(key)]
        wrong = lambda n: " ".join("else" if j in other[:n] else w for j, w in enumerate(words))
        allowed = int(0.2 * len(words) + 1e-9)
        data += [" ".join(words), "before " + " ".join(words).upper() + ". After", wrong(allowed), wrong(allowed + 1), wrong(allowed) + " " + wrong(1)]
        data += [" ".join(words[min(allowed, at) :]), " ".join(words[: max(at + len(key), len(words) - allowed)]), " ".join(w for j, w in enumerate(words) if j != at)]
    data = list(enumerate(data))
    check(spark, data, spark.createDataFrame(data, "doc_id long, text string").repartition(2))


def test_repeats_are_counted_in_linear_time(spark):
    text = "Released under the MIT License. " * 100_000
    began = time.time()
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert tuple(row) == (1, 500_000, 100_000, 3, 499_998, "mit", "mit,mit-notice", 1.0) and time.time() - began < 60
