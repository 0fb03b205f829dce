"""Licence scans by a positional index of rare tokens.

Templates are licence notices and short licence bodies as word sequences, each
with a mandatory key phrase; the base phrases are templates that are their own
key phrase. The inverse document frequency of every key word is counted over
all documents. A document is scanned for those templates alone whose key words it
has. For each of them its highest-IDF words are looked up: their places in the
document (the postings), shifted back by their offsets in the template, are
intersected, and what is left are candidate starts. A candidate counts where
the whole key phrase stands at its offset and enough of the other words stand
in their places.

Everything runs on DataFrame expressions, row by row: no text is shuffled, and
the work is linear in the words of a document and in the occurrences of its rare words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Phrase -> label, the base of every scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label -> (notice or body, mandatory key phrase within it).
TEMPLATES = {
    "gpl-notice": ("this work is licensed under the gnu general public license version 3", "gnu general public license"),
    "gpl-terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it"),
    "apache-notice": ("licensed under the apache license version 2 0", "apache license version 2"),
    "mit-notice": ("released under the mit license", "mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    "mit-body": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
        "and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "use copy modify merge publish distribute sublicense",
    ),
    "isc-body": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "for any purpose with or without fee is hereby granted",
    ),
    "cc-notice": ("licensed under cc by", "under cc by"),
    "cc-attribution": ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    "bsd-terms": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "bsd-body": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions "
        "and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain",
    ),
    "mpl-notice": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "all-rights": ("all rights reserved", "all rights reserved"),
}

#: ASCII signs other than digits and letters: words lie between them.
SIGNS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a key phrase that are looked up: those of the highest IDF, so many.
RARE = 2
#: Part of a template's words that must stand in their places.
COVER = 0.8
#: Score of a wholly covered template where no base phrase stands.
TEMPLATE_SCORE = 0.9


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]

    @classmethod
    def of(cls, label: str, text: str, key: str) -> Template:
        out = cls(label, tuple(text.split()), tuple(key.split()))
        if not out.key or out.at is None:
            raise ValueError(f"the template {label} doesn't hold its key phrase")
        return out

    @property
    def at(self) -> int | None:
        """Offset of the key phrase."""
        return next((j for j in range(len(self.words)) if self.words[j : j + len(self.key)] == self.key), None)

    def rare(self, df: dict[str, int]) -> list[tuple[str, int]]:
        """(word, offset in the template) of the key phrase's words of the highest IDF; ties in the order of the phrase."""
        first = {w: j for j, w in reversed(list(enumerate(self.key)))}
        return [(w, self.at + j) for w, j in sorted(first.items(), key=lambda x: (df.get(x[0], 0), x[1]))[:RARE]]


def words_of(text: Column) -> Column:
    """Words in lower case: runs of ASCII letters, digits and whatever lies beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER + SIGNS, LOWER + " " * len(SIGNS)), " "), "")


def word_frequencies(counted: DataFrame) -> dict[str, int]:
    """Number of documents, of all there are, with each key word; its rows are bounded by the templates' words."""
    rows = counted.select(F.explode("known").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in rows.collect()}


def texts(words: tuple[str, ...] | list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")  # one literal, folded before it runs


def has_all(known: Column, key: tuple[str, ...]) -> Column:
    """Whether all key words are among the document's."""
    different = sorted(set(key))
    return F.size(F.array_intersect(known, texts(different))) == len(different)


def spots(words: Column, looked: list[str]) -> Column:
    """Places of any of the looked-up words, from 0: one pass over the document."""
    return F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(looked), i)))


def starts_of(template: Template, df: dict[str, int], words: Column, at: Column) -> Column:
    """Starts (array<int>, ascending) of a template's verified places; ``at``: the places of looked-up words."""
    is_word = lambda w: lambda i: F.get(words, i) == w  # noqa: E731  one argument each: a second one would be taken for the index
    back = lambda j: lambda i: i - F.lit(j)
    found = None
    for w, j in template.rare(df):
        shifted = F.transform(F.filter(at, is_word(w)), back(j))
        found = shifted if found is None else F.array_intersect(found, shifted)
    return F.filter(found, lambda s: covered(template.key, words, s + F.lit(template.at)) == len(template.key))


def covered(expected: tuple[str, ...], words: Column, start: Column) -> Column:
    """How many of the expected words stand in their places from ``start`` on."""
    stands = F.transform(texts(expected), lambda w, j: F.when(F.get(words, start + j) == w, 1).otherwise(0))
    return F.aggregate(stands, F.lit(0), lambda n, x: n + x)


def best_cover(template: Template, words: Column, starts: Column) -> Column:
    """The largest part of the template's words that stand in their places at any of ``starts``; 0 without one."""
    shares = F.transform(starts, lambda s: covered(template.words, words, s) / F.lit(float(len(template.words))))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Licence places of every document.

    Columns: doc_id, n_words, n_base (all places of base phrases), first_word
    and last_word (smallest and largest start), base_labels, labels (with the
    templates'), score: 1 with a base phrase, else TEMPLATE_SCORE times the
    best cover of a template that counts, else 0.

    Null text counts as empty: no words, no labels. Very long texts are read
    whole, their places counted without a limit. Rows that share a doc_id are
    scanned one by one, so repeated rows give repeated results; among words of
    the same IDF the first of the phrase is looked up. Other columns are
    ignored, whatever their names; an empty table gives an empty one.
    """
    base = [Template.of(label, p, p) for p, label in BASE.items()]
    more = [Template.of(label, t, k) for label, (t, k) in (TEMPLATES if templates is None else templates).items()]
    vocabulary = sorted({w for t in (*base, *more) for w in t.key})
    read = docs.select("doc_id", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    read = read.withColumn("known", F.array_intersect("words", texts(vocabulary)))
    keys = sorted({t.key for t in (*base, *more)})
    may = F.lit(False)
    for key in keys:
        may = may | has_all(F.col("known"), key)
    counted = materialize(read.select("doc_id", F.size("words").cast("long").alias("n_words"), "known", F.when(may, F.col("words")).alias("words")), "licence_words")
    df = word_frequencies(counted)
    looked = sorted({w for t in (*base, *more) for w, _ in t.rare(df)})
    words, known = F.col("words"), F.col("known")
    hits = counted.filter("words is not null").withColumn("at", spots(words, looked))
    none = F.array().cast("array<int>")
    starts = lambda t: F.when(has_all(known, t.key), starts_of(t, df, words, F.col("at"))).otherwise(none)  # noqa: E731  only templates that the document can hold
    hits = hits.select("doc_id", "n_words", "words", *[starts(t).alias(f"b{i}") for i, t in enumerate(base)], *[starts(t).alias(f"m{i}") for i, t in enumerate(more)])
    hits = hits.select(
        "doc_id", "n_words", F.flatten(F.array(*[F.col(f"b{i}") for i in range(len(base))])).alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(t.label)) for i, t in enumerate(base)])).alias("based"),
        F.array(*[F.struct(F.lit(t.label).alias("label"), F.when(F.size(f"m{i}") > 0, best_cover(t, words, F.col(f"m{i}"))).otherwise(0.0).alias("cover")) for i, t in enumerate(more)]).alias("covers"),
    )
    hits = hits.withColumn("covers", F.filter("covers", lambda c: c["cover"] >= COVER))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("covers", lambda c: c["cover"])), F.lit(0.0))
    found = hits.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        joined(F.col("based")).alias("base_labels"), joined(F.concat("based", F.transform("covers", lambda c: c["label"]))).alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(TEMPLATE_SCORE * best).alias("score"),
    )
    nothing = counted.filter("words is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )
    return found.unionByName(nothing)
