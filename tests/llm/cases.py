"""Small tables with every awkward case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _part int, component string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed=5):
    """Near and exact copies, nulls in any column, empty, short and very long texts, repeated rows, ties."""
    rng = random.Random(seed)
    out, base = [], sentence(rng, 120)
    for i in range(12):  # a chain of near copies, each a few words off the one before
        words = base.split()
        words[(i * 9) % 110] = f"changed{i}"
        base = " ".join(words)
        out.append((i, base, "en", "a"))
    long = sentence(rng, 30_000)
    out += [(20, long, "en", "b"), (21, long + " more", "en", None), (22, long, None, "c")]
    out += [(30, None, "en", "a"), (31, "", "de", "b"), (32, " \n\t ", None, None), (33, "Tiny Text", "en", "é"), (34, "tiny text", "en", "z"), (35, "tiny text", "en", "z")]
    out += [(None, sentence(rng, 50), "en", "a"), (None, "no id", "fr", "b")]
    out += [(40, "Über Été 中文 " * 30, "de", "b")] * 2
    out += [(50 + i, sentence(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "d", "e"])) for i in range(60)]
    return [(d, t, g, s, len(t or ""), 7, 3, 1, "x") for d, t, g, s in out]


def frame(spark, seed=5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((v is not None, v) for v in r)
