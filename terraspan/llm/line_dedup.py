"""Boilerplate lines: those that stand on many distinct sites go.

The spread of a line over sites is a HyperLogLog sketch for each line hash,
merged by aggregation, so a line that a billion pages carry costs one sketch.
A sketch is right within a few hundredths; lines whose estimate lies within a
factor of two of the threshold are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: log2 of the registers of a sketch: an error of 1.04 / sqrt(4096), under two hundredths.
LOG_REGISTERS = 12


def normal_line(line: Column) -> Column:
    """White space at both ends off (ASCII kinds), case kept."""
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_hash(line: Column) -> Column:
    """128 bits as (long, long); nothing for a blank line."""
    line = normal_line(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, site, a, b), one row for each different line of a document."""
    hashes = F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))
    return docs.select("doc_id", F.xxhash64("source").alias("site"), F.explode(hashes).alias("h")).filter("h is not null").select("doc_id", "site", "h.a", "h.b")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(a, b) of the lines on ``min_sites`` sites or more."""
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))
    judged = spread.select("a", "b", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= min_sites / 2)
    judged = materialize(judged, "line_spread")
    sure = judged.filter(F.col("estimate") > 2 * min_sites).select("a", "b")
    near = judged.filter(F.col("estimate") <= 2 * min_sites).select("a", "b")
    # two plain steps: one row for each line and site first, so a hot line is dealt by its sites
    counted = lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(counted.filter(F.col("sites") >= min_sites).select("a", "b"))


def remove_boilerplate(docs: DataFrame, *, min_sites: int = 5) -> DataFrame:
    """``docs`` without the lines that stand on ``min_sites`` distinct sources or more.

    Added columns: n_lines, n_removed (lines of the document that went);
    columns of those names are replaced, any other name may occur. Null text
    stays null with no lines removed; empty text is one blank line, and blank
    lines are never boilerplate; a null source is one site. Rows that share a
    doc_id, or have none, share what is removed from them only where they hold
    the line. Very long texts are split whole; a line repeated within a text
    counts once. A line on exactly ``min_sites`` sources goes. An empty table gives an empty one.
    """
    added = ("n_lines", "n_removed")
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*added, "text")]) if set(docs.columns) - {*added, "text"} else F.lit(None)
    rows = docs.select("doc_id", "text", "source", held.alias("row"))
    lines = materialize(exploded(rows), "lines")  # hashes only; the text is split once for them and once for the result
    bad = materialize(boilerplate(lines, min_sites), "boilerplate")
    # only (doc_id, hash) of lines that go is collected, never text
    gone = lines.select("doc_id", "a", "b").join(bad, ["a", "b"], "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    parts, touched = lines_of(F.col("text")), F.col("gone").isNotNull() & F.col("text").isNotNull()
    kept = F.filter(parts, lambda x: ~F.coalesce(F.array_contains(F.col("gone"), line_hash(x)), F.lit(False)))
    out = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))).withColumn("kept", F.when(touched, kept))
    out = out.withColumn("n_removed", F.when(touched, F.col("n_lines") - F.size("kept")).otherwise(0))
    text = F.when(touched, F.array_join("kept", "\n")).otherwise(F.col("text"))
    own = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return out.select(*own, *added)
