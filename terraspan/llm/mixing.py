"""Mixing sources to target weights by entropy balancing.

Among all non-negative document rates ``r`` the mix takes the one closest, in
relative entropy, to taking each document once, subject to a token total for
every source and a ceiling on ``r``:

    minimise   sum_d m_d (r_d ln r_d - r_d)
    subject to sum_{d in s} size_d r_d = target_s,   r_d <= ceiling

The base measure ``m_d = (size_d + mean_s) / 2`` stands half for documents and
half for tokens, so neither long nor short documents are starved. Its solution
is an exponential tilt ``r_d = min(ceiling, exp(lambda_s x_d))`` with
``x_d = 2 size_d / (size_d + mean_s)``. The multipliers minimise the convex
dual; its Hessian is diagonal, one entry a source, and each Newton iteration
takes gradient and curvature from one distributed aggregation over the exact
histogram of (source, size). A bracket guards each step.

Rates become whole copies: everyone takes ``floor(r)`` and, cell by cell of the
histogram from long to short documents, as many get one more as brings the
source's running total nearest to its target, chosen by a hash of the id.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_index, lookup, materialize, word_count

#: Beyond this many documents of one source and size, the choice of those that get one more copy is dealt over several tasks.
CELL_ROWS = 100_000
#: Newton iterations at most, and how many of them one job makes before it looks whether they have converged.
NEWTON_STEPS, STEPS_A_JOB = 60, 4


def _hash(*cols: Column) -> Column:
    return F.xxhash64(*cols, F.lit(20_231))


def source_targets(sources: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """``target`` for each row of ``sources`` (source, total): weights repeat in code-point order, null last.

    All sizes are shared by weight; a share beyond ``ceiling`` times the
    source's own size stops there and the excess is shared again. At each
    round one row of sums reaches the driver.
    """
    ranked = global_index(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    top = ceiling * F.col("total").cast("double")
    row = ranked.agg(F.sum("total").alias("t"), F.sum("weight").alias("w")).first()
    whole, level, held = float(row["t"] or 0), (float(row["t"] or 0) / row["w"] if row["w"] else 0.0), -1
    while True:
        over = top < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, top)).alias("t"), F.sum(F.when(~over, F.col("weight"))).alias("w")
        ).first()
        if row["n"] == held or not row["w"]:
            break
        held, level = row["n"], (whole - (row["t"] or 0.0)) / row["w"]
    return ranked.withColumn("target", F.least(top, F.lit(level) * F.col("weight")))


def solve_dual(hist: DataFrame, targets: DataFrame, ceiling: float, tolerance: float = 1e-7) -> DataFrame:
    """(place, lam) that meet the targets; ``hist``: place, mass, n, x."""
    want = F.col("target")
    state = targets.select(
        "place", "target", "total",
        F.when(F.col("total") == 0, 0.0).when(want >= ceiling * F.col("total") * (1 - 1e-9), 1e9).otherwise(F.log(F.try_divide(want, F.col("total")))).alias("lam"),
        F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        ((F.col("total") == 0) | (want >= ceiling * F.col("total") * (1 - 1e-9))).alias("done"),
    )
    for _ in range(NEWTON_STEPS // STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            state = newton_step(hist, state, ceiling, tolerance)
        state = materialize(state, "dual")
        if state.filter(~F.col("done")).isEmpty():
            break
    # what the order of sums leaves in the last digits goes, so that reruns round alike
    return state.select("place", F.round("lam", 9).alias("lam"))


def newton_step(hist: DataFrame, state: DataFrame, ceiling: float, tolerance: float) -> DataFrame:
    """The state after one guarded step: the gradient and the curvature of every source in one aggregation."""
    own = ["place", "target", "total", "lam", "lo", "hi", "done"]
    rate, mass, want = F.exp(F.col("lam") * F.col("x")), F.col("n") * F.col("mass"), F.col("target")
    sums = hist.join(state, "place").groupBy(*own).agg(F.sum(mass * F.least(rate, F.lit(ceiling))).alias("f"), F.sum(F.when(rate < ceiling, mass * F.col("x") * rate).otherwise(0.0)).alias("g"))
    done = F.col("done") | (F.abs(F.col("f") - want) <= tolerance * want) | (F.col("hi") - F.col("lo") < 1e-12)
    sums = sums.withColumns({"lo": F.when(F.col("f") < want, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("f") >= want, F.col("lam")).otherwise(F.col("hi")), "done": done})
    step = F.col("lam") + F.try_divide(want - F.col("f"), F.col("g"))
    inside = (step > F.col("lo")) & (step < F.col("hi"))
    return sums.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).select(*own)


def _round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """``more``: how many documents of each cell of one source take one more copy.

    A source has at most sqrt(2 x its words) different sizes, so its cells fit a task.
    """
    cells = cells.sort_values("mass", ascending=False)
    left, more = 0.0, []
    for mass, n, rate in zip(cells["mass"], cells["n"], cells["rate"], strict=True):
        want = n * (rate - math.floor(rate))
        k = int(min(n, max(0, math.floor(want + left / mass + 0.5)))) if mass else 0
        left += (want - k) * mass
        more.append(k)
    return cells.assign(more=more)[["place", "mass", "more"]]


def rules(items: DataFrame, weights: tuple[float, ...], ceiling: int) -> DataFrame:
    """What decides of every document: source, mass, source_size, target, rate, cuts.

    ``items``: doc_id, source, size, m and mass, one row for each different (doc_id, source, size).
    A document of a source and mass takes ``floor(rate)`` copies, and one more
    if its draw is at most the cut of its salt.
    """
    hist = items.groupBy("source", "mass").agg(F.count(F.lit(1)).alias("n"))
    sources = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("mass")).alias("total"), F.sum("n").alias("docs"))
    targets = materialize(source_targets(sources, weights, float(ceiling)), "targets")
    same = F.col("h.source").eqNullSafe(F.col("t.source"))
    mean = F.col("t.total") / F.col("t.docs")
    hist = materialize(
        hist.alias("h").join(targets.alias("t"), same).select(
            "t.place", "h.mass", "h.n", F.coalesce(F.try_divide(2.0 * F.col("h.mass"), F.col("h.mass") + mean), F.lit(0.0)).alias("x")
        ),
        "histogram",
    )
    lam = solve_dual(hist, targets, float(ceiling))
    cells = hist.join(lam, "place").withColumn("rate", F.least(F.exp(F.col("lam") * F.col("x")), F.lit(float(ceiling))))
    more = cells.select("place", "mass", "n", "rate").groupBy("place").applyInPandas(_round_cells, "place long, mass long, more long")
    cells = materialize(
        cells.join(more, ["place", "mass"])
        .join(targets.select("place", "source", F.col("total").alias("source_size"), "target"), "place")
        .withColumn("salts", F.ceil(F.col("n") / CELL_ROWS).cast("int")),
        "cells",
    )
    place = ["place", "mass", "salt"]
    dealt = (
        items.alias("i").join(lookup(cells).alias("c"), F.col("i.source").eqNullSafe(F.col("c.source")) & (F.col("i.mass") == F.col("c.mass")))
        .select("i.doc_id", "c.place", "c.mass", "c.n", "c.more", "c.salts", draw_of(F.col("i.doc_id"), F.col("i.source")).alias("draw"))
        .withColumn("salt", salt_of(F.col("draw"), F.col("salts")))
    )
    subs = dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("all"), F.first("more").alias("k"))
    cum = F.sum("c").over(Window.partitionBy("place", "mass").orderBy("salt"))
    upto = lambda c: F.expr(f"(k * ({c})) div all")
    subs = subs.withColumn("cum", cum).select(*place, (upto("cum") - upto("cum - c")).alias("k"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("draw", "doc_id"))
    last = dealt.withColumn("rank", rank).join(subs, place).filter(F.col("rank") == F.col("k")).select(*place, "draw")
    cuts = last.groupBy("place", "mass").agg(F.map_from_entries(F.collect_list(F.struct("salt", "draw"))).alias("cuts"))  # one entry for each CELL_ROWS documents
    return materialize(cells.join(cuts, ["place", "mass"], "left").select("source", "mass", "source_size", "target", "rate", "salts", "cuts"), "rules")


def draw_of(doc_id: Column, source: Column) -> Column:
    return _hash(doc_id, source)


def salt_of(draw: Column, salts: Column) -> Column:
    return F.pmod(F.xxhash64(draw), salts).cast("int")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), ceiling: int = 3, size: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source and whatever else) with what the mix takes of each row.

    Added columns: size, source_size, target, rate, copies, taken
    (= copies x size); they replace columns of those names. Any other name may occur.

    Null text has size 0; a null source is a source of its own, ordered last;
    a null doc_id is an id like any other. Rows alike in doc_id, source and
    size share one decision and are weighed together; otherwise ties are
    settled by a hash of doc_id and source. Documents of size 0 keep one copy
    and take nothing. Very long texts are counted whole. An empty table gives
    an empty one.

    Decisions are made on (doc_id, source, size). What is joined to the rows
    is one rule for each source and size, and the rows that share an id; each
    is broadcast if it has LOOKUP_ROWS rows at most, so that no text is
    shuffled, and merged with the rows beyond that.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    column = lambda c: F.col(f"`{c.replace('`', '``')}`")
    size = word_count(F.col("text")) if size is None else size
    sized = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), "doc_id", "source", size.cast("long").alias("size"))
    keys = ["doc_id", "source", "size"]
    items = materialize(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).withColumn("mass", F.col("m") * F.col("size")), "items")
    found = rules(items, weights, ceiling)
    repeated = items.filter("m > 1").select(*keys, "m")
    if repeated.isEmpty():
        massed = sized.withColumn("mass", F.col("size"))
    else:
        alike = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size"))
        massed = sized.alias("d").join(lookup(repeated).alias("r"), alike, "left").select("d.*", (F.col("d.size") * F.coalesce("r.m", F.lit(1))).alias("mass"))
    same = F.col("d.source").eqNullSafe(F.col("u.source")) & (F.col("d.mass") == F.col("u.mass"))
    out = massed.alias("d").join(lookup(found).alias("u"), same).select("d.row", "d.doc_id", "d.source", "d.size", "u.source_size", "u.target", "u.rate", "u.salts", "u.cuts")
    draw = draw_of(F.col("doc_id"), F.col("source"))
    one_more = F.coalesce(draw <= F.try_element_at("cuts", salt_of(draw, F.col("salts"))), F.lit(False))
    copies = (F.floor("rate") + F.when(one_more, 1).otherwise(0)).cast("int").alias("copies")
    out = out.select("row", *added[:4], copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, columns unchanged, whatever their names.

    Rows of size 0 (null and empty texts) stay once. Otherwise as in ``mix``.
    """
    names = docs.columns
    column = lambda c: F.col(f"`{c.replace('`', '``')}`")
    plan = mix(docs.select("doc_id", "text", "source", F.struct(*[column(c) for c in names]).alias("_row")), **options)
    repeated = plan.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return repeated.select([F.col("_row").getField(c).alias(c) for c in names])
