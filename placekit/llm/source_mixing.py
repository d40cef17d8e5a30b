"""Mixing sources to target weights by entropy balancing.

Each document gets a rate ``min(cap, exp(lambda * size / scale))``: of all rates it is the one
nearest to 1 in relative entropy (scale is the mean size of the source) for which the expected words
of its source meet the target. The multipliers solve a convex dual, one for each source, by Newton
steps that are safeguarded by a bracket. Each step is one distributed aggregation over the counts
of documents by (source, size), never over documents. Rates are then rounded into whole copies: a
plan over these counts, longest first, hands each rounding error on to the next size, and documents
take the planned copies by their rank within (source, size).

Null sources are a source of their own, last in order. Null texts and texts without a word have
size 0 and get no copies; a source without words has target 0. Documents of equal source and size
are told apart by hashes of their id and text; equal rows may get different copies. Results are the same
for each run. Extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekit.llm.common import materialize, read_table, salted_rank, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken this many times at most.
CAP = 3.0
#: Parts of a (source, size) group for ranking.
PARTS = 32
STEPS, TOLERANCE = 60, 1e-9
#: Beyond this exponent a rate counts as 0.
FLOOR = -60.0


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """(source, source_size) with a target for each source: weights repeat in the order of sources, no
    target exceeds ``cap`` times its source, and what is over goes to the others by weight.

    The final share of a weight is the one at which, in the order of cap * size / weight, the capped
    sources and the rest together take everything. One row for each source goes through the window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("top", F.col("source_size") * cap)
    rise = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    full = Window.partitionBy()
    rest = F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.sum("source_size").over(full) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    s = s.withColumn("share", left / rest)
    # the first source, in this order, that the share doesn't fill sets the share of all after it
    first = F.min(F.when(F.col("top") >= F.col("share") * F.col("weight"), F.struct(F.col("top") / F.col("weight"), F.col("share")))).over(full)
    share = F.coalesce(first.getField("share"), F.lit(float("inf")))
    return s.withColumn("target", F.least(F.col("top").cast("double"), share * F.col("weight"))).select("source", "source_size", "target")


def rate(lam: Column, x: Column, cap: float = CAP) -> Column:
    e = lam * x
    return F.when(e < FLOOR, 0.0).otherwise(F.least(F.lit(cap), F.exp(F.least(e, F.lit(np.log(cap) + 1)))))


def balance(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """``goals`` with lam and scale: Newton steps on the dual of each source, all sources at once.

    cells: source, size, n. A source whose target is its cap takes every document ``cap`` times, one
    whose target is 0 takes none; both are settled before the first step.
    """
    state = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale"))
    state = _match(goals, state, ["source"]).select("source", "source_size", "target", F.greatest("scale", F.lit(1e-9)).alias("scale"))
    full, empty = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.col("target") <= 0
    wide = F.lit(1e6)
    state = state.withColumn("lam", F.when(empty, -wide).when(full, wide).otherwise(0.0)).withColumn("done", full | empty).withColumn("lo", -wide).withColumn("hi", wide)
    state = materialize(state)
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        r = rate(F.col("lam"), x, cap)
        got = _match(cells, state.where("not done").select("source", "lam", "scale"), ["source"])
        sums = got.groupBy("source").agg(F.sum(r * F.col("size") * F.col("n")).alias("at"), F.sum(F.when(r < cap, r * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"))
        nxt = _match(state, sums, ["source"], "left")
        over = F.col("at") > F.col("target")
        nxt = nxt.withColumn("lo", F.when(F.col("at").isNull() | over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - (F.col("at") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        # without a slope or out of the bracket: halve the bracket, or double the distance while it is open
        wider = F.when(over, F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise(F.greatest(F.col("lam") * 2, F.lit(1.0)))
        inner = F.when((F.col("lo") > -wide) & (F.col("hi") < wide), (F.col("lo") + F.col("hi")) / 2).otherwise(wider)
        safe = F.when(step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi")), F.least(F.greatest(step, F.col("lam") - 8), F.col("lam") + 8)).otherwise(inner)
        near = F.abs(F.col("at") - F.col("target")) <= TOLERANCE * F.col("target")
        stuck = F.col("hi") - F.col("lo") < 1e-13
        done = F.col("done") | F.coalesce(near | stuck, F.lit(True))
        state = materialize(nxt.select("source", "source_size", "target", "scale", F.when(done, F.col("lam")).otherwise(safe).alias("lam"), done.alias("done"), "lo", "hi"))
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "source_size", "target", "scale", "lam")


def _match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, on, how).drop(*[f"__{k}" for k in keys])


def _plan(cap: float):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        copies, owed = np.zeros(len(pdf), np.int64), 0.0
        for i, (size, n, r) in enumerate(zip(pdf["size"], pdf["n"], pdf["rate"], strict=True)):
            if size:
                want = n * r + owed / size
                copies[i] = min(max(round(want), 0), int(cap) * n)
                owed = (want - copies[i]) * size
        return pdf.assign(copies=copies)[["source", "size", "n", "copies"]]

    return plan


def mix(docs: DataFrame, size: str, source: str, order: list[str], cap: float = CAP, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` (which has ``size`` and ``source`` columns) with source_size, target, rate and copies."""
    slim = docs.select(F.col(source).alias("source"), F.col(size).alias("size"))
    cells = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    solved = balance(cells, goals, cap)
    rated = _match(cells, solved.select("source", "lam", "scale"), ["source"]).withColumn("rate", rate(F.col("lam"), F.col("size") / F.col("scale"), cap))
    planned = rated.groupBy("source").applyInPandas(_plan(cap), "source string, size long, n long, copies long")
    planned = _match(planned, solved.select("source", "source_size", "target"), ["source"])
    planned = materialize(planned.withColumnsRenamed({"source": "__source", "size": "__size", "n": "__n", "copies": "__copies"}))
    hashes = F.xxhash64(*[F.col(c) for c in order])
    ranked = salted_rank(docs.withColumn("__s", F.col(source)).withColumn("__z", F.col(size)), ["__s", "__z"], [hashes, *order], hashes, PARTS, "__rank")
    out = ranked.join(planned, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__z") == F.col("__size")))
    each = F.floor(F.col("__copies") / F.col("__n")).cast("long")
    copies = each + (F.col("__rank") < F.col("__copies") - each * F.col("__n")).cast("long")
    return out.withColumn("copies", copies).drop("__s", "__z", "__source", "__size", "__n", "__copies", "__rank")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = materialize(rows)  # the words of each text are counted once
    mixed = mix(rows, "size", "source", ["doc_id", "text_hash"])
    return mixed.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
