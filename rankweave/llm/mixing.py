"""Mixing sources to target weights by entropy balancing.

A document's rate is the number of copies that the mix takes of it. Among all rates between 0 and cap whose words meet each
source's target, the mix takes those of the largest entropy (least Kullback-Leibler divergence from one copy each). Their form
is known: rate = min(cap, exp(lambda * x)), with x the document's size over its source's mean size, and one multiplier a source
for its token constraint. The multipliers solve the convex dual by Newton steps; a step is one distributed aggregate of gradient
and curvature by source over the table of (source, size, number of documents). Steps that leave the bracket known so far are
replaced by its middle, so every source converges.

Rates become copies by systematic rounding: whole copies, and of the fractions' running sum over a source's documents in order
of size, one more copy wherever it passes an integer. A source's words then miss its target by about one document, and a few single
documents, by size, are moved to close that gap. The running sum goes
over (source, size, slot) cells, not documents; slots split cells with many documents (copies, say) by a hash, and within a
slot the documents with the least hashes get the extra copies. Everything is a function of the rows: reruns agree.

Defined results: null and empty texts have size 0 and are taken with no words; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows are separate documents; no documents, no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import WORD, held, stored

#: Computes a table with a row a source, by name, once.
Keep = Callable[[DataFrame, str], DataFrame]

MICRO = 1_000_000
#: Documents of a slot, about.
SLOT = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, weights: list[float], cap: float) -> DataFrame:
    """source, source_size, target of a table with source and source_size, a row a source.

    Weights go round the sources in order of code points, null last. Targets share share * all words by weight; a target stops at
    cap * its source's size and the excess is shared again: with ratio = limit / weight, the sources of the least ratios stop, and
    the rest have level * weight, where level is what is left over the weights left.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))  # sources, not documents
    below = Window.orderBy("ratio", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = below.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source, by ratio, that its level doesn't fill: its level holds for all that follow.
    levelled = ranked.withColumn("level", level).withColumn("held", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(whole))
    target = F.when(F.col("held").isNull() | (F.col("ratio") <= F.col("held.ratio")) & (F.col("level") >= F.col("ratio")), F.col("limit")).otherwise(F.col("weight") * F.col("held.level"))
    return levelled.select("source", "source_size", F.least(target, F.col("limit")).alias("target"))


def multipliers(cells: DataFrame, cap: float, tolerance: float = 1e-6, steps: int = 200, keep: Keep = stored) -> DataFrame:
    """key, multiplier: cells has key, x, n, goal (in units of x), open (False where all documents are taken cap times)."""
    state = keep(cells.where("open").groupBy("key").agg(F.max("goal").alias("goal")).select("key", "goal", F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")), "newton")
    for _ in range(steps):
        rate = F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("at") * F.col("x"))))
        free = rate < cap
        sums = cells.where("open").join(state.where(~F.col("done")), "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("x") * F.least(rate, F.lit(cap))).alias("value"),
            F.sum(F.when(free, F.col("n") * F.col("x") * F.col("x") * rate).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("value") - F.col("goal")
        low, high = F.when(gap < 0, F.col("at")).otherwise(F.col("low")), F.when(gap > 0, F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") - F.when(F.col("slope") > 0, gap / F.when(F.col("slope") > 0, F.col("slope")).otherwise(1.0))
        # A side without a bound yet is sought in steps that double; the value goes from 0 to cap times all, so both are found.
        beyond = F.when(gap < 0, F.greatest(2 * F.abs("at"), F.lit(1.0))).otherwise(-F.greatest(2 * F.abs("at"), F.lit(1.0)))
        middle = F.when(low.isNull() | high.isNull(), beyond).otherwise((low + high) / 2)
        within = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton) <= F.greatest(4 * F.abs("at"), F.lit(60.0)))
        following = F.when(within, newton).otherwise(middle)
        done = F.col("done") | (F.abs(gap) <= tolerance * F.col("goal")) | F.coalesce(high - low < 1e-12 * F.greatest(F.abs(low), F.lit(1.0)), F.lit(False))
        state = keep(
            state.join(sums, "key", "left").select("key", "goal", F.when(F.coalesce(done, F.lit(True)), F.col("at")).otherwise(following).alias("at"), F.coalesce(low, F.col("low")).alias("low"), F.coalesce(high, F.col("high")).alias("high"), F.coalesce(done, F.lit(True)).alias("done")),
            "newton",
        )
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"multipliers aren't settled after {steps} steps")
    return state.select("key", F.col("at").alias("multiplier"))


def corrected(extras: DataFrame, cap: int, rounds: int = 3, keep: Keep = stored) -> DataFrame:
    """Rounding leaves a source off by up to a document; in each round, one document whose size is nearest to what is left gets or gives up its extra copy."""
    for _ in range(rounds):
        left = extras.groupBy("key").agg((F.max("target") - F.sum(F.col("size") * (F.col("whole") * F.col("held") + F.col("extra")))).alias("left"))
        movable = F.when(F.col("left") > 0, (F.col("extra") < F.col("held")) & (F.col("whole") + 1 <= cap)).otherwise(F.col("extra") > 0)
        off = F.abs(F.abs("left") - F.col("size"))
        best = extras.join(left, "key").where(movable & (off < F.abs("left"))).groupBy("key").agg(F.min(F.struct(off, "size", "cell", F.signum("left").cast("long").alias("move"))).alias("best"))
        # What is kept of a round is its moves, a row a source, not all cells again.
        extras = extras.join(keep(best, "moves"), "key", "left").withColumn("extra", F.col("extra") + F.when((F.col("size") == F.col("best.size")) & (F.col("cell") == F.col("best.cell")), F.col("best.move")).otherwise(0)).drop("best")
    return extras


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: int = 2) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target (both its source's), rate, copies, taken."""
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")).withColumn("slot", F.xxhash64("id", "source", "size")), "sizes")
    documents = sized.count()
    hist = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells", documents)
    sizes = hist.count()
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    sources, letters = totals.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    keep = lambda df, name: held(df, name, sources, 100 * sources + 2 * letters)
    goals = targets(totals, share, list(weights), float(cap)).join(totals.select(F.col("source").alias("_source"), "documents"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    goals = keep(goals.withColumn("key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))), "goals")
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    mean = F.col("source_size") / F.col("documents")
    usable = F.col("source_size") > 0
    cells = hist.withColumn("key", key).join(goals.drop("source"), "key").where(usable & (F.col("size") > 0)).select(
        "key", "size", (F.col("size") / mean).alias("x"), F.col("n").cast("double").alias("n"), (F.col("target") / mean).alias("goal"), ((F.col("target") < cap * F.col("source_size")) & (F.col("target") > 0)).alias("open")
    )
    tilt = multipliers(stored(cells, "tilted", sizes), float(cap), keep=keep)
    # Cells with their rates; from here on a rate is whole copies and a fraction in millionths.
    exponent = F.col("multiplier") * F.col("size") / F.when(usable, mean).otherwise(1.0)
    full = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    rate = F.when(F.col("multiplier").isNull(), full).otherwise(F.least(F.lit(float(cap)), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), exponent)))))
    rated = hist.withColumn("key", key).join(goals.drop("source"), "key").join(tilt, "key", "left").select("key", "size", "n", "source_size", "target", rate.alias("rate"))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("part", F.floor((F.col("rate") - F.floor("rate")) * MICRO)).withColumn("slots", F.ceil(F.col("n") / SLOT).cast("int"))
    rated = stored(rated, "rates", sizes)
    keyed = sized.withColumn("key", key)
    placed = keyed.join(rated.select("key", "size", "slots").hint("merge"), ["key", "size"]).withColumn("cell", F.pmod(F.col("slot"), F.col("slots")).cast("int"))
    counts = placed.groupBy("key", "size", "cell").agg(F.count("*").alias("held"))
    order = Window.partitionBy("key").orderBy("size", "cell")
    upto = F.sum(F.col("held") * F.col("part")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + MICRO // 2
    extras = counts.join(rated.hint("merge"), ["key", "size"]).withColumn("upto", upto).select("key", "size", "cell", "held", "source_size", "target", "rate", "whole", (F.floor(F.col("upto") / MICRO) - F.floor((F.col("upto") - F.col("held") * F.col("part")) / MICRO)).alias("extra"))
    extras = corrected(stored(extras, "extras", documents), cap, keep=keep)
    rank = F.row_number().over(Window.partitionBy("key", "size", "cell").orderBy("slot", "id"))
    taken = placed.withColumn("rank", rank).join(extras.drop("held").hint("merge"), ["key", "size", "cell"])
    copies = (F.col("whole") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))
