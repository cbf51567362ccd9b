"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every copy of a document gets a virtual finish time, the cumulative words of
its shuffled source divided by the source's target. All copies are sorted by
that time, which interleaves the sources in proportion to their targets, and
the order is truncated where its running words reach the total budget, near
time 1, where every source has its target.

No sum or sort needs a whole source or the whole order in one task. Documents
are dealt into hash ranges of their source, and copies into ranges of finish
time; ranges are summed first, and only rows of one range are sorted together.
Of the ranges of finish time only the one in which the budget ends has to be
sorted to know the cut: earlier ones are taken whole. There are as many ranges
as the root of the number of rows, so that neither ranges nor rows of a range
are many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lanternwatch.llm.common import SPACE_WORD, doc_key, materialize

#: Weights dealt to the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share=BUDGET_SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Fills by weight up to ``max_repeats`` times a source's size; what a full
    source cannot take is shared again by weight. Sorted by size over weight,
    the sources before the first one that keeps room are exactly the full ones.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("_r", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = W.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_r").asc())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = caps.withColumn("_total", F.sum("source_size").over(everything)).withColumn(
        "_level",
        (F.col("_total") * F.lit(float(budget_share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    ).withColumn("_place", F.row_number().over(order))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct("_place", "_level"))
    open_level = F.min(fits).over(everything)["_level"]
    target = F.when(open_level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), open_level * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def shuffled(doc_id: Column, text: Column, seed: int) -> Column:
    """A pseudo-random whole number of 60 bits that follows from the row alone."""
    row = F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")


def finish_times(docs: DataFrame, seed: int = 17, max_repeats: int = MAX_REPEATS, **targets) -> DataFrame:
    """Every document with ``k`` (the row's key), ``doc_id, source, size, source_size, target``, its place ``h`` in the shuffle and ``finish array<double>``.

    ``finish`` has the virtual finish times of the document's copies. Null text
    counts 0 words; null is a source of its own; repeated rows are separate
    documents. Documents without words, and those of a source whose target is
    0, have no copies.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id"), F.col("text"), seed).alias("h"), doc_key(F.col("doc_id"), F.col("text")).alias("k"))
    spread = max(1, math.isqrt(docs.count()))
    rows = materialize(rows, "sizes").withColumn("_b", F.col("h") % F.lit(spread))
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    plan = source_targets(sums.select("source", F.col("_s").alias("size")), max_repeats=max_repeats, **targets)
    ranges = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select("o.source", "o._b", "_off", "source_size", "target")
    inside = W.partitionBy("source", "_b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    cumulated = rows.withColumn("_cum", F.sum("size").over(inside))
    joined = cumulated.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._b") == F.col("r._b")))
    copies = F.array(*[F.col("_off") + F.col("_cum") + F.lit(e) * F.col("source_size") for e in range(max_repeats)])
    finish = F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(copies, lambda c: c / F.col("target"))).otherwise(F.array().cast("array<double>"))
    return joined.select("k", "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "h", finish.alias("finish"))


def _place(finish: Column, epoch: Column) -> Column:
    """Where a copy stands in the global order."""
    return F.struct(finish.alias("finish"), F.col("h"), F.col("doc_id"), epoch.alias("epoch"))


def truncation(times: DataFrame) -> DataFrame:
    """One row, ``cut``: the place of the first copy in the global order that is not taken; null if the budget takes all.

    The budget is the sum of the targets. A copy is taken if at least half of
    it lies within the budget, and all before it are.
    """
    spread = max(1, math.isqrt(times.count()))
    copies = times.select("size", "h", "doc_id", F.posexplode("finish").alias("epoch", "finish"))
    copies = copies.withColumn("range", F.floor(F.col("finish") * F.lit(spread)))
    sums = materialize(copies.groupBy("range").agg(F.sum("size").alias("words")), "ranges")
    budget = times.groupBy("source").agg(F.first("target").alias("target")).agg(F.sum("target").alias("budget"))
    running = sums.withColumn("upto", F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)))
    # the range in which the running words pass the budget, and what comes after it
    last = materialize(running.crossJoin(F.broadcast(budget)).where("upto > budget").orderBy("range").limit(1).select("range", (F.col("upto") - F.col("words")).alias("before"), "budget"), "last-range")
    tail = copies.join(F.broadcast(last), "range")
    order = W.orderBy("finish", "h", "doc_id", "epoch").rowsBetween(W.unboundedPreceding, 0)
    placed = tail.withColumn("middle", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
    inside = placed.where("middle > budget").agg(F.min(_place(F.col("finish"), F.col("epoch"))).alias("cut"))
    beyond = copies.crossJoin(F.broadcast(last.select(F.col("range").alias("_last")))).where(F.col("range") > F.col("_last")).agg(F.min(_place(F.col("finish"), F.col("epoch"))).alias("cut"))
    return inside.union(beyond).agg(F.min("cut").alias("cut"))


def schedule(docs: DataFrame, **options) -> DataFrame:
    """``finish_times`` with ``n_taken``, the copies that stand before the cut of the global order."""
    times = materialize(finish_times(docs, **options), "finish-times")
    cut = materialize(truncation(times), "cut")
    with_cut = times.crossJoin(F.broadcast(cut))
    early = F.size(F.filter("finish", lambda t, e: F.col("cut").isNull() | (_place(t, e) < F.col("cut"))))
    return with_cut.withColumn("n_taken", early.cast("long")).drop("cut")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: one row per taken copy, ``doc_id, source, size, epoch, finish``, range-sorted by finish time."""
    taken = schedule(docs, **options).where("n_taken > 0")
    spread = taken.select("doc_id", "source", "size", "h", F.posexplode(F.slice("finish", F.lit(1), F.col("n_taken").cast("int"))).alias("epoch", "finish"))
    return spread.orderBy("finish", "h", "doc_id", "epoch").drop("h")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, one row per taken copy: all columns, ``epoch`` and ``finish``.

    The order of the mixture is that of ``finish``; texts are not sorted by it,
    only dealt once to meet their schedule. Rows equal in id and text share one
    schedule. Columns of the input named ``epoch`` or ``finish`` are replaced;
    no other name clashes.
    """
    plan = schedule(docs, **options).where("n_taken > 0").groupBy("k").agg(F.first(F.slice("finish", F.lit(1), F.col("n_taken").cast("int"))).alias("finish"))
    columns = [c for c in docs.columns if c not in ("epoch", "finish")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), doc_key(F.col("doc_id"), F.col("text")).alias("k"))
    return rows.join(plan, "k").select("row", F.posexplode("finish").alias("epoch", "finish")).select("row.*", "epoch", "finish")


def mix_report(docs: DataFrame) -> DataFrame:
    """Digest of the schedule, one row per document."""
    return schedule(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_taken")).alias("taken"), "source", "n_taken")
