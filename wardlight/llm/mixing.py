"""Mixing sources to target weights by entropy balancing [native].

Document rates r minimise sum(r ln r - r + 1) over documents, with 0 <= r <= cap, subject to one token
constraint a source: sum(r * size) = target. The dual has one multiplier a source and the solution is
an exponential tilt, r = min(cap, exp(lambda * size / mean_size)). Newton steps on the dual need two sums a
source, taken by Spark over the (source, size) histogram; sources, targets and multipliers are tables too. Rates become
whole copies by systematic rounding in size order; the few words left over are spent on documents of fitting
sizes, so a source misses its target by less than its shortest documents.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch, numbered

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
CELL_ROWS = 32_768


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with rank, from 0 by code point of source, null last: ranges are ranked apart and counted, so no task sorts all."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = scratch.save(sources.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "sources-dealt")
    before = dealt.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))  # one row a partition
    row = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__row", row).join(F.broadcast(before.drop("count")), "__part").withColumn("rank", F.col("__before") + F.col("__row") - 1).drop("__part", "__row", "__before")


def with_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (size, weight) with target: shares of all sizes by weight; a share above cap * size stops there, the rest is reshared.

    A source is at its cap where level * weight exceeds it; capping raises the level of the others until it stands still.
    """
    total, level = sources.agg(F.sum("size")).first()[0] or 0, 0.0
    while True:
        over = level * F.col("weight") > cap * F.col("size")
        r = sources.agg(F.sum(F.when(over, cap * F.col("size")).otherwise(0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("unit")).first()
        if not r["unit"]:
            return sources.withColumn("target", (cap * F.col("size")).cast("double"))
        new = (total - r["capped"]) / r["unit"]
        if new <= level:
            return sources.withColumn("target", F.least((cap * F.col("size")).cast("double"), level * F.col("weight")))
        level = new


def _rate(size: Column, lam: Column, mean: Column, cap: int) -> Column:
    """exp is cut where the cap holds anyway, so it never overflows."""
    return F.when(size == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(math.log(cap) + 1)))))


def solve_tilts(hist: DataFrame, sources: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """sources (key, size, target, mean) with full, lam: the multiplier, or all documents at the cap; hist: key, size, n.

    A safeguarded Newton step for all sources is one job; steps end when each source meets its target to 1e-9 or its
    multiplier stands still, which halving its bracket forces in the end.
    """
    inf = F.lit(math.inf)
    full = ~((F.col("size") > 0) & (F.col("target") < cap * F.col("size") * (1 - 1e-12)))
    state = sources.withColumn("full", full).withColumn("done", full).withColumn("lam", F.lit(0.0)).withColumn("lo", -inf).withColumn("hi", inf)
    r, w = _rate(F.col("size"), F.col("lam"), F.col("mean"), cap), F.col("n") * F.col("size")
    lam, miss = F.col("lam"), F.col("got") - F.col("target")
    lo, hi = F.when(miss < 0, lam).otherwise(F.col("lo")), F.when(miss >= 0, lam).otherwise(F.col("hi"))
    newton = F.when(F.col("slope") > 0, lam - miss / F.col("slope"))
    inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - lam) <= 4 + 4 * F.abs(lam))
    widened = F.when(F.col("lo") == -inf, F.least(lam, F.col("hi")) * 2 - 1).when(F.col("hi") == inf, F.greatest(lam, F.col("lo")) * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
    for turn in itertools.count():
        state = scratch.save(state, f"tilts-{turn}")
        if state.filter("not done").isEmpty():
            return state.select("key", F.col("size").alias("source_size"), "target", "mean", "full", "lam")
        open_ = state.filter("not done").select("key", "lam", "mean")
        sums = hist.join(open_, "key").groupBy("key").agg(F.sum(w * r).alias("got"), F.sum(F.when(r < cap, w * r * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        met = F.abs(miss) <= 1e-9 * F.greatest(F.lit(1.0), F.col("target"))
        moved = state.join(sums, "key", "left").withColumn("lo", F.when(F.col("done"), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("done"), F.col("hi")).otherwise(hi))
        moved = moved.withColumn("to", F.when(F.col("done") | met, lam).otherwise(F.coalesce(F.when(inside, newton), widened)))
        state = moved.withColumn("done", F.col("done") | (F.col("to") == lam)).withColumn("lam", F.col("to")).select(state.columns)


def _share(k: Column, v: Column, n: Column) -> Column:
    """floor(k * v / n) in whole numbers; decimals where products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    whole, part = F.call_function("div", v, n), v % n
    return k * whole + F.when(n < 2**31, F.call_function("div", k * part, n)).otherwise(F.call_function("div", wide(k) * wide(part), wide(n)))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_to_targets(docs: DataFrame, weights: list[float] | None = None, cap: int = CAP, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row for each row of docs.

    size: words of the text (null: 0). weights repeat over the sources sorted by code point, null last
    (default 1, 2, 3). Documents without words are never taken. Rows with equal source, size and id are
    interchangeable and numbered by counting; a re-run makes the same choice. An empty table gives an empty result; other
    columns, of any names, are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    weights = weights or [1.0, 2.0, 3.0]
    size = word_count(F.col(text_col))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # joins by it need no null-safe test
    rows = scratch.save(numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))), "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("filled"))
    by_rank = F.array(*[F.lit(float(w)) for w in weights])
    sources = ranked(per, scratch).select(
        key.alias("key"), "size", F.get(by_rank, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
        F.when(F.col("size") > 0, F.col("size") / F.col("filled")).otherwise(1.0).alias("mean"),
    )
    sources = with_targets(scratch.save(sources, "sources"), cap)

    spread = max(16, rows.count() // CELL_ROWS)
    cell = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(spread)).cast("int")
    rows = rows.select("doc_id", "source", "copy", "size", key.alias("key"), cell.alias("cell"))
    cells = scratch.save(rows.groupBy("key", "size", "cell").count(), "cells")
    hist = scratch.save(cells.groupBy("key", "size").agg(F.sum("count").alias("n")), "hist")
    facts = solve_tilts(hist, sources, scratch, cap)

    rate = F.when(F.col("full"), F.when(F.col("size") > 0, float(cap)).otherwise(0.0)).otherwise(_rate(F.col("size"), F.col("lam"), F.col("mean"), cap))
    by_size = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)  # distinct sizes of a source
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    start = F.coalesce(F.sum(part * F.col("n")).over(by_size), F.lit(0.0))
    plan = (
        hist.join(facts, "key").withColumn("rate", rate).withColumn("start", start)
        .select("key", "size", "n", "source_size", "target", F.least(cap * F.col("n"), F.col("n") * whole + F.floor(F.col("start") + F.col("n") * part + 0.5) - F.floor(F.col("start") + 0.5)).alias("v"))
    )
    plan = scratch.save(plan, "plan")
    plan = plan.join(_corrections(plan, cap), ["key", "size"], "left").select("key", "size", "n", "source_size", "target", (F.col("v") + F.coalesce("k", F.lit(0))).alias("v"))
    within = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most `spread` rows
    begun = cells.join(plan, ["key", "size"]).withColumn("before", F.coalesce(F.sum("count").over(within), F.lit(0))).drop("count")
    begun = scratch.save(begun, "begun")
    order = Window.partitionBy("key", "size", "cell").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 1)), "doc_id", "copy")
    at = (F.col("before") + F.col("rn")).cast("long")
    return (
        rows.withColumn("rn", F.row_number().over(order)).join(begun.hint("merge"), ["key", "size", "cell"])  # its files are small, its rows are not: no broadcast
        .withColumn("copies", _share(at, F.col("v"), F.col("n")) - _share(at - 1, F.col("v"), F.col("n")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def _corrections(plan: DataFrame, cap: int) -> DataFrame:
    """key, size, k: copies to add to or take from the documents of a size so that the words meet the target.

    What systematic rounding leaves over is spent from the largest size that fits down to the smallest; the
    fold runs over the distinct sizes of a source: d of them hold d * d / 2 words at least, so they stay few. Picks are fewer.
    """
    left = plan.groupBy("key").agg(
        F.first("target").alias("target"), F.sum(F.col("size") * F.col("v")).alias("got"),
        F.sort_array(F.collect_list(F.when(F.col("size") > 0, F.struct("size", "n", "v"))), asc=False).alias("sizes"),
    )

    def spend(state, x):
        fits = F.floor(F.abs(state["left"]) / x["size"]).cast("long")
        k = F.when(state["left"] > 0, F.least(fits, cap * x["n"] - x["v"])).otherwise(-F.least(fits, x["v"]))
        pick = F.array(F.struct(x["size"].alias("size"), k.alias("k")))
        return F.struct((state["left"] - k * x["size"]).alias("left"), F.when(k != 0, F.concat(state["picks"], pick)).otherwise(state["picks"]).alias("picks"))

    none = F.struct((F.col("target") - F.col("got")).alias("left"), F.expr("cast(array() as array<struct<size:bigint,k:bigint>>)").alias("picks"))
    return left.select("key", F.aggregate("sizes", none, spend, lambda s: s["picks"]).alias("p")).select("key", F.inline("p"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by source: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_to_targets(docs).select("doc_id", "size", "source_size", "target", "taken")
