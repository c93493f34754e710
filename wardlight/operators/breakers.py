"""Circuit breakers over whole call histories, as a parallel scan.

A breaker that was just tried again knows no failure that still counts, as it stays shut off for at least as long as failures count. So its
next opening is a function of the time it was tried again: the first run of ``threshold`` failures in a row within the window that begins after
it. These runs, the possible openings, are found in time slices with a margin of the slice before; each points to the opening that would
follow it. The openings that take place are those on the path from an agent's first one, and composing the pointers with themselves
(1, 2, 4, .. steps) marks them all in as many rounds as the path's length has digits. No task ever holds an agent's history, only a slice of it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.sources.shared import Workspace


def possible_openings(calls: DataFrame, threshold: int, window: int, length: int) -> DataFrame:
    """agent, sec, seq of each call that ends ``threshold`` failures in a row in less than ``window`` seconds, with begin, when the run began."""
    own, following = F.floor(F.col("sec") / length), F.floor(F.col("sec") / length) + 1
    margin = F.when(F.col("sec") > following * length - window, F.struct(following.alias("slice"), F.lit(True).alias("margin")))
    each = calls.withColumn("__s", F.explode(F.array_compact(F.array(F.struct(own.alias("slice"), F.lit(False).alias("margin")), margin)))).select("agent", "sec", "seq", "failed", "__s.*")
    order = Window.partitionBy("agent", "slice").orderBy("sec", "seq")
    row = order.rowsBetween(1 - threshold, 0)
    runs = each.withColumn("n", F.count_if("failed").over(row)).withColumn("begin", F.min("sec").over(row))
    return runs.filter(~F.col("margin") & (F.col("n") == threshold) & (F.col("sec") - F.col("begin") < window)).select("agent", "sec", "seq", "begin")


def followed(openings: DataFrame, reset: int, length: int) -> DataFrame:
    """openings with next_sec, next_seq: the first run that begins more than ``reset`` seconds after; null if none does.

    Runs and questions are sorted within a slice; where its later runs are used up, the first run of the agent's next slice with any is the answer.
    """
    run = F.struct("begin", "sec", "seq")
    runs = openings.select("agent", F.col("begin").alias("t"), run.alias("run"), F.lit(None).cast("struct<sec:bigint,seq:bigint>").alias("asks"))
    asks = openings.select("agent", (F.col("sec") + reset).alias("t"), F.lit(None).cast("struct<begin:bigint,sec:bigint,seq:bigint>").alias("run"), F.struct("sec", "seq").alias("asks"))
    both = runs.unionByName(asks).withColumn("slice", F.floor(F.col("t") / length))
    later = Window.partitionBy("agent", "slice").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)
    answered = both.withColumn("next", F.min("run").over(later)).filter("asks is not null")
    first = both.groupBy("agent", "slice").agg(F.min("run").alias("first"))  # one row a slice of time
    beyond = Window.partitionBy("agent").orderBy(F.desc("slice")).rangeBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("beyond", F.min("first").over(beyond)).select("agent", "slice", "beyond")
    found = answered.join(first, ["agent", "slice"]).withColumn("next", F.coalesce("next", "beyond"))
    return found.select("agent", "asks.sec", "asks.seq", F.col("next.sec").alias("next_sec"), F.col("next.seq").alias("next_seq"))


def on_the_path(pointers: DataFrame, work: Workspace) -> DataFrame:
    """The openings (agent, sec, seq) that an agent's first one leads to, itself included, by doubling the pointers."""
    step = pointers.filter("next_sec is not null")
    marked = pointers.groupBy("agent").agg(F.min(F.struct("sec", "seq")).alias("x")).select("agent", "x.sec", "x.seq")
    marked = work.save(marked, "marked-0")
    for k in itertools.count(1):
        step = work.save(step, f"steps-{k}")
        new = work.save(marked.join(step, ["agent", "sec", "seq"]).select("agent", F.col("next_sec").alias("sec"), F.col("next_seq").alias("seq")), f"new-{k}")
        if new.isEmpty():
            return marked
        marked = work.save(marked.unionByName(new), f"marked-{k}")
        far = step.select("agent", F.col("sec").alias("next_sec"), F.col("seq").alias("next_seq"), F.col("next_sec").alias("far_sec"), F.col("next_seq").alias("far_seq"))
        step = step.join(far, ["agent", "next_sec", "next_seq"]).select("agent", "sec", "seq", F.col("far_sec").alias("next_sec"), F.col("far_seq").alias("next_seq"))


def scan(calls: DataFrame, threshold: int = 3, window: int = 300, reset: int = 600, work: Workspace | None = None) -> DataFrame:
    """calls (agent, at, seq, failed; seq tells calls of one second apart): agent, seq, refused, and open, the breaker's state after the call.

    A breaker opens at the call that is the ``threshold``-th failure in a row within ``window`` seconds and refuses calls for ``reset`` seconds. A null
    failed counts as a success; calls without agent form an agent of their own. An empty table gives an empty result.
    """
    if reset < window:
        raise ValueError("a breaker that is tried again while old failures count keeps more state than one opening")
    work = work or Workspace(calls.sparkSession, "breakers")
    length = reset
    rows = calls.select(F.struct("agent").alias("agent"), F.unix_seconds(F.col("at").cast("timestamp")).alias("sec"), F.col("seq").cast("long").alias("seq"), F.coalesce("failed", F.lit(False)).alias("failed"))
    openings = work.save(possible_openings(rows, threshold, window, length), "openings")
    opened = on_the_path(work.save(followed(openings, reset, length), "pointers"), work)
    last = F.floor((F.col("sec") + reset) / length)
    spans = opened.withColumn("slice", F.explode(F.sequence(F.floor(F.col("sec") / length), last))).groupBy("agent", "slice").agg(F.collect_list(F.struct("sec", "seq")).alias("spans"))  # three a slice at most: they lie ``reset`` apart
    at = F.struct("sec", "seq")
    refused = F.coalesce(F.exists("spans", lambda s: (at > s) & (F.col("sec") <= s["sec"] + reset)), F.lit(False))
    judged = rows.withColumn("slice", F.floor(F.col("sec") / length)).join(spans, ["agent", "slice"], "left").withColumn("refused", refused)
    return judged.select("agent.agent", "seq", "refused", (F.col("refused") | F.coalesce(F.array_contains("spans", at), F.lit(False))).alias("open"))
