"""Feedback signals, model metrics, drift, bias and service statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import rules


def ml_signal(feedback: DataFrame) -> DataFrame:
    """valid, and the training signal: raised by .3 where the linked outcome agrees, within -1 to 1."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in rules.FEEDBACK_SIGNAL.items() for x in kv]), F.col("signal"))
    valid = F.col("treating") & F.col("in_distribution")
    agrees = F.col("outcome_linked") & (((base > 0) & F.col("occurred")) | ((base < 0) & ~F.col("occurred")))
    return feedback.withColumn("valid", valid).withColumn("ml_signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(agrees, base * 1.3).otherwise(base))))


def feedback_signals(actions: DataFrame) -> DataFrame:
    """actions (action; explicit: is_positive, reason) as signals: what a physician did, or a thumb. A thumb down without a reason is out of distribution."""
    implicit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.ACTION_SIGNAL.items() for x in kv]), F.col("action")), F.lit("rejected"))
    signal = F.when(F.col("is_positive").isNull(), implicit).when(F.col("is_positive"), "thumbs_up").otherwise("thumbs_down")
    vague = (signal == "thumbs_down") & (F.length(F.coalesce("reason", F.lit(""))) == 0)
    return actions.withColumn("signal", signal).withColumn("in_distribution", ~vague)


def weekly_summary(feedback: DataFrame) -> DataFrame:
    rows = ml_signal(feedback)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    accepted = n(F.col("signal") == "accepted")
    return rows.groupBy(F.date_trunc("week", "at").alias("week")).agg(
        F.count(F.lit(1)).alias("total"), n(F.col("valid")).alias("valid"), F.avg("ml_signal").alias("avg_signal"), accepted.alias("accepted"),
        n(F.col("signal").isin("rejected", "thumbs_down")).alias("rejected"), n(F.col("outcome_linked") & F.col("occurred")).alias("confirmed"), (accepted / F.count(F.lit(1))).alias("acceptance_rate"),
    )


def auroc(rows: DataFrame, group: list[str], score: str = "probability", label: str = "occurred", least: int = 10) -> DataFrame:
    """Area under the curve by the rank sum with mean ranks; null for few rows or one class.

    Rows are first counted by distinct score, so a group's window holds distinct scores, not rows.
    """
    hist = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = hist.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    agg = ranked.groupBy(*group).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    q = F.col("n") - F.col("p")
    return agg.select(*group, "n", F.when((F.col("n") >= least) & (F.col("p") > 0) & (q > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * q)).alias("auroc"))


def weekly_metrics(feedback: DataFrame) -> DataFrame:
    rows = ml_signal(feedback).filter("valid").withColumn("week", F.date_trunc("week", "at"))
    high = F.col("risk_level").isin("HIGH", "CRITICAL")
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    agg = rows.groupBy("week").agg(
        rate(F.col("signal") == "accepted").alias("acceptance"), rate(F.col("signal") == "rejected").alias("rejection"), rate(F.col("signal") == "modified").alias("modification"),
        (F.sum(F.when(high & (F.col("signal") == "rejected"), 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(high, 1.0).otherwise(0.0)), F.lit(0.0))).alias("rejected_high"),
    )
    return agg.join(auroc(rows, ["week"]), "week", "left")


def drift(metrics: DataFrame, auroc_base: float = 0.88, fpr_base: float = 0.15) -> DataFrame:
    """Drift of each week against the baselines; once drifted, updates stay frozen."""
    no = F.lit(False)
    flags = [F.coalesce(auroc_base - F.col("auroc") > 0.05, no), F.coalesce(F.col("rejected_high") - fpr_base > 0.10, no), F.coalesce(F.col("rejection") > 0.30, no)]
    rows = metrics.withColumn("auroc_drop", flags[0]).withColumn("fpr_rise", flags[1]).withColumn("rejection_high", flags[2]).withColumn("drift", flags[0] | flags[1] | flags[2])
    upto = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)  # one row a week
    return rows.withColumn("frozen", F.max("drift").over(upto))


def bias_audit(feedback: DataFrame, gap: float = 0.05) -> DataFrame:
    """Accuracy of each subgroup, and the spread between the best and the worst."""
    right = ((F.col("probability") > 0.5) == F.col("occurred")).cast("double")
    by = feedback.groupBy("subgroup").agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return by.agg((F.max("accuracy") - F.min("accuracy")).alias("spread"), F.max_by("subgroup", F.struct("accuracy", "subgroup")).alias("best"), F.min_by("subgroup", F.struct("accuracy", "subgroup")).alias("worst"), F.count(F.lit(1)).alias("groups")).withColumn("biased", F.col("spread") > gap)


def link_outcomes(feedback: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Feedback with the latest outcome of its encounter and output type, and whether the prediction was right.

    outcomes: encounter_id, outcome_type, occurred, at, seq. They are reduced to one a key first, so hot encounters don't square.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in rules.OUTCOME_OUTPUT.items() for x in kv]), F.col("outcome_type"))
    o = outcomes.withColumn("output_type", kind).groupBy("encounter_id", "output_type").agg(F.max_by("occurred", F.struct("at", "seq")).alias("outcome"))
    return feedback.drop("occurred").join(o, ["encounter_id", "output_type"]).withColumn("correct", (F.col("probability") > 0.5) == F.col("outcome"))


def validated_accuracy(linked: DataFrame, group: list[str]) -> DataFrame:
    """Linked predictions, right ones and their share by group."""
    return linked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right")).withColumn("accuracy", F.col("right") / F.col("n"))


def eligibility(models: DataFrame) -> DataFrame:
    """models: model, gain, bias_ok, shadow_days, physicians, drifted. All five checks, and which fail."""
    checks = {"gain": F.col("gain") >= 0.02, "bias": F.col("bias_ok"), "shadow": F.col("shadow_days") >= 30, "physicians": F.col("physicians") >= 5, "drift": ~F.col("drifted")}
    failed = F.array_compact(F.array(*[F.when(~c, k) for k, c in checks.items()]))
    return models.select("model", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("eligible"))


def _bucket(x: Column) -> Column:
    """A whole number that never falls as x rises: 512 buckets for each factor e on both sides of 0; NaN is last."""
    big, step = F.lit(10**9), lambda y: F.floor(F.log(y) * 512) + 409_600
    return (
        F.when(x.isNull(), F.lit(None).cast("long")).when(F.isnan(x), big + 1).when(x == float("inf"), big).when(x == float("-inf"), -big)
        .when(x > 0, step(x)).when(x < 0, -step(-x)).otherwise(0)
    )


def at_ranks(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, n and, under each name, the element at that place (from 0, made from n) of the group's sorted values.

    Nulls don't count; a group without values has n = 0 and nulls. Values are counted first; running counts of
    buckets find those that hold a wanted place, and only their distinct values are ordered, each bucket by itself.
    """
    hist = rows.groupBy(*group, F.col(value).alias("x")).agg(F.count(value).alias("k")).withColumn("bucket", _bucket(F.col("x").cast("double")))
    whole = Window.partitionBy(*group)
    sums = hist.groupBy(*group, "bucket").agg(F.sum("k").alias("inside")).withColumn("n", F.sum("inside").over(whole))
    sums = sums.withColumn("below", F.sum("inside").over(whole.orderBy(F.asc_nulls_last("bucket")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside"))
    holds = lambda r, low, k: (r(F.col("n")) >= low) & (r(F.col("n")) < low + F.col(k))
    chosen = sums.filter((F.col("n") == 0) | reduce(lambda x, y: x | y, [holds(r, F.col("below"), "inside") for r in ranks.values()]))
    chosen = chosen.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("bucket").alias("_bucket"), "n", "below")
    near = hist.join(chosen, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, "bucket"]]))
    upto = Window.partitionBy(*group, "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("low", F.col("below") + F.sum("k").over(upto) - F.col("k"))
    return near.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(holds(r, F.col("low"), "k"), F.col("x"))).alias(name) for name, r in ranks.items()])


def latency(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """p50 as the median, p95 and p99 as the element at floor(n * q) of the sorted values."""
    at = lambda q: lambda n: F.least(F.floor(n * q), n - 1)
    agg = at_ranks(rows, group, value, {"m0": lambda n: F.floor((n - 1) / 2), "m1": lambda n: F.floor(n / 2), "p95": at(0.95), "p99": at(0.99)})
    p50 = F.when(F.col("m0") == F.col("m1"), F.col("m0").cast("double")).otherwise(0.5 * F.col("m0") + 0.5 * F.col("m1"))
    return agg.select(*group, "n", p50.alias("p50"), "p95", "p99")


def observation_quality(vitals: DataFrame, as_of: Column) -> DataFrame:
    """Quality of each reading: completeness .30, timeliness .25 (half-life 6 h), consistency .25 (3 IQR of the group), validity .20."""
    limits = rules.ARTIFACT_LIMITS["engine"]
    group = at_ranks(vitals, ["patient_id", "parameter"], "value", {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(3 * n / 4)})
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("time")) / 3600.0
    iqr, p = F.col("q3") - F.col("q1"), F.col("parameter")
    of = lambda i: F.try_element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v[i])))]), p)
    inside = F.col("value").between(F.col("q1") - 3 * iqr, F.col("q3") + 3 * iqr)
    out = vitals.join(group, ["patient_id", "parameter"]).withColumn("timeliness", F.round(F.pow(F.lit(2.0), -hours / 6), 4)).withColumn("consistency", F.when(F.col("n") < 5, 1.0).when(inside, 1.0).otherwise(0.3))
    out = out.withColumn("validity", F.when(of(0).isNull(), 0.8).when(F.col("value").between(of(0), of(1)), 1.0).otherwise(0.0))
    total = 0.30 * F.col("value").isNotNull().cast("double") + 0.25 * F.col("timeliness") + 0.25 * F.col("consistency") + 0.20 * F.col("validity")
    return out.withColumn("quality", total).withColumn("usable", total >= 0.60)
