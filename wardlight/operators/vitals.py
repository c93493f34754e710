"""Vital-sign analytics over (patient_id, time, seq, parameter, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import rules, scores
from wardlight.operators import models

PIVOTED = list(rules.NEWS2)


def _map(values: dict, cast: str = "double") -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(cast))])


def artifact_filter(vitals: DataFrame, profile: str = "stream") -> DataFrame:
    """Readings inside the physiological limits of a profile; null values go, parameters without limits stay.

    A zero of heart rate, saturation or systolic pressure is no reading: the limits of all profiles lie above zero.
    """
    limits = rules.ARTIFACT_LIMITS[profile]
    low, high = _map({k: v[0] for k, v in limits.items()}), _map({k: v[1] for k, v in limits.items()})
    p, v = F.col("parameter"), F.col("value")
    inside = F.when(F.array_contains(F.array(*map(F.lit, limits)), p), v.between(F.try_element_at(low, p), F.try_element_at(high, p))).otherwise(F.lit(True))
    return vitals.filter(v.isNotNull() & inside)


def critical_flags(vitals: DataFrame) -> DataFrame:
    low, high = _map({k: v[0] for k, v in rules.CRITICAL.items()}), _map({k: v[1] for k, v in rules.CRITICAL.items()})
    p = F.col("parameter")
    below = F.coalesce(F.col("value") < F.try_element_at(low, p), F.lit(False))
    above = F.coalesce(F.col("value") > F.try_element_at(high, p), F.lit(False))
    return vitals.withColumn("is_low", below).withColumn("is_high", above).withColumn("alert", F.when(below, F.concat(F.upper(p), F.lit("_LOW"))).when(above, F.concat(F.upper(p), F.lit("_HIGH"))))


def latest(vitals: DataFrame, as_of: Column | None = None, lookback: str = "2 hours") -> DataFrame:
    """The last value of each patient and parameter, by (time, seq); one hash aggregate, no sort."""
    rows = vitals if as_of is None else vitals.filter((F.col("time") <= as_of) & (F.col("time") > as_of - F.expr(f"interval {lookback}")))
    return rows.groupBy("patient_id", "parameter").agg(F.max_by("value", F.struct("time", "seq")).alias("value"), F.max("time").alias("time"))


def latest_wide(vitals: DataFrame) -> DataFrame:
    """One row a patient with its last value of each scored parameter: a single shuffle by patient."""
    at = F.struct("time", "seq")
    return vitals.groupBy("patient_id").agg(*[F.max_by(F.when(F.col("parameter") == p, F.col("value")), F.when(F.col("parameter") == p, at)).alias(p) for p in PIVOTED])


def with_scores(wide: DataFrame) -> DataFrame:
    v = {p: F.col(p) for p in PIVOTED}
    out = wide.withColumn("news2", scores.news2(v)).withColumn("mews", scores.mews(v)).withColumn("sofa", scores.sofa(v)).withColumn("news2_gap", scores.news2_gap(v))
    return out.withColumn("risk_level", scores.risk_level(F.col("news2"), F.col("sofa")))


def features(vitals: DataFrame) -> DataFrame:
    """mean, population deviation (0 if n < 2), min, max, last, slope over the row index (0 if n < 3), z-score, cv."""
    w = Window.partitionBy("patient_id", "parameter").orderBy("time", "seq")
    rows = vitals.withColumn("i", F.row_number().over(w) - 1)
    agg = rows.groupBy("patient_id", "parameter").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", "i").alias("last"), F.when(F.count("value") >= 3, F.regr_slope("value", "i")).otherwise(0.0).alias("slope"),
    )
    pop_mean, pop_sd = _map({k: v[0] for k, v in rules.POPULATION.items()}), _map({k: v[1] for k, v in rules.POPULATION.items()})
    return agg.withColumn("z", (F.col("mean") - pop_mean[F.col("parameter")]) / pop_sd[F.col("parameter")]).withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean") * 100).otherwise(0.0))


def _clean_groups(vitals: DataFrame, least: int) -> DataFrame:
    """Count, mean, deviation, sums, percentiles and hours of the clean readings of each patient and parameter with enough of them."""
    v = F.col("value")
    return artifact_filter(vitals, "engine").groupBy("patient_id", "parameter").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.sum("value").alias("s1"), F.sum(v * v).alias("s2"),
        F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), ((F.unix_timestamp(F.max("time")) - F.unix_timestamp(F.min("time"))) / 3600).alias("hours"),
    ).filter(F.col("n") >= least)


def baseline(vitals: DataFrame, least: int = 10) -> DataFrame:
    """Percentile baseline of clean readings for parameters with enough of them; mature after 24 hours."""
    p = F.col("p")
    return _clean_groups(vitals, least).select("patient_id", "parameter", "n", "mean", "sd", p[0].alias("p10"), p[1].alias("median"), p[2].alias("p90"), (F.col("hours") >= 24).alias("mature"))


def anomalies(vitals: DataFrame) -> DataFrame:
    """Last readings two or more deviations off the patient's baseline, or the population's without one.

    z is |n v - sum| / sqrt(n sum of squares - sum ** 2), which is exact where the sums are, so a z that is 2, 2.5, 3 or 4 does not fall below by rounding; where these nearly cancel, it comes from mean and deviation.
    """
    base = _clean_groups(vitals, 10).select("patient_id", "parameter", F.col("mean").alias("b_mean"), F.col("sd").alias("b_sd"), "n", "s1", "s2")
    pop_mean, pop_sd = _map({k: v[0] for k, v in rules.POPULATION.items()}), _map({k: v[1] for k, v in rules.POPULATION.items()})
    p = F.col("parameter")
    rows = latest(vitals).join(base, ["patient_id", "parameter"], "left").withColumn("mean", F.coalesce("b_mean", pop_mean[p])).withColumn("sd", F.when(F.col("b_sd") > 0, F.col("b_sd")).otherwise(pop_sd[p]))
    square = F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")
    exact = (F.col("b_sd") > 0) & (square > 1e-9 * F.col("n") * F.col("s2"))
    z = F.when(exact, F.abs(F.col("n") * F.col("value") - F.col("s1")) / F.sqrt(square)).otherwise(F.abs((F.col("value") - F.col("mean")) / F.col("sd")))
    severity = F.when(z >= 4, "critical").when(z >= 3, "severe").when(z >= 2.5, "moderate").otherwise("mild")
    return rows.withColumn("z", z).filter("z >= 2").select(
        "patient_id", "parameter", "value", "z", severity.alias("severity"), F.when(F.col("value") > F.col("mean"), "spike").otherwise("drop").alias("kind"),
        (F.col("mean") - 2 * F.col("sd")).alias("low"), (F.col("mean") + 2 * F.col("sd")).alias("high"),
    )


def trend(vitals: DataFrame, least: int = 10) -> DataFrame:
    """NEWS2 of the last values in the first against the last third of a patient's readings."""
    w = Window.partitionBy("patient_id")
    rows = vitals.withColumn("rn", F.row_number().over(w.orderBy("time", "seq"))).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") >= least)
    third = F.floor(F.col("n") / 3)
    part = rows.withColumn("third", F.when(F.col("rn") <= third, "first").when(F.col("rn") > F.col("n") - third, "last")).filter("third is not null")
    pick = lambda p, t: F.max_by(F.when((F.col("parameter") == p) & (F.col("third") == t), F.col("value")), F.when((F.col("parameter") == p) & (F.col("third") == t), F.col("rn")))
    wide = part.groupBy("patient_id").agg(*[pick(p, t).alias(f"{t}_{p}") for t in ("first", "last") for p in PIVOTED])
    first, last = (scores.news2({p: F.col(f"{t}_{p}") for p in PIVOTED}) for t in ("first", "last"))
    change = F.col("last_news2") - F.col("first_news2")
    label = F.when(change >= 5, "critical_change").when(change >= 3, "worsening").when(change <= -3, "improving").otherwise("stable")
    return wide.withColumn("first_news2", first).withColumn("last_news2", last).select("patient_id", "first_news2", "last_news2", label.alias("trend"))


def trend_stats(vitals: DataFrame) -> DataFrame:
    """mean, min, max, deviation, endpoint slope and direction of each patient and parameter."""
    at = F.struct("time", "seq")
    agg = vitals.groupBy("patient_id", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("sd"),
        ((F.max_by("value", at) - F.min_by("value", at)) / F.count(F.lit(1))).alias("slope"),
    )
    return agg.withColumn("direction", F.when(F.col("slope") > 0.5, "rising").when(F.col("slope") < -0.5, "falling").otherwise("stable"))


def deterioration(vitals: DataFrame, by: dict[str, object] | None = None) -> DataFrame:
    """Deterioration, sepsis and mortality from last values and slopes: by the rules, or by the models that ``by`` has for deterioration and sepsis (``models.scored``)."""
    slope = features(vitals).groupBy("patient_id").agg(
        F.max(F.when(F.col("parameter") == "heart_rate", F.col("slope"))).alias("hr_slope"), F.max(F.when(F.col("parameter") == "bp_systolic", F.col("slope"))).alias("sbp_slope")
    )
    rows = latest_wide(vitals).join(slope, "patient_id")
    inputs = {p: F.coalesce(F.col(p), F.lit(float(d))) for p, d in rules.MODEL_DEFAULTS.items()} | {s: F.coalesce(F.col(s), F.lit(0.0)) for s in ("hr_slope", "sbp_slope")}
    out = rows
    for name, rule in (("deterioration", rules.DETERIORATION), ("sepsis", rules.SEPSIS)):
        out = models.scored(out, inputs, scores.additive_risk(rule, inputs), name, (by or {}).get(name))
    return out.withColumn("mortality", F.round(0.55 * F.col("deterioration") + 0.45 * F.col("sepsis"), 9))


def alerts(vitals: DataFrame) -> DataFrame:
    """Threshold alerts of each patient and the highest of their priorities."""
    rows = with_scores(latest_wide(vitals)).select("patient_id", "news2").join(deterioration(vitals).select("patient_id", "deterioration", "sepsis", "mortality"), "patient_id")
    tests = [
        (F.col("news2") >= 5, "NEWS2", F.when(F.col("news2") >= 7, 3).otherwise(2)), (F.col("deterioration") >= 0.70, "DETERIORATION", F.lit(2)),
        (F.col("sepsis") >= 0.50, "SEPSIS", F.when(F.col("sepsis") > 0.70, 3).otherwise(2)), (F.col("mortality") >= 0.40, "MORTALITY", F.when(F.col("mortality") > 0.60, 3).otherwise(2)),
    ]
    names = F.array_compact(F.array(*[F.when(t, n) for t, n, _ in tests]))
    rank = F.greatest(*[F.when(t, r).otherwise(0) for t, _, r in tests])
    return rows.withColumn("alerts", F.array_join(names, ",")).withColumn("priority", F.element_at(F.array(*map(F.lit, ["LOW", "MEDIUM", "HIGH", "CRITICAL"])), rank + 1))


def in_range(vitals: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """Readings of the last hours before as_of; the bounds are literals, so they reach the scan."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return vitals.filter((F.col("time") > end - F.expr(f"interval {hours} hours")) & (F.col("time") <= end))


def latest_within(rows: DataFrame, key: list[str], value: str, ttl_seconds: int, as_of: str) -> DataFrame:
    """The last value of each key that is no older than its time to live."""
    end = F.lit(as_of).cast("timestamp_ntz")
    live = rows.filter((F.col("time") > end - F.expr(f"interval {ttl_seconds} seconds")) & (F.col("time") <= end))
    return live.groupBy(*key).agg(F.max_by(value, F.struct("time", "seq")).alias(value), F.max("time").alias("time"))


def recent_clean(vitals: DataFrame, as_of: str, hours: int = 2) -> DataFrame:
    """The last reading of each patient and parameter that is clean and no older than ``hours`` at as_of."""
    return latest(in_range(artifact_filter(vitals), as_of, hours))


def trend_readings(vitals: DataFrame, share: float = 0.15) -> DataFrame:
    """Readings with is_anomaly: more than a share off the mean of their patient and parameter."""
    base = F.avg("value").over(Window.partitionBy("patient_id", "parameter"))
    return vitals.withColumn("base", base).withColumn("is_anomaly", F.coalesce(F.abs(F.col("value") - F.col("base")) > share * F.abs("base"), F.lit(False)))


def trend_by_order(rows: DataFrame, order: str) -> DataFrame:
    """First against last third of each patient's readings in the order given, without sorting by time: worse by 3, better by 2."""
    n, at = F.count(F.lit(1)).over(Window.partitionBy("patient_id")), F.row_number().over(Window.partitionBy("patient_id").orderBy(order))
    third = F.floor(F.col("n") / 3)
    dealt = rows.withColumn("n", n).withColumn("rn", at).filter("n >= 10").withColumn("part", F.when(F.col("rn") <= third, "first").when(F.col("rn") > F.col("n") - third, "last"))
    last = lambda t, p: F.max_by(F.when((F.col("part") == t) & (F.col("parameter") == p), F.col("value")), F.when((F.col("part") == t) & (F.col("parameter") == p), F.col("rn")))
    wide = dealt.groupBy("patient_id").agg(*[last(t, p).alias(f"{t}_{p}") for t in ("first", "last") for p in rules.NEWS2])
    early, late = (scores.news2({p: F.col(f"{t}_{p}") for p in rules.NEWS2}) for t in ("first", "last"))
    return wide.select("patient_id", F.when(late - early >= 3, "worsening").when(early - late >= 2, "improving").otherwise("stable").alias("trend"))


def valid_inputs(readings: DataFrame) -> DataFrame:
    """Readings with a finite value of a known parameter."""
    v = F.col("value")
    known = sorted({*rules.POPULATION, "fio2", "weight", "height", "pain_score"})
    return readings.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col("parameter").isin(known))


def analyze(patients: DataFrame, vitals: DataFrame, passes: int = 20) -> DataFrame:
    """patients (patient_id) analysed, one row each: scores, risks with their deviations over noisy passes, anomalies (parameter and severity), trend, alerts and priority.

    Who has no readings has no scores, no alerts, the priority LOW and an uncertainty of 1.
    """
    from wardlight.operators.rollups import pass_statistics

    risks = deterioration(vitals)
    spread = lambda c: pass_statistics(risks, "patient_id", F.col(c), passes, seed=len(c)).select("patient_id", F.round("sd", 4).alias(f"{c}_uncertainty"))
    odd = anomalies(vitals).groupBy("patient_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "parameter", "severity"))).alias("anomalies"))  # one a parameter at most
    rows = alerts(vitals).select("patient_id", "alerts", "priority").join(with_scores(latest_wide(vitals)).select("patient_id", "news2", "mews", "sofa"), "patient_id")
    rows = rows.join(risks.select("patient_id", "deterioration", "sepsis", "mortality"), "patient_id").join(spread("deterioration"), "patient_id").join(spread("sepsis"), "patient_id")
    rows = rows.join(odd, "patient_id", "left").join(trend(vitals).select("patient_id", "trend"), "patient_id", "left")
    rows = patients.join(rows, "patient_id", "left").withColumn("trend", F.when(F.col("priority").isNotNull(), F.coalesce("trend", F.lit("stable"))))
    return rows.withColumn("anomalies", F.coalesce("anomalies", F.expr("cast(array() as array<string>)"))).withColumn("alerts", F.coalesce("alerts", F.lit(""))).withColumn("uncertainty", F.when(F.col("priority").isNull(), 1.0).otherwise(F.col("deterioration_uncertainty"))).withColumn("priority", F.coalesce("priority", F.lit("LOW")))


def ward_board(vitals: DataFrame) -> DataFrame:
    """Clean last vitals, scores and risk of each patient, most urgent first."""
    board = with_scores(latest_wide(artifact_filter(vitals)))
    rank = F.when(F.col("risk_level") == "CRITICAL", 0).when(F.col("risk_level") == "HIGH", 1).when(F.col("risk_level") == "MEDIUM", 2).otherwise(3)
    return board.orderBy(rank, F.desc("news2"), "patient_id")


def sparkline(vitals: DataFrame, points: int = 30) -> DataFrame:
    """The last points of each patient and parameter in time order."""
    w = Window.partitionBy("patient_id", "parameter").orderBy(F.desc("time"), F.desc("seq"))
    rows = vitals.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= points)
    return rows.groupBy("patient_id", "parameter").agg(F.transform(F.sort_array(F.collect_list(F.struct("time", "seq", "value"))), lambda x: x["value"]).alias("points"))


def rolling(vitals: DataFrame, minutes: int = 60) -> DataFrame:
    """Mean over a trailing time window at each reading."""
    w = Window.partitionBy("patient_id", "parameter").orderBy(F.unix_timestamp("time")).rangeBetween(-60 * minutes, 0)
    return vitals.withColumn("rolling_mean", F.avg("value").over(w)).withColumn("rolling_n", F.count("value").over(w))
