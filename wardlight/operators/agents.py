"""Triage, differentials, consensus, escalation and the fusion of modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import rules

RANKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def triage(wide: DataFrame, complaint: str = "complaint") -> DataFrame:
    """Emergency severity 1 to 3 of last vitals (spo2_pulse_ox, gcs_total, heart_rate, bp_mean, respiratory_rate) and complaint, with pathway and page minutes.

    A missing vital raises nothing. Severity 4 and 5 are never given.
    """
    yes = lambda t: F.coalesce(t, F.lit(False))
    c = F.col
    one = yes(c("spo2_pulse_ox") < 85) | yes(c("gcs_total") <= 8)
    two = yes((c("heart_rate") > 150) | (c("heart_rate") < 40)) | yes(c("spo2_pulse_ox") < 90) | yes(c("bp_mean") < 60) | yes((c("respiratory_rate") > 35) | (c("respiratory_rate") < 6))
    words = yes(F.lower(c(complaint)).rlike("|".join(rules.EMERGENT_COMPLAINTS)))
    esi = F.when(one, 1).when(two | words, 2).otherwise(3)
    pages = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.PAGE_MINUTES.items() for x in kv]), esi)
    return wide.withColumn("esi", esi).withColumn("pathway", F.element_at(F.array(*map(F.lit, rules.PATHWAYS)), esi)).withColumn("page_minutes", pages)


def differentials(wide: DataFrame, complaint: str = "complaint") -> DataFrame:
    """Rule-based differentials of each patient from last vitals, wbc, lactate and complaint, in order; undifferentiated where no rule fires."""
    yes, c = lambda t: F.coalesce(t, F.lit(False)), F.col
    sepsis = yes(c("temperature") > 38.0) & yes(c("heart_rate") > 100) & yes(c("wbc") > 12)
    pneumonia = yes(c("spo2_pulse_ox") < 94) & yes(F.lower(c(complaint)).rlike("dyspnea|breathing"))
    mk = lambda d, code, p, rank: F.struct(F.lit(d).alias("diagnosis"), F.lit(code).alias("icd10"), p.cast("double").alias("confidence"), rank.alias("rank"))
    first, second = F.lit("primary"), F.when(sepsis, "alternative").otherwise("primary")
    found = F.array_compact(F.array(F.when(sepsis, mk("Sepsis", "A41.9", F.when(yes(c("lactate") > 2.0), 0.72).otherwise(0.58), first)), F.when(pneumonia, mk("Community-Acquired Pneumonia", "J18.9", F.lit(0.61), second))))
    found = F.when(F.size(found) == 0, F.array(mk("Undifferentiated presentation", "R69", F.lit(0.40), first))).otherwise(found)
    return wide.select("patient_id", F.inline(found))


def workup(differential: DataFrame) -> DataFrame:
    """Tests still needed by patient, each once, for the diagnoses of ``differentials``."""
    d = F.lower("diagnosis")
    tests = F.when(d.contains("sepsis"), F.array(*map(F.lit, ["Blood cultures", "Serum lactate", "Procalcitonin"]))).when(d.contains("pneumonia"), F.array(*map(F.lit, ["Chest X-ray", "Sputum culture"]))).otherwise(F.array(F.lit("Basic metabolic panel and CBC")))
    return differential.groupBy("patient_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tests)))).alias("workup"))  # at most three diagnoses


def consensus(votes: DataFrame) -> DataFrame:
    """votes: patient_id, agent, level, confidence, bypass. A critical pharmacy vote decides alone; else the worst level, mean confidence and arbitration below .6."""
    names = F.array(*map(F.lit, RANKS))
    agg = votes.groupBy("patient_id").agg(F.max(F.array_position(names, F.col("level"))).alias("r"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("agents"), F.bool_or("bypass").alias("bypass"))
    level = F.when(F.col("bypass"), "CRITICAL").when(F.col("r") > 0, F.element_at(names, F.col("r").cast("int"))).otherwise("LOW")
    return agg.select(
        "patient_id", level.alias("level"), F.when(F.col("bypass"), 1.0).otherwise(F.col("confidence")).alias("confidence"), "agents", (~F.col("bypass") & (F.col("confidence") < 0.6)).alias("arbitration"),
        F.when(F.col("bypass"), "pharmacy_critical_override").otherwise("consensus").alias("kind"),
    )


def escalations(rows: DataFrame) -> DataFrame:
    """rows: patient_id, at, esi, level, pharmacy_critical, sepsis. One row an escalation, with its deadline."""
    mk = lambda kind, minutes: F.struct(F.lit(kind).alias("kind"), F.lit(minutes).alias("minutes"))
    found = F.array_compact(F.array(
        F.when(F.col("esi") == 1, mk("ESI_1", 2)), F.when(F.col("level") == "CRITICAL", mk("CRITICAL_RISK", 5)), F.when(F.col("pharmacy_critical"), mk("PHARMACY", 1)), F.when(F.col("sepsis") > 0.7, mk("SEPSIS", 5)),
    ))
    return rows.select("patient_id", "at", F.inline(found)).withColumn("deadline", F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")))


def risk_factors() -> Column:
    """What speaks for a raised risk, from news2, sofa, deterioration and sepsis."""
    f = lambda t, m: F.when(F.coalesce(t, F.lit(False)), m)
    return F.array_compact(F.array(
        f(F.col("news2") >= 5, F.concat(F.lit("NEWS2 "), F.col("news2"))), f(F.col("sofa") >= 4, F.concat(F.lit("SOFA "), F.col("sofa"))), f(F.col("deterioration") > 0.70, F.lit("deterioration")), f(F.col("sepsis") > 0.50, F.lit("sepsis")),
    ))


def fusion_risk(findings: DataFrame) -> DataFrame:
    """findings: patient_id, source, severity, confidence, negated. Weighted severity, level and confidence.

    Sums are decimals (confidences to eighteen places), so a mean of just 1, 2 or 3 meets its level whatever the order of the rows.
    """
    of = lambda values, c: F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(str(v)).cast("decimal(3,2)"))]), c)
    w = F.coalesce(of(rules.MODALITY_WEIGHT, F.col("source")), F.lit("0.10").cast("decimal(3,2)")) * F.col("confidence").cast("decimal(22,18)")
    live = ~F.col("negated")
    agg = findings.groupBy("patient_id").agg(
        F.sum(F.when(live, w * of(rules.SEVERITY, F.col("severity")).cast("decimal(1,0)"))).alias("s"), F.sum(F.when(live, w)).alias("w"), F.countDistinct("source").alias("modalities")
    )
    none, times = F.coalesce(F.col("w") == 0, F.lit(True)), lambda n: F.col("w") * F.lit(n).cast("decimal(1,0)")
    level = F.when(none, "LOW").when(F.col("s") >= times(3), "CRITICAL").when(F.col("s") >= times(2), "HIGH").when(F.col("s") >= F.col("w"), "MEDIUM").otherwise("LOW")
    conf = F.when(none, 0.5).otherwise(F.least(F.lit(0.95), F.col("w").cast("double") / F.col("modalities")) * F.col("modalities") / 4.0)
    return agg.select("patient_id", level.alias("level"), conf.alias("confidence"), "modalities", (4 - F.col("modalities")).alias("missing"))


def discordance(findings: DataFrame) -> DataFrame:
    """Disagreeing modalities of a patient: imaging and notes on one condition, calm imaging or notes against bad vitals.

    findings: patient_id, source, description, negated, spo2, rr, news2. Aggregated by patient, without a self-join.
    """
    d, src = F.lower("description"), F.col("source")
    flag = lambda test: F.max(F.when(test, 1).otherwise(0)) == 1
    conditions = {"pneumonia": "pneumonia|consolidation|infiltrate", "heart_failure": "heart failure|chf|pulmonary edema", "ards": "ards|respiratory distress"}
    aggs = []
    for name, pattern in conditions.items():
        for s in ("imaging", "nlp"):
            aggs += [flag((src == s) & d.rlike(pattern) & F.col("negated")).alias(f"{name}_{s}_no"), flag((src == s) & d.rlike(pattern) & ~F.col("negated")).alias(f"{name}_{s}_yes")]
    aggs += [
        flag((src == "imaging") & d.rlike("clear|no acute|unremarkable|normal|no evidence")).alias("calm_imaging"), flag((src == "nlp") & d.rlike("improving|better|improved|stable|resolving")).alias("calm_note"),
        flag((src == "vitals") & ((F.col("spo2") < 90) | (F.col("rr") > 28) | (F.col("news2") >= 7))).alias("compromised"), flag((src == "vitals") & (F.col("news2") >= 5)).alias("worsening"),
    ]
    agg = findings.groupBy("patient_id").agg(*aggs)
    clash = F.lit(False)
    for name in conditions:
        clash = clash | (F.col(f"{name}_imaging_yes") & F.col(f"{name}_nlp_no")) | (F.col(f"{name}_imaging_no") & F.col(f"{name}_nlp_yes"))
    kinds = F.array_compact(F.array(F.when(clash, "clinical_imaging"), F.when(F.col("calm_imaging") & F.col("compromised"), "imaging_vitals"), F.when(F.col("calm_note") & F.col("worsening"), "nlp_vitals")))
    return agg.select("patient_id", F.explode(kinds).alias("kind"))


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    sev = F.try_element_at(F.create_map(*[x for a, v in rules.SEVERITY.items() for x in (F.lit(a), F.lit(float(v)))]), F.col("severity"))
    w = Window.partitionBy("patient_id").orderBy(F.desc(sev * F.col("confidence")), "seq")
    return findings.filter(~F.col("negated")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
