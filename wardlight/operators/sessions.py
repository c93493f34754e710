"""Patient sessions: which agents an event calls, how each variant grades a risk, and the package a physician sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import rules


def called_agents(kind: Column, new_medication: Column) -> Column:
    """The agents of an event in order: triage for admissions and changed states, risk always, the pharmacist for a new drug, then coordination and escalation."""
    yes = lambda t: F.coalesce(t, F.lit(False))
    first = F.when(yes(kind.isin("admission", "status_change")), "triage")
    return F.array_compact(F.array(first, F.lit("risk"), F.when(yes(new_medication), "pharmacist"), F.lit("coordinator"), F.lit("escalation")))


def assess_risk(rows: DataFrame, variant: str = "session") -> DataFrame:
    """rows with risk_level, risk_factors, trigger, alert_required, alert_minutes and risk_confidence.

    rows: news2, sofa, deterioration, sepsis, mortality and, for the variant ``session``, comorbidities (array). The variant ``agent`` knows no
    comorbidities, takes neither the organ score nor sepsis for its level, names no mortality, and its trigger is the level (NONE where low).
    A missing score or chance raises nothing; a missing news2 also lowers the confidence.
    """
    c, session = F.col, variant == "session"
    if variant not in ("session", "agent"):
        raise ValueError(f"no such variant: {variant}")
    yes = lambda t: F.coalesce(t, F.lit(False))
    percent = lambda p: F.concat(F.rint(c(p) * 100).cast("int"), F.lit("%"))
    chance = lambda p, hours: F.concat(F.lit(f"AI {p} probability "), percent(p), F.lit(f" in {hours}h")) if session else F.concat(F.lit(f"AI {p} "), percent(p), F.lit(f"/{hours}h"))
    found = [
        F.when(yes(c("news2") >= 7), F.concat(F.lit("NEWS2="), "news2", F.lit(" (≥7: urgent response)"))).when(yes(c("news2") >= 5), F.concat(F.lit("NEWS2="), "news2", F.lit(" (≥5: high alert)"))),
        F.when(yes(c("deterioration") > 0.70), chance("deterioration", 6)), F.when(yes(c("sepsis") > 0.50), chance("sepsis", 12)),
    ]
    if session:
        found.append(F.when(yes(c("mortality") > 0.40), chance("mortality", 24)))
    found.append(F.when(yes(c("sofa") >= 6), F.concat(F.lit("SOFA="), "sofa", F.lit(" (organ dysfunction)" if session else ""))))
    factors = F.array_compact(F.array(*found))
    if session:
        high = F.filter(F.coalesce("comorbidities", F.array().cast("array<string>")), lambda x: F.lower(x).rlike("|".join(rules.HIGH_RISK_COMORBIDITIES)))
        factors = F.concat(factors, F.transform(high, lambda x: F.concat(F.lit("High-risk comorbidity: "), x)))
    critical, raised = yes(c("news2") >= 7) | yes(c("mortality") > 0.60), yes(c("news2") >= 5) | yes(c("deterioration") > 0.70)
    if session:
        critical, raised = critical | yes(c("sofa") >= 8), raised | yes(c("sepsis") > 0.50)
    level = F.when(critical, "CRITICAL").when(raised, "HIGH").when(yes(c("news2") >= 3), "MEDIUM").otherwise("LOW")
    named = {"CRITICAL": "critical_threshold_met", "HIGH": "high_threshold_met", "MEDIUM": "medium_threshold_met", "LOW": "within_normal_parameters"}
    if not session:
        named = {k: k for k in named} | {"LOW": "NONE"}
    trigger = F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("risk_level"))
    return rows.withColumns({"risk_level": level, "risk_factors": factors}).withColumns({
        "trigger": trigger, "alert_required": c("risk_level").isin("HIGH", "CRITICAL"), "alert_minutes": F.when(c("risk_level") == "CRITICAL", 5).otherwise(15),
        "risk_confidence": F.when(c("news2").isNotNull(), 0.90).otherwise(0.60),
    })


def packages(messages: DataFrame, hours: int = 24) -> DataFrame:
    """One package for each session of a patient; a session ends when nothing has been added for ``hours``, so a message exactly that much later starts a new one.

    messages: patient_id, agent, at, seq, level, confidence, status, escalations (raised by this message, null for none). Failed messages are no part of a
    session. The last message of triage, risk and coordination counts, by time, then seq. The aggregate holds one message of each agent, so the history of a
    patient passes through as sorted rows and is never collected. Messages without a time are in no session; equal messages count as often as they stand.
    """
    c = F.col
    gap = f"{hours * 3600 - 1} seconds 999999 microseconds"  # session windows that touch are merged
    said = messages.filter(F.coalesce(c("status") != "failed", F.lit(True)) & c("at").isNotNull())
    last = lambda agent: F.max_by(F.struct("level", "confidence"), F.when(c("agent") == agent, F.struct("at", "seq"))).alias(agent)
    critical = (c("agent") == "pharmacist") & (c("level") == "CRITICAL") & (c("status") == "completed")
    found = said.groupBy("patient_id", F.session_window("at", gap).alias("__s")).agg(
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"), last("triage"), last("risk"), last("coordinator"),
        F.bool_or(F.coalesce(critical, F.lit(False))).alias("pharmacy_critical"), F.coalesce(F.sum("escalations"), F.lit(0)).cast("long").alias("escalations_active"),
    )
    return found.drop("__s").withColumn("immediate", F.coalesce(c("coordinator.level").isin("HIGH", "CRITICAL"), F.lit(False)))
