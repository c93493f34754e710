"""Findings of four modalities: extraction, and one fused risk a patient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators import agents

MODALITIES = ["vitals", "nlp", "imaging", "labs"]
# Image findings with severity and code; those that make a study urgent.
IMAGE_FINDINGS = {
    "consolidation": ("moderate", "J18.9"),
    "pleural_effusion": ("moderate", "J90"),
    "pneumothorax": ("critical", "J93.9"),
    "cardiomegaly": ("mild", "I51.7"),
    "pulmonary_edema": ("severe", "J81.1"),
    "atelectasis": ("mild", "J98.19"),
    "mediastinal_widening": ("critical", "J98.59"),
    "pneumomediastinum": ("critical", "J98.2"),
    "rib_fracture": ("moderate", "S22.39"),
    "normal": ("incidental", "Z00.00"),
}
URGENT_FINDINGS = ["pneumothorax", "mediastinal_widening", "pneumomediastinum"]


def _finding(source: str, kind: Column, description: Column, severity: Column, confidence: Column, negated: Column | None = None) -> Column:
    return F.struct(
        F.lit(source).alias("source"), kind.alias("kind"), description.alias("description"), severity.cast("string").alias("severity"), confidence.cast("double").alias("confidence"), (negated if negated is not None else F.lit(False)).alias("negated"),
    )


def vitals_findings(scored: DataFrame) -> DataFrame:
    """scored (patient_id, deterioration, sepsis): risks above .50 and .40."""
    d, s = F.col("deterioration"), F.col("sepsis")
    some = F.array_compact(F.array(
        F.when(d > 0.50, _finding("vitals", F.lit("deterioration_risk"), F.format_string("deterioration probability %d%% in 6 hours", F.floor(d * 100 + 0.5)), F.when(d > 0.70, "critical").otherwise("moderate"), F.lit(0.9))),
        F.when(s > 0.40, _finding("vitals", F.lit("sepsis_risk"), F.format_string("sepsis probability %d%% in 12 hours", F.floor(s * 100 + 0.5)), F.when(s > 0.60, "critical").otherwise("severe"), F.lit(0.9))),
    ))
    return scored.select("patient_id", F.inline(some))


def note_findings(entities: DataFrame) -> DataFrame:
    """entities (patient_id, type, text, confidence, negated): diseases and findings, negated ones too, so that they can contradict."""
    rows = entities.filter(F.upper("type").isin("DISEASE", "FINDING"))
    return rows.select("patient_id", F.inline(F.array(_finding("nlp", F.lower("type"), F.col("text"), F.lit(None), F.coalesce("confidence", F.lit(0.8)), F.col("negated")))))


def image_findings(images: DataFrame, low_quality: float = 0.60) -> DataFrame:
    """images (patient_id, finding, region, confidence, uncertainty, quality) as findings with code and urgency.

    Below the quality limit the confidence is multiplied by the quality and the uncertainty grows by .3 of what is missing.
    """
    of = lambda i: F.try_element_at(F.create_map(*[x for k, v in IMAGE_FINDINGS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("finding"))
    poor = F.col("quality") < low_quality
    sure = F.when(poor, F.col("confidence") * F.col("quality")).otherwise(F.col("confidence"))
    unsure = F.when(poor, F.least(F.lit(0.99), F.col("uncertainty") + (1 - F.col("quality")) * 0.3)).otherwise(F.col("uncertainty"))
    urgent = F.col("finding").isin(URGENT_FINDINGS) & (F.col("confidence") > 0.60)
    rows = images.withColumn("icd10", of(1)).withColumn("urgent", urgent).withColumn("unsure", unsure)
    made = _finding("imaging", F.col("finding"), F.concat(F.lit("["), F.coalesce("region", F.lit("")), F.lit("] "), F.col("finding")), F.coalesce(of(0), F.lit("incidental")), sure)
    return rows.select("patient_id", "icd10", "urgent", F.col("unsure").alias("uncertainty"), F.inline(F.array(made)))


def lab_findings(labs: DataFrame) -> DataFrame:
    """labs (patient_id, test, value, unit, flag, is_critical): critical ones."""
    bad = labs.filter(F.coalesce("is_critical", F.lit(False)) | F.coalesce(F.col("flag").isin("HH", "LL"), F.lit(False)))
    text = F.concat(F.lit("Critical lab: "), "test", F.lit("="), F.col("value").cast("string"), F.lit(" "), F.coalesce("unit", F.lit("")))
    return bad.select("patient_id", F.inline(F.array(_finding("labs", F.lit("critical_lab"), text, F.lit("critical"), F.lit(0.99)))))


def fuse(findings: DataFrame) -> DataFrame:
    """findings (patient_id, source, severity, confidence, negated, description, spo2, rr, news2): risk raised to HIGH by a discordance, review flag and missing modalities."""
    risk = agents.fusion_risk(findings)
    clash = agents.discordance(findings).groupBy("patient_id").agg(F.count(F.lit(1)).alias("discordances"))
    there = findings.groupBy("patient_id").agg(F.array_sort(F.array_except(F.array(*map(F.lit, MODALITIES)), F.collect_set("source"))).alias("missing_modalities"))
    rows = risk.drop("missing").join(clash, "patient_id", "left").join(there, "patient_id").withColumn("discordances", F.coalesce("discordances", F.lit(0).cast("long")))
    level = F.when((F.col("discordances") > 0) & ~F.col("level").isin("HIGH", "CRITICAL"), "HIGH").otherwise(F.col("level"))
    return rows.withColumn("level", level).withColumn("review", (F.col("discordances") > 0) | F.col("level").isin("HIGH", "CRITICAL"))
