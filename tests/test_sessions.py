"""Rows written by hand for predicates, risk variants, packages and contexts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight.operators import predicates, prompts, sessions


def test_predicates(spark):
    d = spark.createDataFrame([("Vancomycin 1g", "drug", "life_threatening", "active"), ("aspirin", "food", "mild", "closed"), (None, None, None, None)], "name string, kind string, severity string, status string")
    got = d.select(predicates.renally_cleared(F.col("name")), predicates.drug_allergy(F.col("kind")), predicates.life_threatening(F.col("severity")), predicates.active(F.col("status"))).collect()
    assert [tuple(r) for r in got] == [(True,) * 4, (False,) * 4, (False,) * 4]


def test_work_lists_at_their_limits(spark):
    now = dt.datetime(2024, 3, 1)
    at = [now - dt.timedelta(hours=h) for h in (47, 48, 49)]
    rows = spark.createDataFrame([(1, at[0], None), (2, at[1], None), (3, at[2], None), (4, at[2], True), (5, None, None)], "id int, predicted_at timestamp_ntz, outcome_occurred boolean")
    as_of = F.lit(now).cast("timestamp_ntz")
    assert [r["id"] for r in predicates.work_list("unvalidated_predictions", rows, as_of).collect()] == [3]
    old = spark.createDataFrame([(1, False, now - dt.timedelta(days=30)), (2, False, now - dt.timedelta(days=31)), (3, None, now - dt.timedelta(days=31)), (4, True, now - dt.timedelta(days=31))], "id int, outcome_linked boolean, at timestamp_ntz")
    assert [r["id"] for r in predicates.work_list("unlinked_feedback", old, as_of).collect()] == [2]


def test_called_agents(spark):
    d = spark.createDataFrame([("admission", True), ("status_change", None), ("vitals_update", False), (None, True)], "kind string, new boolean")
    got = [r[0] for r in d.select(sessions.called_agents(F.col("kind"), F.col("new"))).collect()]
    assert got == [["triage", "risk", "pharmacist", "coordinator", "escalation"], ["triage", "risk", "coordinator", "escalation"], ["risk", "coordinator", "escalation"], ["risk", "pharmacist", "coordinator", "escalation"]]


def test_risk_variants(spark):
    schema = "news2 int, sofa int, deterioration double, sepsis double, mortality double, comorbidities array<string>"
    rows = spark.createDataFrame([
        (8, 2, 0.725, 0.51, 0.65, ["Malignancy of lung", "gout", None]), (5, 8, 0.1, 0.1, 0.1, []), (2, 0, 0.1, 0.51, 0.41, None), (3, 0, None, None, None, None), (None, 6, 0.70, 0.50, 0.40, None),
    ], schema)
    a, b = sessions.assess_risk(rows).collect(), sessions.assess_risk(rows, "agent").collect()
    assert [(r["risk_level"], r["trigger"], r["alert_required"], r["alert_minutes"], r["risk_confidence"]) for r in a] == [
        ("CRITICAL", "critical_threshold_met", True, 5, 0.9), ("CRITICAL", "critical_threshold_met", True, 5, 0.9), ("HIGH", "high_threshold_met", True, 15, 0.9),
        ("MEDIUM", "medium_threshold_met", False, 15, 0.9), ("LOW", "within_normal_parameters", False, 15, 0.6),
    ]
    assert a[0]["risk_factors"] == ["NEWS2=8 (≥7: urgent response)", "AI deterioration probability 72% in 6h", "AI sepsis probability 51% in 12h", "AI mortality probability 65% in 24h", "High-risk comorbidity: Malignancy of lung"]
    assert a[1]["risk_factors"] == ["NEWS2=5 (≥5: high alert)", "SOFA=8 (organ dysfunction)"] and a[4]["risk_factors"] == ["SOFA=6 (organ dysfunction)"]
    assert [(r["risk_level"], r["trigger"]) for r in b] == [("CRITICAL", "CRITICAL"), ("HIGH", "HIGH"), ("LOW", "NONE"), ("MEDIUM", "MEDIUM"), ("LOW", "NONE")]
    assert b[0]["risk_factors"] == ["NEWS2=8 (≥7: urgent response)", "AI deterioration 72%/6h", "AI sepsis 51%/12h"] and b[1]["risk_factors"][-1] == "SOFA=8"
    with pytest.raises(ValueError):
        sessions.assess_risk(rows, "other")


def test_packages(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [
        (1, "triage", at(0), 1, "HIGH", 0.5, "completed", None), (1, "risk", at(1), 2, "LOW", 0.9, "completed", None), (1, "risk", at(1), 3, "HIGH", 0.8, "completed", None), (1, "pharmacist", at(2), 4, "CRITICAL", 1.0, "failed", None),
        (1, "coordinator", at(2), 5, "HIGH", 0.7, "completed", None), (1, "escalation", at(2), 6, "HIGH", 0.7, "completed", 2),
        (1, "risk", at(26), 7, "LOW", 0.6, "completed", None),  # exactly 24 hours later: a new session
        (2, "pharmacist", at(0), 8, "CRITICAL", 1.0, "completed", None), (2, "coordinator", at(23), 9, "MEDIUM", 0.7, None, None), (3, "risk", None, 10, "LOW", 0.1, "completed", None),
    ]
    schema = "patient_id long, agent string, at timestamp_ntz, seq long, level string, confidence double, status string, escalations int"
    got = sessions.packages(spark.createDataFrame(rows, schema)).orderBy("patient_id", "created_at").collect()
    assert [(r["patient_id"], r["n_messages"], r["triage"] and r["triage"]["level"], r["risk"] and r["risk"]["level"], r["pharmacy_critical"], r["escalations_active"], r["immediate"]) for r in got] == [
        (1, 5, "HIGH", "HIGH", False, 2, True), (1, 1, None, "LOW", False, 0, False), (2, 2, None, None, True, 0, False),
    ]
    assert got[0]["risk"]["confidence"] == 0.8 and sessions.packages(spark.createDataFrame([], schema)).count() == 0


def plain_context(budget, lists):
    """Sections of one patient, section by section."""
    left, parts = budget, []
    for name, none in (("vitals", "No recent vitals available."), ("medications", "No active medications on record."), ("labs", "No recent laboratory results.")):
        text = "\n".join(lists.get(name, [])[: 20 if name == "vitals" else None]) or none
        if len(text) // 4 < left:
            parts.append((name, text))
            left -= len(text) // 4
    for name, gap in (("imaging", "\n"), ("notes", "\n\n")):
        some = lists.get(name, [])[: 5 if name == "notes" else None]
        if some and left > 2000:
            parts.append((name, gap.join(some)))
            left -= len(gap.join(some)) // 4
    if lists.get("history") and left > 1000:
        used, some = 0, []
        for x in lists["history"]:
            if used + len(x) // 4 > left:
                break
            some.append(x)
            used += len(x) // 4
        parts.append(("history", "\n".join(some) or "No relevant history retrieved."))
    return "\n\n".join(f"### {prompts.SECTIONS[n][0]}\n{t}" for n, t in parts)


def test_contexts_against_plain_sections(spark):
    import random

    rng = random.Random(7)
    people = list(range(1, 13))
    notes, history, drugs = [], [], []
    for p in people[:-1]:
        notes += [(p, i, None, f"d{i}", "x é" * rng.choice([1, 60, 700])) for i in range(rng.choice([0, 1, 7]))]
        history += [(p, i, f"2024-01-{i:02}", "y" * rng.choice([1, 90, 900])) for i in range(rng.choice([0, 3, 25]))]
        drugs += [(p, i, "drug" * rng.choice([1, 400]), None if i % 2 else "5 mg", "iv", "daily") for i in range(rng.choice([0, 2, 9]))]
    tables = {
        "notes": (spark.createDataFrame(notes, "patient_id int, i int, kind string, date string, summary string"), [F.col("i")]),
        "history": (spark.createDataFrame(history, "patient_id int, i int, date string, description string"), [F.col("i")]),
        "medications": (spark.createDataFrame(drugs, "patient_id int, i int, name string, dose string, route string, frequency string"), [F.col("i")]),
    }
    for budget in (5, 1500, 3500, 6000):
        got = {r["patient_id"]: r["context"] for r in prompts.contexts(spark.createDataFrame([(p,) for p in people], "patient_id int"), tables, budget).collect()}
        for p in people:
            lists = {"notes": [f"[Note — {d}]: {s}" for q, _, _, d, s in notes if q == p], "history": [f"- [{d}] {s}" for q, _, d, s in history if q == p], "medications": [f"- {n} {d or ''} {r} {f}" for q, _, n, d, r, f in drugs if q == p]}
            assert got[p] == plain_context(budget, lists), (budget, p)


def test_lines_and_message(spark):
    one = spark.createDataFrame([(1, "heart_rate", 130, "bpm", None, True, True, False)], "patient_id int, parameter string, value int, unit string, time string, critical boolean, high boolean, low boolean")
    assert one.select(prompts.vital_line()).first()[0] == "- heart_rate: 130 bpm at Unknown time ⚠️ CRITICAL ⬆️ HIGH"
    lab = spark.createDataFrame([("K", None, None, None, False, True)], "test string, value double, unit string, reference string, critical boolean, abnormal boolean")
    assert lab.select(prompts.lab_line()).first()[0] == "- K: N/A  (Ref: N/A) * ABNORMAL"
    image = spark.createDataFrame([(None, None, None, None, True)], "modality string, date string, summary string, finding string, urgent boolean")
    assert image.select(prompts.image_line()).first()[0] == "- [Unknown] : No findings documented 🚨 URGENT"
    text = spark.range(1).select(prompts.user_message(F.lit("ctx"), {"imaging": F.lit('{"a":1}'), "nlp": F.lit(None).cast("string"), "discordances": F.lit("[]")})).first()[0]
    assert text == '## PATIENT DATA\n\nctx\n\n## AI IMAGING ANALYSIS\n{"a":1}\n\n## ⚠️ MODALITY DISCORDANCES (require physician review)\n[]\n\n## TASK\nApply the 5-step reasoning protocol. Return valid JSON only.'
    for complaint, head in (("cough", "**Chief Complaint / Reason for Visit**: cough\n\n### "), (None, "### "), ("", "### ")):
        people = spark.createDataFrame([(1, complaint)], "patient_id int, complaint string")
        assert prompts.contexts(people, {}, complaint="complaint").first()["context"].startswith(head)


def test_entries_are_dealt_before_they_are_counted(spark, tmp_path):
    """Tasks that count entries grow with the tables, and none counts what a scan reads before it is dealt."""
    from wardlight.sources import fixtures as fx

    for name, n in (("events", 30), ("orders", 71)):
        spark.range(n).write.parquet(f"{tmp_path}/{name}.parquet")
    assert fx.tasks_for(spark, str(tmp_path), "events", "orders", rows=10) == 11
    assert fx.tasks_for(spark, str(tmp_path), "events", rows=1_000) == spark.sparkContext.defaultParallelism
    rows = spark.range(1_000).select(F.when(F.col("id") % 300 < 9, "a").otherwise("b").alias("list"), (F.col("id") % 300).alias("id"))
    dealt = predicates.by_entry(rows, 7)
    assert dealt.rdd.getNumPartitions() == 7
    counted = dealt.groupBy("list", "id").count()
    assert str(counted._jdf.queryExecution().executedPlan().toString()).count("Exchange") == 1
    assert sorted({r["count"] for r in counted.collect()}) == [3, 4] and counted.count() == 300
