"""Expected rows written by hand, for rules whose SQL shares their tables."""

import random

import pytest
from pyspark.sql import functions as F


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


WIDE = "patient_id long, spo2_pulse_ox double, gcs_total double, heart_rate double, bp_mean double, respiratory_rate double, temperature double, wbc double, lactate double, complaint string"


def test_triage(spark):
    from wardlight.operators import agents

    rows = [
        (1, 84.9, 15.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, "cough"), (2, 97.0, 8.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, "cough"), (3, 89.0, 15.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, ""),
        (4, 97.0, 15.0, 80.0, 59.0, 16.0, 37.0, 8.0, 1.0, None), (5, 97.0, 15.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, "Difficulty Breathing"), (6, 97.0, 15.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, "anaphylaxis"),
        (7, 97.0, 15.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, "severe bleeding"), (8, None, None, None, None, None, None, None, None, None), (9, 97.0, 15.0, 151.0, 80.0, 5.0, 37.0, 8.0, 1.0, "x"),
    ]
    got = {r["patient_id"]: (r["esi"], r["pathway"], r["page_minutes"]) for r in agents.triage(one(spark, WIDE, *rows)).collect()}
    first, second, third = (1, "immediate_resuscitation", 2), (2, "emergency_treatment", 5), (3, "urgent_evaluation", None)
    assert got == {1: first, 2: first, 3: second, 4: second, 5: second, 6: second, 7: third, 8: third, 9: second}


def test_differentials_and_workup(spark):
    from wardlight.operators import agents

    base = (97.0, 15.0, 80.0, 80.0, 16.0, 37.0, 8.0, 1.0, "cough")
    rows = [(1, *base), (2, 97.0, 15.0, 101.0, 80.0, 16.0, 38.1, 12.5, 2.5, "x"), (3, 93.0, 15.0, 101.0, 80.0, 16.0, 38.1, 12.5, 1.0, "shortness of breathing"), (4, 93.0, 15.0, 80.0, 80.0, 16.0, 38.4, 8.0, 1.0, "Dyspnea"), (5, 93.0, 15.0, 120.0, 80.0, 30.0, 38.4, 12.0, 1.0, "x")]
    table = agents.differentials(one(spark, WIDE, *rows))
    got = sorted((r["patient_id"], r["icd10"], r["confidence"], r["rank"]) for r in table.collect())
    assert got == [(1, "R69", 0.40, "primary"), (2, "A41.9", 0.72, "primary"), (3, "A41.9", 0.58, "primary"), (3, "J18.9", 0.61, "alternative"), (4, "J18.9", 0.61, "primary"), (5, "R69", 0.40, "primary")]
    tests = {r["patient_id"]: r["workup"] for r in agents.workup(table).collect()}
    assert tests[3] == ["Blood cultures", "Chest X-ray", "Procalcitonin", "Serum lactate", "Sputum culture"] and tests[1] == ["Basic metabolic panel and CBC"]


def test_allergies_and_consensus(spark):
    from wardlight.operators import agents, medication

    meds = one(spark, "drug string, allergy string", ("Amoxicillin 500", "Penicillin"), ("penicillin v", "penicillin"), ("Furosemide", "sulfa drugs"), ("cefepime", "cephalosporin"), ("ketorolac", "NSAID"), ("nafcillin", "sulfa"))
    assert {r["drug"] for r in medication.allergy_alerts(meds).collect()} == {"Amoxicillin 500", "Furosemide", "cefepime", "ketorolac"}
    votes = one(spark, "patient_id long, agent string, level string, confidence double, bypass boolean", (1, "a", "LOW", 0.5, False), (1, "b", "HIGH", 0.6, False), (2, "a", "LOW", 0.2, False), (2, "b", "MEDIUM", 0.3, True))
    got = {r["patient_id"]: (r["level"], r["confidence"], r["arbitration"], r["kind"]) for r in agents.consensus(votes).collect()}
    assert got == {1: ("HIGH", 0.55, True, "consensus"), 2: ("CRITICAL", 1.0, False, "pharmacy_critical_override")}


@pytest.mark.parametrize("a,b,same", [("SHARMA", "SHARMA", True), ("PATEL", "PATEL", True), ("SHARMA", "SHARME", True), ("SHARMA", "JOHNSON", False), ("SINGH", "SINGHANIA", False), ("GUPTA", "GUPTA", True)])
def test_names(a, b, same):
    from wardlight.operators.identity import jaro_winkler

    assert (jaro_winkler(a, b) >= 0.92) == same and jaro_winkler(a, b) == jaro_winkler(a.lower(), b)
    assert abs(jaro_winkler(a, b) - jaro_winkler(b, a)) < 1e-12
    assert abs(jaro_winkler("MARTHA", "MARHTA") - 0.9611) < 1e-4 and jaro_winkler("", "") == 0 and abs(jaro_winkler("DWAYNE", "DUANE") - 0.84) < 1e-9


def test_negation(spark):
    from wardlight.operators import notes

    texts = ["Patient denies pneumonia.", "Pneumonia confirmed today.", "Possible sepsis, later it was ruled out.", "History of stroke.", "Mother had stroke.", "Sepsis was ruled out.", None]
    rows = {r["document_id"]: r for r in notes.mentions(spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")).collect()}
    got = {k: (r["condition"], r["negated"], r["uncertain"], r["temporal"]) for k, r in rows.items()}
    assert got == {0: ("pneumonia", True, False, "current"), 1: ("pneumonia", False, False, "current"), 2: ("sepsis", True, True, "current"), 3: ("stroke", False, False, "historical"), 4: ("stroke", False, False, "family_history"), 5: ("sepsis", True, False, "current")}
    assert all(texts[k][r["start"] : r["end"]].lower() == r["condition"] for k, r in rows.items())


def test_overlaps(spark):
    from wardlight.operators import notes

    spans = one(spark, "document_id long, start int, end int, confidence double, label string", (1, 0, 5, 0.8, "a"), (1, 3, 9, 0.9, "b"), (1, 9, 12, 0.7, "c"), (1, 11, 14, 0.7, "d"), (2, 0, 1, 0.1, "e"))
    assert sorted((r["document_id"], r["label"]) for r in notes.resolve_overlaps(spans).collect()) == [(1, "b"), (1, "c"), (2, "e")]


def test_message_separators(spark):
    from wardlight.sources import hl7

    text = "MSH*:~\\&*lab\nPID*1**77:x**DOE:JANE\nOBX*1*NM*718-7:Hb:LN**1,234.5*g/L:u*1-2*H***P***20240102\nOBX*2*ST*:**free"
    table = spark.createDataFrame([(text,)], "message string")
    got = hl7.observations(table, as_of=F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")).orderBy("value_raw").collect()
    assert [(r["mrn"], r["loinc_display"], r["value_numeric"], r["units"], r["observation_datetime"]) for r in got] == [("77", "Hb", 1234.5, "g/L", "2024-01-02T00:00:00Z"), ("77", "", None, "", "2024-03-01T10:00:00Z")]
    assert hl7.patients(table).select("mrn", "last_name", "first_name", "date_of_birth", "gender").first() == ("77", "DOE", "JANE", None, "U")


def test_breakers(spark, sf_dir):
    import __spark_entry__ as e
    from wardlight.streaming.stateful import breaker

    state, seen = {}, []
    names = ["triage", "risk", "diagnosis", "pharmacist"]
    rows = sorted(r["event_id"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    for k in rows:
        failures, since = state.get(k % 4, ([], -1))
        failures, since, refused = breaker(failures, since, 10 * k, k % 7 < 5)
        state[k % 4] = (failures, since)
        seen.append((names[k % 4], k, refused, since >= 0))
    got = [tuple(r) for r in e.queries()["stream_breakers"](spark, sf_dir).select("agent", "seq", "refused", "open").collect()]
    assert sorted(got) == sorted(seen) and any(x[2] for x in seen) and not all(x[2] for x in seen)
    assert breaker([0, 100], -1, 299, True) == ([0, 100, 299], 299, False) and breaker([0, 100], -1, 300, True) == ([100, 300], -1, False)
    assert breaker([1], 10, 610, False) == ([1], 10, True) and breaker([1], 10, 611, False) == ([], -1, False)


def test_passes_and_pairs(spark):
    from wardlight.operators import notes, rollups

    got = rollups.pass_statistics(spark.createDataFrame([(1, 0.5), (2, 0.99)], "k long, p double"), "k", F.col("p"), 400).orderBy("k").collect()
    assert abs(got[0]["mean"] - 0.5) < 0.001 and abs(got[0]["sd"] - 0.005) < 0.0006 and got[1]["mean"] < 0.99
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)] + [(200, None), (201, [0.0] * 3), (202, [1.0]), (203, [2.0])]
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = {(i, j) for i, x in rows for j, y in rows if i < j and x and y and len(x) == len(y) and any(x) and any(y) and cos(x, y) >= 0.92}
    assert {(r["a"], r["b"]) for r in notes.cosine_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()} == want


def test_fields_go_at_any_depth(spark):
    from wardlight.functions import privacy

    schema = "id long, mrn string, p struct<full_name:string,age:int,kin:array<struct<phone:string,tie:string>>>, m map<string,struct<email:string,x:int>>"
    clean = privacy.drop_phi(spark.createDataFrame([(1, "m", ("n", 5, [("1", "son")]), {"a": ("e", 1), "city": ("e", 2)}), (2, None, None, None)], schema))
    assert clean.schema.simpleString() == "struct<id:bigint,p:struct<age:int,kin:array<struct<tie:string>>>,m:map<string,struct<x:int>>>"
    first, second = clean.orderBy("id").collect()
    assert first["p"]["kin"][0]["tie"] == "son" and set(first["m"]) == {"a"} and second["p"] is None


def test_sinks(spark, tmp_path):
    from wardlight.sources import sinks

    rows = spark.range(6).select("id", (F.col("id") % 2).alias("ward"), F.lit("x").alias("v"))
    sinks.append_new(rows, f"file://{tmp_path}/audit", ["id"])
    sinks.append_new(rows.unionByName(spark.range(6, 8).select("id", F.lit(0).cast("long").alias("ward"), F.lit("y").alias("v"))), f"file://{tmp_path}/audit", ["id"])
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 8
    sinks.by_ward(rows, f"file://{tmp_path}/wards", "ward")
    assert spark.read.parquet(f"file://{tmp_path}/wards/ward=1").count() == 3
    sinks.as_json(rows, f"file://{tmp_path}/json")
    assert sorted(r["id"] for r in spark.read.json(f"file://{tmp_path}/json").collect()) == list(range(6))


def test_plans_of_stays(spark):
    from wardlight.operators import business

    schema = "encounter_id long, los int, charlson int, ed_visits int, admission_type string, prior_readmission boolean, disposition string, age int, icd10 string"
    rows = one(spark, schema, (1, 20, 6, 4, "emergency", True, "home", 80, "I50.9"), (2, 1, 0, 0, "elective", False, "snf", 40, "Z00"))
    got = {r["encounter_id"]: r for r in business.readmission_plan(business.lace(rows)).collect()}
    assert got[1]["risk"] == "HIGH" and got[1]["risk_factors"] == ["Prior readmission within 90 days", "Discharge to home with high comorbidity burden", "Age ≥ 75", "High comorbidity burden (Charlson=6)", "4 ED visits in past 6 months"]
    assert len(got[1]["interventions"]) == 9 and got[1]["interventions"][6] == "Consider SNF or sub-acute rehabilitation evaluation" and got[2]["risk_factors"] == got[2]["interventions"] == []
    assert [r["encounter_id"] for r in business.risk_list(business.lace(rows), 0.5).collect()] == [1]
    stays = one(spark, "encounter_id long, drg string, charlson int, age int, news2 int, n_pending int, n_social int, pending array<string>, social array<string>", (1, "470", 5, 85, 6, 2, 3, ["a", "b"], ["Family meeting", "no HOME help", "transport home"]), (2, "x", 0, 1, 0, 0, 0, [], []), (3, "x", 0, 1, 0, 0, 0, None, None))
    out = {r["encounter_id"]: r for r in business.discharge_plan(business.predict_los(stays)).collect()}
    assert out[1]["barriers"] == ["disposition_placement", "family_meeting_needed", "pending_lab_results", "transport_needed"] and len(out[1]["interventions"]) == 4
    assert out[1]["interventions"][-1] == "Discharge planning team huddle: Patient predicted to exceed benchmark LOS by 3.8 days ($9,450 excess cost)"
    assert out[2]["barriers"] == out[2]["interventions"] == out[3]["barriers"] == []
    days = business.stay_days(one(spark, "admission string, discharge string", ("2024-01-01", "2024-01-03 12:00:00"), ("2024-01-02", "2024-01-01"), ("soon", "2024-01-01"), (None, None))).collect()
    assert [r["days"] for r in days] == [2.5, None, None, None]


def test_sofa_of_the_agents(spark):
    from wardlight.functions import scores

    rows = one(spark, "spo2_pulse_ox double, bp_systolic double, bp_mean double, drugs array<string>", (89.0, 89.0, 69.0, ["x", "NOREPINEPHRINE 2"]), (None, None, None, None), (95.0, 120.0, 70.0, ["vasopressin"]), (92.0, 89.0, None, []))
    v = {c: F.col(c) for c in ("spo2_pulse_ox", "bp_systolic", "bp_mean")}
    got = [tuple(r) for r in rows.select(scores.sofa_agents(v, F.col("drugs")), scores.sofa_agents(v, F.col("drugs"), True)).collect()]
    assert got == [(7, 6), (0, 0), (3, 3), (4, 2)]


def test_noise_is_gaussian(spark):
    from wardlight.operators import rollups

    rows = spark.range(400).select(F.col("id").alias("k"), F.lit(0.5).alias("p"))
    got = rollups.pass_statistics(rows, "k", F.col("p"), 100).agg(F.avg("mean").alias("m"), F.avg("sd").alias("s"), F.max(F.abs(F.col("mean") - 0.5)).alias("off")).first()
    assert abs(got["m"] - 0.5) < 1e-4 and abs(got["s"] - 0.005) < 1e-4 and got["off"] < 0.0025


def test_analysis_in_one_row(spark):
    from wardlight.operators import vitals

    readings = [(1, "heart_rate", float(80 + i % 3), i) for i in range(20)] + [(1, "heart_rate", 200.0, 30), (1, "spo2_pulse_ox", 84.0, 31), (1, "bp_systolic", 85.0, 32)]
    table = spark.createDataFrame([(p, k, v, s, f"2024-01-01 {s // 60:02d}:{s % 60:02d}:00") for p, k, v, s in readings], "patient_id long, parameter string, value double, seq long, t string").withColumn("time", F.to_timestamp_ntz("t"))
    got = {r["patient_id"]: r for r in vitals.analyze(spark.createDataFrame([(1,), (2,)], "patient_id long"), table).collect()}
    assert got[1]["priority"] == "CRITICAL" and got[1]["trend"] in ("worsening", "critical_change", "stable") and 0.001 < got[1]["uncertainty"] < 0.01
    assert "heart_rate:critical" in got[1]["anomalies"] and len(got[1]["anomalies"]) <= 3
    assert (got[2]["priority"], got[2]["alerts"], got[2]["uncertainty"], got[2]["news2"], got[2]["anomalies"], got[2]["trend"]) == ("LOW", "", 1.0, None, [], None)


def test_the_months_report(spark):
    from wardlight.operators import business

    schema = "report_month string, hospital_id string, hospital_name string, high_risk_intervened long, hrrp_conditions_intervened long, avg_los_days double, benchmark_los_days double, interactions_flagged long, critical_acted_on long, acceptance_rate double"
    r = business.financial_report(one(spark, schema, ("2024-01", "abcd", "St. X", 14, 10, 4.0, 4.5, 50, 9, 0.75))).first()
    assert (r["readmissions_prevented"], r["penalty_avoided"], r["los_reduction_days"], r["los_savings"], r["adverse_events_prevented"], r["total_value"]) == (2, 26_000.0, 0.5, 150_000.0, 2, 206_000.0)
    assert r["narrative"].startswith("In 2024-01, The system generated an estimated $206,000 in financial value for St. X.") and "75 % of recommendations" in r["narrative"]
    empty = business.financial_report(one(spark, schema, ("2024-02", "a", "Y", *[None] * 7))).first()
    assert empty["readmissions_prevented"] == 0 and empty["los_reduction_days"] == 0.3 and empty["narrative"]


def test_a_pair_is_met_once_and_not_moved(spark):
    """Two records that share all keys meet at the first alone, so no pair is searched for repeats; nulls share nothing."""
    from wardlight.operators import identity

    rows = [(1, "1111", "M1", "1950-01-01", "smith"), (2, "1111", "M1", "1950-01-01", "smyth"), (3, None, "M1", "1950-01-01", "smiles"), (4, None, None, None, None), (5, None, None, "1950-01-01", "smit"), (6, "1111", None, None, None)]
    people = spark.createDataFrame(rows, "patient_id long, ssn4 string, mrn string, dob string, last_name string")
    pairs = identity.blocked_pairs(people, people)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2), (1, 3), (1, 5), (1, 6), (2, 3), (2, 6), (3, 5)]
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_z_of_two_is_two(spark):
    """Four readings a side of sixteen equal ones and a last one at just two deviations: no order of the rows makes it less."""
    import datetime as dt

    from wardlight.operators import vitals

    found = []
    for k, (n, odd) in enumerate((n, odd) for n in range(8, 200, 4) for odd in (92.0, 91.0, 87.0)):  # a share of one in five lies two deviations off
        found += [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, "spo2_pulse_ox", odd if i % 5 == 4 else 97.0) for i in range(n // 4 * 5)]
    rows = spark.createDataFrame(found, "patient_id long, time timestamp_ntz, seq long, parameter string, value double").repartition(7)
    got = vitals.anomalies(rows).collect()
    assert len(got) == len({r[0] for r in found}) and {r["z"] for r in got} == {2.0}


def test_agreements_counted_and_ranked_as_if_all_pairs_were_made(spark):
    import random

    from wardlight.operators import identity

    rng = random.Random(5)
    some = lambda *v: rng.choice([*v, None])
    rows = [(i, some("1111", "2222", "3333"), some(*(f"M{i}" for i in range(60))), some("2001-01-01", "2002-02-02"), some("smith", "smyth", "smithers", "lee"), some("ana", "jon"), some("01", "02")) for i in range(150)]
    people = spark.createDataFrame(rows, "patient_id long, ssn4 string, mrn string, dob string, last_name string, first_name string, zip string")
    scored = {}
    for x in rows:
        for y in rows:
            alike = [None if p is None or q is None else p == q for p, q in zip(x[1:], y[1:])]
            if x[0] < y[0] and (alike[0] or alike[1] or (alike[2] and x[4] and y[4] and x[4][:3] == y[4][:3])):
                w = list(identity.WEIGHTS.values())
                got = most = 0.0  # in the order of the fields
                for a, s in zip(w, alike):
                    got, most = got + a * bool(s), most + a * (s is not None)
                raw = got / most
                conflicts = sum(alike[i] is False for i in (1, 2, 3))
                score = min(0.3, raw) if conflicts >= 2 else raw
                decision = "BLOCKED" if alike[0] is False else "AUTO_LINK" if score >= 0.95 else "REVIEW" if score >= 0.8 else "NO_MATCH"
                scored[x[0], y[0]] = (round(score, 6), conflicts, decision)
    got = identity.score_rows(identity.met_rows(people, people, list(identity.WEIGHTS)), 6).collect()
    assert len(got) == len(scored) and {(r["id_a"], r["id_b"]): (r["score"], r["conflicts"], r["decision"]) for r in got} == scored
    counts = {}
    for _, _, d in scored.values():
        counts[d] = counts.get(d, 0) + 1
    assert {r["decision"]: r["pairs"] for r in identity.decision_counts(people).collect()} == counts
    for least in (0.2, 0.5, 0.8):
        kept = identity.scored_above(people, least, 6).collect()
        assert {(r["id_a"], r["id_b"]): r["score"] for r in kept} == {k: v[0] for k, v in scored.items() if v[0] > least} and len(kept) == len({(r["id_a"], r["id_b"]) for r in kept})


def test_ranking_makes_no_pair_of_a_hot_block_that_cannot_reach_it(spark):
    from wardlight.operators import identity

    rows = spark.range(20_000).selectExpr("id AS patient_id", "CAST(id AS string) AS ssn4", "CAST(id AS string) AS mrn", "'2001-01-01' AS dob", "'lee' AS last_name", "'ana' AS first_name", "'01' AS zip").localCheckpoint()
    keys, made = [], identity.met_rows
    identity.met_rows = lambda a, b, columns=(), k=identity.KEYS: keys.extend(k) or made(a, b, columns, k)
    try:
        assert identity.scored_above(rows, 0.5).count() == 0
        assert keys == [["ssn4"], ["mrn"]]
        counts = {r["decision"]: r["pairs"] for r in identity.decision_counts(rows).collect()}
    finally:
        identity.met_rows = made
    assert counts == {"BLOCKED": 20_000 * 19_999 // 2} and ["dob", "l3"] not in keys


def test_a_fused_mean_of_just_a_level_has_that_level(spark):
    """Findings of severities below and above a level that weigh the same: no order of the rows makes the mean less than the level."""
    from wardlight.operators import agents

    rows = []
    for p in range(400):
        n, (low, high, source) = 2 + p % 5, [("mild", "severe", "nlp"), ("moderate", "critical", "vitals"), ("mild", "severe", "labs")][p % 3]
        rows += [(p, source, s, (1 + (p * 7 + i * 11) % 60) / 64, False) for i in range(n) for s in (low, high)]
    got = agents.fusion_risk(spark.createDataFrame(rows, "patient_id long, source string, severity string, confidence double, negated boolean").repartition(5)).collect()
    assert {(r["patient_id"] % 3, r["level"]) for r in got} == {(0, "HIGH"), (1, "CRITICAL"), (2, "HIGH")} and len(got) == 400
