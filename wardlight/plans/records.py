"""Named queries over resources, outputs and the patient index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import privacy, rules
from wardlight.operators import agents, fhir, governance, identity, outputs, registry
from wardlight.plans.catalog import _ALLOWED, _MPI, _REQUESTS, AS_OF, SALT, _case, access_requests, query
from wardlight.sources import fixtures as fx
from wardlight.sources import hl7

# ---- resources -------------------------------------------------------------------------------------------------
_BIRTH, _WHEN, _ICD = ["1980-01-02", "1980-01", "02/01/1980", "1980"], ["2024-01-02T03:04:05Z", "", "yesterday"], ["A41.9", "I21", "a41.9", "K92.22222"]


def bundles(spark, sf_dir):
    """One bundle of six resources a customer, as JSON, with faults by the key's remainders; every thirteenth is no Bundle."""
    c, k = fx.spread(fx.table(spark, sf_dir, "customer")), F.col("c_custkey")
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    either = lambda t, a, b: F.when(t, F.lit(a)).otherwise(F.lit(b) if isinstance(b, str) else b)
    subject = q('"subject":{"reference":"Patient/p-', k, '"}')
    patient = q('{"resourceType":"Patient","id":"p-', k, '","identifier":', F.when(k % 5 == 0, "[]").otherwise(q('[{"type":{"coding":[{"code":"', either(k % 6 == 0, "SS", "MR"), '"}]},"value":"M', k, '"}]')), ',"name":[{', either(k % 7 == 0, '"given":["A"]', '"family":"SMITH"'), '}],"birthDate":"', fx.pick(_BIRTH, k), '"}')
    obs = q('{"resourceType":"Observation","id":"o-', k, '","status":"', fx.pick(["final", "done", "amended"], k), '","code":{"coding":[{"system":"', either(k % 4 == 0, "urn:x", "http://loinc.org"), '","code":"', either(k % 3 == 0, "8867-4", "0000-0"), '"}]},"category":[{"coding":[{"code":"vital-signs"}]}],', subject, ',"effectiveDateTime":"', fx.pick(_WHEN, k), '"', either(k % 6 == 1, "", ',"valueQuantity":{"value":7}'), "}")
    med = q('{"resourceType":"MedicationRequest","id":"m-', k, '","status":"', fx.pick(["active", "paused"], k), '","intent":"order","medicationCodeableConcept":{"coding":[{"system":"', either(k % 3 == 0, "local", "urn:RxNorm"), '"}]},', subject, either(k % 4 == 0, "", ',"dosageInstruction":[{"text":"daily"}]'), "}")
    con = q('{"resourceType":"Condition","id":"c-', k, '","clinicalStatus":"active","code":{"coding":[{"system":"ICD10","code":"', fx.pick(_ICD, k), '"}]},', subject, "}")
    enc = q('{"resourceType":"Encounter","id":"e-', k, '","status":"', fx.pick(["planned", "gone"], k), '","class":"IMP",', subject, "}")
    alg = q('{"resourceType":"AllergyIntolerance","id":"a-', k, '","clinicalStatus":"active","code":{"text":"x"}', either(k % 9 == 0, "", ',"patient":{"reference":"p"}'), "}")
    entries = F.array_join(F.transform(F.array(patient, obs, med, con, enc, alg), lambda r: F.concat(F.lit('{"resource":'), r, F.lit("}"))), ",")
    return c.select(k.alias("bundle_id"), q('{"resourceType":"', either(k % 13 == 0, "List", "Bundle"), '","entry":[', entries, "]}").alias("bundle"))


def _l(tests: list[tuple[str, str]]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN {m} END" for t, m in tests) + ")"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_birth, _when, _icd = (fx._sql_pick(x, "k") for x in (_BIRTH, _WHEN, _ICD))
_FAULTS = {
    "p": ("Patient", [("k % 5 = 0", _q("Missing required field: identifier")), ("k % 7 = 0", _q("Patient name missing family (last name)")), ("k % 4 = 2", f"'birthDate format invalid: ' || {_birth} || ' (expected YYYY-MM-DD)'")], [("k % 5 = 0 OR k % 6 = 0", _q("Patient has no MRN identifier (code=MR)"))]),
    "o": ("Observation", [("k % 3 = 1", _q("Invalid status 'done' for Observation")), ("k % 6 = 1", _q("Vital sign Observation must have a value")), ("k % 3 = 1", _q("Observation must have effectiveDateTime or effectivePeriod")), ("k % 3 = 2", f"'effectiveDateTime format invalid: ' || {_when}")], [("k % 4 = 0", _q("Observation has no LOINC coding")), ("k % 4 <> 0 AND k % 3 <> 0", _q("LOINC code '0000-0' not in the registry"))]),
    "m": ("MedicationRequest", [("k % 2 = 1", _q("Invalid status 'paused' for MedicationRequest"))], [("k % 3 = 0", _q("MedicationRequest has no RxNorm coding")), ("k % 4 = 0", _q("MedicationRequest missing dosageInstruction"))]),
    "c": ("Condition", [("k % 4 IN (2, 3)", f"'ICD-10 code format invalid: ''' || {_icd} || ''' (expected A00.0 format)'")], [("false", "''")]),
    "e": ("Encounter", [("k % 2 = 1", _q("Invalid status 'gone' for Encounter"))], [("false", "''")]),
    "a": ("AllergyIntolerance", [("k % 9 = 0", _q("Missing required field: patient"))], [("false", "''")]),
}
_VALID = "WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0), v AS (" + " UNION ALL ".join(f"SELECT k AS bundle_id, '{t}' AS resource_type, '{p}-' || k AS resource_id, {_l(e)} AS errors, {_l(w)} AS warnings FROM c" for p, (t, e, w) in _FAULTS.items()) + ")"


def _validated(spark, sf_dir):
    return fhir.validate(fhir.bundle_entries(bundles(spark, sf_dir)))


@query(f"{_VALID} SELECT *, errors = '' AS is_valid FROM v")
def fhir_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("bundle_id", "resource_type", "resource_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


@query(f"{_VALID} SELECT bundle_id, count(*) FILTER (WHERE errors = '') AS valid, count(*) AS total FROM v GROUP BY bundle_id")
def fhir_bundle_counts(spark, sf_dir):
    return fhir.bundle_counts(_validated(spark, sf_dir), "bundle_id")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0) SELECT 'p-' || k AS resource_id, CASE WHEN k % 5 = 0 THEN 'Missing required field for Patient: identifier' ELSE '' END AS errors FROM c
    UNION ALL SELECT 'o-' || k, CASE WHEN k % 3 = 1 THEN 'Missing required field for Observation: effectiveDateTime' ELSE '' END FROM c UNION ALL SELECT x || '-' || k, '' FROM c, (VALUES ('m'), ('c'), ('e'), ('a')) t(x)""")
def fhir_structure(spark, sf_dir):
    rows = fhir.check_structure(fhir.bundle_entries(bundles(spark, sf_dir)))
    return rows.select(F.get_json_object("resource", "$.id").alias("resource_id"), F.array_join("structure_errors", "; ").alias("errors"))


_GENDER, _STATE = ["M", "f", "U", "OTHER", "1", "2", "x", ""], ["MA", "NY", "CA"]


def _raw_patients(spark, sf_dir):
    p, k = fx.patients(spark, sf_dir), F.col("patient_id")
    text = lambda f: F.date_format("dob", f)
    dob = F.when(k % 6 == 0, text("yyyy-MM-dd")).when(k % 6 == 1, text("MM/dd/yyyy")).when(k % 6 == 2, text("yyyyMMdd")).when(k % 6 == 3, F.concat(F.lit("25/"), text("MM/yyyy"))).when(k % 6 == 4, "spring").otherwise("")
    return p.select(
        k, F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("mrn")).alias("mrn"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit(" "), F.col("last_name"))).alias("last_name"), "first_name", F.lit("").alias("middle_name"), dob.alias("date_of_birth"),
        fx.pick(_GENDER, k).alias("gender"), F.when(k % 3 == 0, "555").alias("phone"), F.when(k % 4 == 0, "a@b.c").alias("email"), F.when(k % 2 == 0, "1 Main St").alias("address_line1"), F.lit("Boston").alias("city"), fx.pick(_STATE, k).alias("state"), "zip",
    )


_PATIENT = f"""b AS (SELECT patient_id AS k, last_name, zip, mrn, CASE WHEN patient_id % 6 < 3 THEN dob WHEN patient_id % 6 = 3 THEN make_date(year(dob), month(dob), 25) END AS born, {_case({g: f"'{v}'" for g, v in rules.GENDERS.items()}, f"upper({fx._sql_pick(_GENDER, 'patient_id')})", "'unknown'")} AS gender FROM patients),
n AS (SELECT *, {_l([("k % 11 = 0", _q("Missing required field: MRN")), ("k % 17 = 0", _q("Missing required field: last_name")), ("k % 6 = 5", _q("Missing required field: date_of_birth")), ("k % 6 = 4", _q("Cannot parse date_of_birth: spring"))])} AS errors,
(4 + (k % 3 = 0 OR k % 4 = 0)::INT + (k % 2 = 0)::INT)::DOUBLE AS filled FROM b)"""


@query(f"""{_PATIENT} SELECT k AS patient_id, upper(last_name) AS family, strftime(born, '%Y-%m-%d') AS birth_date, gender, errors, CASE WHEN gender = 'unknown' THEN 'Gender unknown or not mapped' ELSE '' END AS warnings, errors = '' AS success,
    CASE WHEN errors <> '' THEN 0.2 ELSE round(0.3 * filled / 6 + 0.25 + 0.25 * CASE WHEN gender = 'unknown' THEN 0.85 ELSE 1.0 END + 0.2 * CASE WHEN gender = 'unknown' THEN 0.7 ELSE 0.9 END, 4) END::DOUBLE AS quality
    FROM n WHERE k % 17 <> 0 UNION ALL SELECT k, NULL, strftime(born, '%Y-%m-%d'), gender, errors, CASE WHEN gender = 'unknown' THEN 'Gender unknown or not mapped' ELSE '' END, false, 0.2::DOUBLE FROM n WHERE k % 17 = 0""", "patients")
def fhir_patient(spark, sf_dir):
    n = fhir.normalize_patient(_raw_patients(spark, sf_dir))
    return n.select("patient_id", F.get("patient.name", F.lit(0))["family"].alias("family"), F.col("patient.birthDate").alias("birth_date"), "patient.gender", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "success", "quality")


_PT = lambda text, kind: f"'{kind}-' || upper(substr({privacy.hmac_sql(text + f' || {chr(39)}:{kind}{chr(39)}', SALT)}, 1, 16))"


@query(f"""{_PATIENT} SELECT k AS patient_id, {_PT("'__' || k", "PAT")} AS id, CASE WHEN k % 11 <> 0 THEN {_PT("mrn", "MRN")} END AS mrn, {_PT("k::VARCHAR", "NAME")} AS name, gender, strftime(born, '%Y') AS birth_date,
    CASE WHEN k % 2 = 0 THEN {fx._sql_pick(_STATE, "k")} END AS state, CASE WHEN k % 2 = 0 THEN substr(zip, 1, 3) || '000' END AS zip FROM n""", "patients")
def fhir_deidentify(spark, sf_dir):
    n = fhir.normalize_patient(_raw_patients(spark, sf_dir)).withColumn("patient", F.col("patient").withField("id", F.lit(None).cast("string")))
    d = fhir.deidentify_patient(n, SALT)
    at = lambda c, f: F.get(f"deidentified.{c}", F.lit(0))[f]
    return d.select("patient_id", "deidentified.id", at("identifier", "value").alias("mrn"), at("name", "text").alias("name"), "deidentified.gender", F.col("deidentified.birthDate").alias("birth_date"), at("address", "state").alias("state"), at("address", "postalCode").alias("zip"))


_RANGE = {i: _case({k: v[i] for k, v in rules.FHIR_RANGES.items() if v[i] is not None}, "p") for i in range(4)}


@query(f"""o AS (SELECT seq, value, CASE WHEN seq % 17 = 0 THEN 'mood' ELSE parameter END AS p FROM vitals), l AS (SELECT *, {_RANGE[0]} AS lo, {_RANGE[1]} AS hi, {_RANGE[2]} AS cl, {_RANGE[3]} AS ch FROM o)
    SELECT seq, {_case({k: f"'{rules.LOINC[k][0]}'" for k in rules.FHIR_PARAMETERS}, "p", "'UNKNOWN'")} AS code, CASE WHEN value < lo OR value > hi THEN 'entered-in-error' ELSE 'final' END AS status,
    CASE WHEN value < cl THEN 'LL' WHEN value > ch THEN 'HH' WHEN value < cl + coalesce(ch, -cl) * 0.1 THEN 'L' WHEN value > ch * 0.9 THEN 'H' END AS interpretation,
    CASE WHEN p = 'mood' THEN 0.2 WHEN value < lo OR value > hi THEN 0.7 ELSE 0.95 END::DOUBLE AS quality FROM l""", "vitals")
def fhir_observation(spark, sf_dir):
    v = fx.vitals(spark, sf_dir).withColumn("parameter", F.when(F.col("seq") % 17 == 0, "mood").otherwise(F.col("parameter")))
    return fhir.normalize_observation(v).select("seq", "code", "status", "interpretation", "quality")


@query("""SELECT encounter_id, drug, CASE WHEN encounter_id % 4 = 0 THEN 'UNKNOWN' ELSE 'rx' || (encounter_id % 7) END AS code, '5.0 mg bid oral' AS dosage, 'Patient/' || patient_id AS subject, (encounter_id % 4 = 0)::INT AS warnings,
    CASE WHEN encounter_id % 4 = 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS quality FROM medications""", "medications")
def fhir_medication(spark, sf_dir):
    k = F.col("encounter_id")
    orders = fx.medications(spark, sf_dir).select("patient_id", k, "drug", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("rx"), k % 7)).alias("rxnorm"), F.lit(5.0).alias("dose"), F.lit("mg").alias("dose_unit"), F.lit("bid").alias("frequency"), F.lit("oral").alias("route"))
    n = fhir.normalize_medication(orders)
    return n.select(k, "drug", F.get("request.medicationCodeableConcept.coding", F.lit(0))["code"].alias("code"), F.get("request.dosageInstruction", F.lit(0))["text"].alias("dosage"), F.col("request.subject.reference").alias("subject"), F.size("warnings").alias("warnings"), "quality")


@query(f"""SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE v.parameter END AS parameter, CASE WHEN seq % 9 > 0 THEN 'vital-signs' END AS category, CASE WHEN seq % 9 = 0 THEN NULL ELSE has_unit END AS has_unit FROM vitals v
    JOIN (VALUES {', '.join(f"({_q(k)}, {u is not None}::BOOLEAN)" for k, (c, u) in rules.LOINC.items())}) t(parameter, has_unit) USING (parameter)""", "vitals")
def loinc_registry(spark, sf_dir):
    """Coded readings looked up in the registry by code, with what the registry lacks of them; codes that it does not know come out without."""
    rows = spark.createDataFrame([(k, c, k.replace("_", " "), u) for k, (c, u) in rules.LOINC.items()], "parameter string, code string, display string, unit string")
    gaps = fhir.registry_gaps(rows).filter("complete").select("parameter", (~F.array_contains("issues", "missing unit")).alias("has_unit"))
    codes = F.create_map(*[x for k, (c, _) in rules.LOINC.items() for x in (F.lit(k), F.lit(c))])
    coded = fx.vitals(spark, sf_dir).select("seq", F.when(F.col("seq") % 9 == 0, "0000-0").otherwise(F.element_at(codes, F.col("parameter"))).alias("code"))
    return fhir.with_parameter(coded).join(gaps, "parameter", "left").select("seq", "parameter", "category", "has_unit")


@query("""SELECT patient_id, ((patient_id % 11 <> 0)::INT + (patient_id % 17 <> 0)::INT + 1 + (patient_id % 6 <> 5)::INT) / 4.0::DOUBLE AS completeness FROM patients""", "patients")
def record_quality(spark, sf_dir):
    return fhir.record_quality(_raw_patients(spark, sf_dir), ["mrn", "last_name", "first_name", "date_of_birth"]).select("patient_id", "completeness")


# ---- model outputs ---------------------------------------------------------------------------------------------
def _outputs(spark, sf_dir):
    """Answers of a model by event: fenced, wrapped in prose, cut off or plain, with faults by the key's remainders."""
    k = F.col("event_id")
    summary = F.when(k % 5 == 0, "too short").otherwise(F.lit(" ".join(["word"] * 16)))
    fields = F.struct(
        summary.alias("patient_state_summary"), F.array(F.struct(F.when(k % 7 == 0, "").otherwise("Sepsis").alias("condition"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("fever"))).alias("supporting_evidence"), F.lit("primary").alias("probability_rank"), F.when(k % 11 == 0, 1.5).otherwise(0.5).alias("confidence"))).alias("differential_diagnoses"),
        fx.pick(["LOW", "HIGH", "CRITICAL", "SOME"], k).alias("risk_level"), F.lit("because").alias("risk_justification"), F.array(F.struct(F.lit("call").alias("action"), F.when(k % 9 == 0, "later").otherwise("immediate").alias("urgency"), F.when(k % 8 == 3, "").otherwise("why").alias("rationale"))).alias("recommended_actions"),
        F.lit("HIGH").alias("overall_confidence"), F.array().cast("array<string>").alias("data_gaps"), (k % 3 == 0).alias("human_review_required"), F.lit("").alias("human_review_reason"),
    )
    text = F.to_json(fields)
    text = F.when(k % 17 == 0, F.regexp_replace(text, '"data_gaps":\\[\\],', "")).otherwise(text)
    raw = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("Here it is: "), text, F.lit(" Done."))).when(k % 13 == 0, F.substring(text, 1, 40)).otherwise(text)
    return fx.spread(fx.table(spark, sf_dir, "events")).select(k, F.col("user_id"), (k % 4).cast("int").alias("attempt"), raw.alias("raw"))


_RISKS = fx._sql_pick(["LOW", "HIGH", "CRITICAL", "SOME"], "k")
_OUTPUT = f"""WITH e AS (SELECT event_id AS k, user_id FROM events), v AS (SELECT k, user_id, CASE WHEN k % 13 = 0 AND k % 4 > 1 THEN 'unreadable' WHEN k % 17 = 0 THEN 'Missing required field: data_gaps' ELSE {_l([
    ("k % 4 = 3", "'Invalid risk_level: SOME'"), ("k % 4 IN (1, 2) AND k % 3 <> 0", "'GUARDRAIL: HIGH/CRITICAL risk but human_review_required=False'"), ("k % 7 = 0", "'differential[0] missing condition'"), ("k % 6 = 0", "'GUARDRAIL: differential[0] has no supporting_evidence'"),
    ("k % 11 = 0", "'differential[0] confidence out of range'"), ("k % 8 = 3", "'GUARDRAIL: action[0] missing rationale'"), ("k % 9 = 0", "'action[0] invalid urgency'"), ("k % 5 = 0", "'patient_state_summary too short (2 words, min 15)'")])} END AS errors, {_RISKS} AS risk FROM e)"""  # fmt: skip


@query(f"""{_OUTPUT} SELECT k AS event_id, errors, errors = '' AS valid, CASE WHEN errors <> 'unreadable' THEN risk IN ('HIGH', 'CRITICAL') OR k % 3 = 0 END AS review,
    CASE WHEN errors = 'unreadable' THEN NULL WHEN risk IN ('HIGH', 'CRITICAL') THEN risk || ' risk: physician review required' ELSE '' END AS reason FROM v""")
def output_validation(spark, sf_dir):
    v = outputs.validate_outputs(_outputs(spark, sf_dir))
    return v.select("event_id", F.array_join("errors", "; ").alias("errors"), "valid", F.col("output.human_review_required").alias("review"), F.col("output.human_review_reason").alias("reason"))


@query(f"""{_OUTPUT}, a AS (SELECT user_id, k % 4 AS attempt, bool_or(errors = '') AS ok, bool_or(errors <> 'unreadable') AS readable FROM v WHERE k % 4 < 3 GROUP BY ALL),
    p AS (SELECT user_id, coalesce(min(attempt) FILTER (WHERE ok), max(attempt) FILTER (WHERE readable)) AS retries FROM a GROUP BY user_id) SELECT user_id, retries::INT AS retries, CASE WHEN retries IS NULL THEN 'reasoning_failed' ELSE 'success' END AS status FROM p""")
def output_attempts(spark, sf_dir):
    """The answer kept for each user; several answers of one attempt count as that attempt."""
    got = outputs.first_valid(_outputs(spark, sf_dir), "user_id")
    return got.groupBy("user_id").agg(F.max("retries").alias("retries"), F.max("status").alias("status"))


@query("""WITH t AS (SELECT patient_id, parameter, value, time, seq, row_number() OVER (PARTITION BY patient_id ORDER BY time DESC, seq DESC) AS n FROM (SELECT * FROM vitals)),
    v AS (SELECT patient_id, string_agg(parameter || ': ' || value::INT, chr(10) ORDER BY n) AS text FROM t WHERE n <= 20 GROUP BY patient_id),
    s AS (SELECT patient_id, '### VITALS' || chr(10) || text AS a, length(text) // 4 AS ta FROM v) SELECT patient_id, a || chr(10) || chr(10) || '### PLAN' || chr(10) || 'monitor' AS context, (ta + 1)::BIGINT AS tokens FROM s WHERE ta + 1 < 150
    UNION ALL SELECT patient_id, '### PLAN' || chr(10) || 'monitor', 1::BIGINT FROM s WHERE ta >= 150 UNION ALL SELECT patient_id, a, ta::BIGINT FROM s WHERE ta < 150 AND ta + 1 >= 150""".replace("WITH t AS", "t AS", 1), "vitals")
def prompt_context(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    text = outputs.section(v, "patient_id", F.concat("parameter", F.lit(": "), F.rint("value").cast("int")), [F.desc("time"), F.desc("seq")], 20)
    parts = text.select("patient_id", F.lit(1).alias("pos"), F.lit("VITALS").alias("title"), "text").unionByName(text.select("patient_id", F.lit(2).alias("pos"), F.lit("PLAN").alias("title"), F.lit("monitor").alias("text")))
    return outputs.assemble(parts, "patient_id", 150)


@query("""SELECT c_custkey, 'S: cough' || chr(10) || 'O: ESI ' || (1 + c_custkey % 3) || ', risk ' || (CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END) || chr(10) || 'A: ' || (CASE WHEN c_custkey % 4 = 0 THEN 'pending' ELSE 'Sepsis' END) || chr(10) || 'P: ' ||
    concat_ws(' | ', CASE WHEN c_custkey % 3 = 0 THEN 'Immediate resuscitation' END, CASE WHEN c_custkey % 2 = 0 THEN 'Escalate to physician' END, 'Continue monitoring') AS note,
    concat_ws('; ', CASE WHEN c_custkey % 4 = 0 THEN 'Differential diagnosis not documented' END, CASE WHEN c_custkey % 5 = 0 THEN 'Medication reconciliation pending' END) AS gaps FROM customer""")
def soap_note(spark, sf_dir):
    c, k = fx.table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(k, F.lit("cough").alias("complaint"), (1 + k % 3).alias("esi"), F.when(k % 2 == 0, "HIGH").otherwise("LOW").alias("level"), F.when(k % 4 > 0, "Sepsis").alias("diagnosis"), (k % 4 > 0).alias("has_diagnosis"), (k % 5 > 0).alias("has_pharmacy"))
    return outputs.soap_note(rows).select(k, "note", F.array_join("gaps", "; ").alias("gaps"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'triage,risk,diagnosis,pharmacist,documentation,coordinator,escalation' WHEN 'view' THEN 'risk,coordinator,escalation' WHEN 'purchase' THEN 'pharmacist,coordinator,escalation'
    WHEN 'click' THEN 'diagnosis,documentation,coordinator' ELSE 'risk' END AS agents FROM events""")
def event_routing(spark, sf_dir):
    kinds = {"signup": "admission", "view": "vitals_update", "purchase": "medication_order", "click": "diagnosis_request"}
    e = fx.table(spark, sf_dir, "events").withColumn("event_type", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("other")))
    return outputs.route_events(e).select("event_id", F.array_join("agents", ",").alias("agents"))


# ---- gateway and privacy ---------------------------------------------------------------------------------------
_REASONS = ["treatment", "operations", "ai_inference"]


@query(f"""WITH {_REQUESTS}, r AS (SELECT req.* REPLACE ({fx._sql_pick(_REASONS, "req.event_id // 5")} AS reason), user_id FROM req JOIN events USING (event_id)),
    c AS (SELECT user_id, coalesce(arg_max(value >= 40, (ts, event_id)) FILTER (WHERE event_id % 2 = 1), false) AS ai FROM events GROUP BY user_id), d AS (SELECT *, {_ALLOWED} AS allowed FROM r)
    SELECT event_id, allowed, CASE WHEN allowed THEN 'success' ELSE 'denied' END AS outcome, allowed AND (role IN ('ai_system', 'researcher') OR reason = 'ai_inference' AND NOT ai) AS deidentify FROM d JOIN c USING (user_id)""")
def gateway_decisions(spark, sf_dir):
    return governance.gateway(*gateway_inputs(spark, sf_dir)).select("event_id", "allowed", "outcome", "deidentify")


def gateway_inputs(spark, sf_dir):
    """Requests and the last consents of their patients."""
    e, k = fx.table(spark, sf_dir, "events"), F.col("event_id")
    requests = access_requests(spark, sf_dir).withColumn("reason", fx.pick(_REASONS, F.floor(k / 5))).join(e.select(k, F.col("user_id").alias("patient_id")), "event_id")
    consents = governance.latest_consent(e.select(F.col("user_id").alias("patient_id"), F.when(k % 2 == 1, "ai_use").otherwise("treatment_use").alias("kind"), (F.col("value") >= 40).alias("granted"), F.col("ts").alias("at"), k.alias("seq")), ["ai_use"])
    return requests, consents


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'treatment_use' ELSE 'ai_use' END AS kind FROM events WHERE event_id % 2 = 1")
def consent_updates(spark, sf_dir):
    k = F.col("event_id")
    return governance.update_consent(fx.table(spark, sf_dir, "events").select(k, F.when(k % 2 == 0, "treatment_use").otherwise("ai_use").alias("kind")))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"patient":{"id":"p' || c_custkey || '","contacts":[{"kind":"home"},{"kind":"work"}]},"labels":{"ward":"icu"}}' AS cleaned FROM customer""")
def phi_removal(spark, sf_dir):
    """Identifying fields at the top, inside structs, arrays and maps go."""
    c = fx.table(spark, sf_dir, "customer")
    contact = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("c_phone").alias("phone")) if "c_phone" in c.columns else F.struct(F.lit(kind).alias("kind"), F.lit("555").alias("phone"))
    patient = F.struct(F.concat(F.lit("p"), "c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.array(contact("home"), contact("work")).alias("contacts"), F.struct(F.lit("x").alias("city")).alias("address"))
    rows = c.select("c_custkey", patient.alias("patient"), F.lit("a@b.c").alias("email"), F.create_map(F.lit("ward"), F.lit("icu"), F.lit("mrn"), F.lit("7")).alias("labels"))
    clean = privacy.drop_phi(rows)
    return clean.select("c_custkey", F.to_json(F.struct(*clean.columns)).alias("cleaned"))


@query("SELECT c_custkey, c_name AS name, 12 + strlen(c_name) + 16 AS sealed_bytes FROM customer")
def aes_round_trip(spark, sf_dir):
    key = b"0123456789abcdef0123456789abcdef"
    c = fx.table(spark, sf_dir, "customer").withColumn("sealed", privacy.encrypt(F.col("c_name"), key))
    return c.select("c_custkey", privacy.decrypt(F.col("sealed"), key).alias("name"), F.octet_length(F.unbase64("sealed")).alias("sealed_bytes"))


@query("SELECT patient_id, last_name || ', ' || first_name AS name, year(dob)::INT AS birth_year, substr(zip, 1, 3) AS zip3 FROM patients", "patients")
def patient_list_physician(spark, sf_dir):
    return governance.patient_view(fx.patients(spark, sf_dir), "physician")


@query("SELECT patient_id, NULL::VARCHAR AS name, year(dob)::INT AS birth_year, substr(zip, 1, 3) AS zip3 FROM patients", "patients")
def patient_list_nurse(spark, sf_dir):
    return governance.patient_view(fx.patients(spark, sf_dir), "nurse")


@query("SELECT patient_id, last_name, (SELECT count(*) FROM patients) > 40 AS has_more FROM patients ORDER BY patient_id LIMIT 20 OFFSET 20", "patients")
def patient_page(spark, sf_dir):
    """Page 2 of 20 patients each: a limit is the feature."""
    return governance.page(fx.patients(spark, sf_dir).select("patient_id", "last_name"), ["patient_id"], 2, 20)


_HASH = lambda expr, prefix: f"CASE WHEN trim({expr}) = '' THEN '' ELSE {privacy.hmac_sql(f'{chr(39)}{prefix}:{chr(39)} || upper(trim({expr}))', SALT)} END"
_SYSTEMS = ["epic", "lab", "clinic"]


def _source_rows(spark, sf_dir):
    p, k = fx.patients(spark, sf_dir), F.col("patient_id")
    return p.select(k, fx.pick(_SYSTEMS, k).alias("source_system"), F.concat(F.lit("m"), k).alias("mrn"), "last_name", "first_name", F.lit("").alias("middle_name"), F.col("dob").cast("string").alias("dob"), "ssn4", "zip", F.lit("U").alias("gender"))


@query(f"""r AS (SELECT *, {fx._sql_pick(_SYSTEMS, "patient_id")} || ':m' || patient_id AS link FROM patients)
    SELECT {_PT("link", "MPI")} AS global_id, link AS mrns, {_HASH("last_name", "LN")} || '|' || {_HASH("first_name", "FN")} || '|' AS name_hash, CASE WHEN ssn4 IS NULL THEN '' ELSE {_HASH("ssn4", "SSN4")} END AS ssn_hash, substr(zip, 1, 3) AS zip3 FROM r""", "patients")
def mpi_records(spark, sf_dir):
    r = registry.canonical_records(_source_rows(spark, sf_dir), SALT)
    return r.select("global_id", F.array_join("mrn_list", ",").alias("mrns"), "name_hash", "ssn_hash", "zip3")


_DECISIONS = ["AUTO_LINK", "REVIEW", "NO_MATCH", "BLOCKED"]


def _linked(spark, sf_dir):
    rows, k = _source_rows(spark, sf_dir), F.col("patient_id")
    records = registry.canonical_records(rows, SALT)
    link = F.concat_ws(":", "source_system", "mrn")
    links = rows.select(privacy.pseudonym(link, "MPI", SALT).alias("global_id"), F.when(k % 6 == 0, F.col("source_system")).otherwise("ward").alias("source_system"), F.when(k % 6 == 0, F.col("mrn")).otherwise("w1").alias("mrn"), F.lit(0.9).alias("confidence"), fx.pick(_DECISIONS, k).alias("decision"), F.lit("loader").alias("linked_by"), F.when(k % 8 == 1, "dr x").alias("reviewed_by"))
    return registry.link_records(records, links.unionByName(links), F.lit(AS_OF).cast("timestamp"))


_LINKED = f"""l AS (SELECT patient_id AS k, {fx._sql_pick(_SYSTEMS, "patient_id")} AS s, patient_id % 4 = 0 OR patient_id % 8 = 1 AS linked FROM patients)"""


@query(f"""{_LINKED} SELECT {_PT("s || ':m' || k", "MPI")} AS global_id, CASE WHEN linked AND k % 6 <> 0 THEN array_to_string(list_sort([s || ':m' || k, 'ward:w1']), ',') ELSE s || ':m' || k END AS mrns, CASE WHEN linked AND k % 6 <> 0 THEN array_to_string(list_sort([s, 'ward']), ',') ELSE s END AS systems FROM l""", "patients")
def mpi_links(spark, sf_dir):
    records, _ = _linked(spark, sf_dir)
    return records.select("global_id", F.array_join("mrn_list", ",").alias("mrns"), F.array_join("source_systems", ",").alias("systems"))


@query(f"""{_LINKED} SELECT count(*) AS records, count(*) FILTER (WHERE linked AND k % 6 <> 0) AS multi_source, 2 * count(*) FILTER (WHERE k % 4 = 1 AND k % 8 <> 1) AS pending_review, 2 * count(*) FILTER (WHERE k % 4 = 0) AS auto_linked, 2 * count(*) FILTER (WHERE k % 4 IN (2, 3)) AS conflicts FROM l""", "patients")
def mpi_index_statistics(spark, sf_dir):
    return registry.index_statistics(*_linked(spark, sf_dir))


@query(f"{_MPI}, r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS rank FROM m WHERE score > 0.5) SELECT id_a, id_b, score, decision, rank::INT AS rank FROM r", "patients")
def mpi_ranked(spark, sf_dir):
    return registry.ranked_matches(identity.scored_above(fx.patients(spark, sf_dir), 0.50, 6)).select("id_a", "id_b", "score", "decision", "rank")


@query("""r AS (SELECT patient_id, parameter, time, min(seq) AS seq FROM vitals GROUP BY ALL) SELECT patient_id, parameter, time, seq FROM r WHERE (patient_id, parameter, time) NOT IN (SELECT patient_id, parameter, time FROM vitals WHERE seq % 3 = 0)""", "vitals")
def insert_ignore(spark, sf_dir):
    """Readings to append to a table that has every third one already, each key once."""
    v = fx.vitals(spark, sf_dir)
    return registry.insert_new(v.filter("seq % 3 = 0"), v, ["patient_id", "parameter", "time"], [F.col("seq")]).select("patient_id", "parameter", "time", "seq")


@query("""SELECT c_custkey, 'ADT' AS message_type, 'id' || c_custkey AS message_id, 'M' || c_custkey AS mrn, 'DOE' AS last_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'JANE' END AS first_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '1980-02-03' END AS date_of_birth,
    CASE WHEN c_custkey % 5 = 0 THEN 'U' ELSE 'F' END AS gender, CASE WHEN c_custkey % 2 = 0 THEN '6789' ELSE '' END AS ssn_last4, 'Boston' AS city, '02139' AS zip_code FROM customer""")
def hl7_patients(spark, sf_dir):
    """Demographics out of messages with two kinds of separators."""
    k = F.col("c_custkey").cast("string")
    sep, n = F.when(F.col("c_custkey") % 7 == 0, "~").otherwise("^"), F.col("c_custkey")
    join = lambda *parts: F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    comp = lambda *parts: F.concat_ws("", *[x for i, p in enumerate(parts) for x in ([sep] if i else []) + [F.lit(p) if isinstance(p, str) else p]])
    msh = join(F.concat(F.lit("MSH|"), sep, F.lit("&#")), "app", "fac", "", "", "20240101", "", "ADT", F.concat(F.lit("id"), k))
    pid = join("PID", "1", "", comp(F.concat(F.lit("M"), k), "x"), "", F.when(n % 3 == 0, "DOE").otherwise(comp("DOE", "JANE")), "", F.when(n % 4 == 0, "1980").otherwise("19800203"), F.when(n % 5 == 0, "Q").otherwise("f"), "", "", comp("1 Main", "", "Boston", "MA", "02139"), "", "", "", "", "", "", "", F.when(n % 2 == 0, "123-45-6789").otherwise("x"))
    msgs = fx.table(spark, sf_dir, "customer").select("c_custkey", F.concat(msh, F.lit("\r\n"), pid).alias("message"))
    p = hl7.patients(msgs)
    return p.select(F.substring("mrn", 2, 20).cast("long").alias("c_custkey"), "message_type", "message_id", "mrn", "last_name", "first_name", "date_of_birth", "gender", "ssn_last4", "city", "zip_code")
