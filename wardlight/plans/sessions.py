"""Named queries over predicates, patient sessions and prompts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import rules
from wardlight.operators import predicates, prompts, sessions, vitals
from wardlight.plans.catalog import _MODEL, _SCORED, AS_OF, query
from wardlight.sources import fixtures as fx

# ---- predicates of single tables ---------------------------------------------------------------------------------
_KINDS, _SEVERITIES = ["drug", "food", "environment"], ["mild", "moderate", "severe", "life_threatening"]
_CLEARED = " OR ".join(f"contains(lower(drug), '{d}')" for d in rules.RENALLY_CLEARED)


@query(f"""f AS (SELECT encounter_id, {_CLEARED} AS cleared, {fx._sql_pick(_KINDS, "patient_id")} = 'drug' AS drug_allergy, {fx._sql_pick(_SEVERITIES, "patient_id // 3")} = 'life_threatening' AS grave FROM medications)
    SELECT encounter_id, count(*) AS drugs, count(*) FILTER (WHERE cleared) AS renally_cleared, bool_or(drug_allergy) AS drug_allergy, bool_or(drug_allergy AND grave) AS grave_drug_allergy FROM f GROUP BY encounter_id""", "medications")
def medication_flags(spark, sf_dir):
    """Each encounter's drugs, how many of them the kidneys clear, and whether its patient has a drug allergy, or one that threatens life."""
    p = F.col("patient_id")
    allergic, grave = predicates.drug_allergy(fx.pick(_KINDS, p)), predicates.life_threatening(fx.pick(_SEVERITIES, F.floor(p / 3)))
    return fx.medications(spark, sf_dir).groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("drugs"), F.count_if(predicates.renally_cleared(F.col("drug"))).alias("renally_cleared"), F.bool_or(allergic).alias("drug_allergy"), F.bool_or(allergic & grave).alias("grave_drug_allergy")
    )


_NOW = f"TIMESTAMP '{AS_OF}'"
_LISTS = {
    "active_encounters": "SELECT encounter_id AS k, admission::TIMESTAMP AS t FROM encounters WHERE discharge > DATE '1998-06-01' AND admission <= DATE '1998-06-01'",
    "unvalidated_predictions": f"""SELECT feedback_id, "at" FROM feedback WHERE NOT treating AND "at" < {_NOW} - INTERVAL 48 HOUR""", "training_feedback": """SELECT feedback_id, "at" FROM feedback WHERE in_distribution AND signal IS NOT NULL""",
    "unlinked_feedback": f"""SELECT feedback_id, "at" FROM feedback WHERE NOT outcome_linked AND "at" < {_NOW} - INTERVAL 720 HOUR""",
    "phi_accesses": """SELECT resource_id, "at" FROM audit_burst WHERE phi""", "denied_accesses": """SELECT resource_id, "at" FROM audit_burst WHERE outcome = 'denied'""",
    "pending_reviews": "SELECT patient_id, dob::TIMESTAMP FROM patients WHERE patient_id % 5 = 0", "anomalies": "SELECT seq, time FROM vitals WHERE (parameter = 'heart_rate' AND value > 120) OR (parameter = 'spo2_pulse_ox' AND value < 90)",
    "available_beds": "SELECT patient_id, dob::TIMESTAMP FROM patients WHERE nation % 4 = 0", "active_medications": "SELECT encounter_id, NULL::TIMESTAMP FROM medications WHERE gfr > 30", "coded_medications": "SELECT encounter_id, NULL::TIMESTAMP FROM medications WHERE drug NOT LIKE '%mg'",
}


@query("l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS list, x.* FROM ({v}) x" for k, v in _LISTS.items()) + """)
    SELECT list, k AS id, count(*) AS entries, min(t) AS oldest FROM l GROUP BY ALL""", "encounters feedback audit_burst patients vitals medications")
def work_lists(spark, sf_dir):
    """All that is open, by list and id, with the oldest entry of each."""
    now, day, c = F.lit(AS_OF).cast("timestamp_ntz"), F.lit("1998-06-01").cast("date"), F.col
    fb, pt, md = fx.feedback(spark, sf_dir), fx.patients(spark, sf_dir), fx.medications(spark, sf_dir)
    accesses = fx.audit_burst(spark, sf_dir)
    anomaly = ((c("parameter") == "heart_rate") & (c("value") > 120)) | ((c("parameter") == "spo2_pulse_ox") & (c("value") < 90))
    stay = F.when((c("discharge") > day) & (c("admission") <= day), "active").otherwise("closed")
    none = F.lit(None).cast("timestamp_ntz")
    tables = {
        "active_encounters": (fx.encounters(spark, sf_dir).withColumn("status", stay), c("encounter_id"), c("admission").cast("timestamp_ntz")),
        "unvalidated_predictions": (fb.withColumns({"predicted_at": c("at"), "outcome_occurred": F.when(c("treating"), c("occurred"))}), c("feedback_id"), c("at")),
        "training_feedback": (fb.withColumn("valid_for_training", c("in_distribution") & c("signal").isNotNull()), c("feedback_id"), c("at")), "unlinked_feedback": (fb, c("feedback_id"), c("at")),
        "phi_accesses": (accesses, c("resource_id"), c("at")), "denied_accesses": (accesses, c("resource_id"), c("at")),
        "pending_reviews": (pt.withColumn("status", F.when(c("patient_id") % 5 == 0, "pending").otherwise("done")), c("patient_id"), c("dob").cast("timestamp_ntz")),
        "anomalies": (fx.vitals(spark, sf_dir).withColumn("is_anomaly", anomaly), c("seq"), c("time")),
        "available_beds": (pt.withColumn("status", F.when(c("nation") % 4 == 0, "available").otherwise("occupied")), c("patient_id"), c("dob").cast("timestamp_ntz")),
        "active_medications": (md.withColumn("status", F.when(c("gfr") > 30, "active").otherwise("stopped")), c("encounter_id"), none),
        "coded_medications": (md.withColumn("rxnorm", F.when(~c("drug").endswith("mg"), c("drug"))), c("encounter_id"), none),
    }
    out = None
    for name, (rows, key, at) in tables.items():
        one = predicates.work_list(name, rows, now).select(F.lit(name).alias("list"), key.cast("long").alias("id"), at.alias("at"))
        out = one if out is None else out.unionByName(one)
    return predicates.by_entry(out, fx.tasks_for(spark, sf_dir, "events", "orders", "customer", "lineitem")).groupBy("list", "id").agg(F.count(F.lit(1)).alias("entries"), F.min("at").alias("oldest"))


# ---- risk in both variants, sessions -------------------------------------------------------------------------------
_OTHER = ["Immunocompromised host", "asthma", "End_stage_renal disease", "active malignancy", "gout"]
_RISKS = f"""{_MODEL}, {_SCORED}, r AS (SELECT patient_id, CASE WHEN patient_id % 9 > 0 THEN news2 END AS news2, sofa + patient_id % 7 AS sofa, deterioration AS d, sepsis AS s, round(0.55 * deterioration + 0.45 * sepsis, 9) AS m,
    [{fx._sql_pick(_OTHER, "patient_id")}, {fx._sql_pick(_OTHER, "patient_id // 5")}] AS co FROM scored JOIN model USING (patient_id)),
    g AS (SELECT *, CASE WHEN coalesce(news2, 0) >= 7 OR m > 0.6 OR sofa >= 8 THEN 'CRITICAL' WHEN coalesce(news2, 0) >= 5 OR d > 0.7 OR s > 0.5 THEN 'HIGH' WHEN news2 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS a,
    CASE WHEN coalesce(news2, 0) >= 7 OR m > 0.6 THEN 'CRITICAL' WHEN coalesce(news2, 0) >= 5 OR d > 0.7 THEN 'HIGH' WHEN news2 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS b FROM r)"""
_NEWS_TEXT = "CASE WHEN news2 >= 7 THEN 'NEWS2=' || news2 || ' (≥7: urgent response)' WHEN news2 >= 5 THEN 'NEWS2=' || news2 || ' (≥5: high alert)' END"


def _percent(p: str) -> str:
    return f"round_even({p} * 100, 0)::INT || '%"


@query(f"""{_RISKS} SELECT patient_id, a AS level_session, concat_ws('; ', {_NEWS_TEXT}, CASE WHEN d > 0.7 THEN 'AI deterioration probability ' || {_percent("d")} in 6h' END, CASE WHEN s > 0.5 THEN 'AI sepsis probability ' || {_percent("s")} in 12h' END,
    CASE WHEN m > 0.4 THEN 'AI mortality probability ' || {_percent("m")} in 24h' END, CASE WHEN sofa >= 6 THEN 'SOFA=' || sofa || ' (organ dysfunction)' END, CASE WHEN regexp_matches(lower(co[1]), 'immuno|end_stage|malig') THEN 'High-risk comorbidity: ' || co[1] END,
    CASE WHEN regexp_matches(lower(co[2]), 'immuno|end_stage|malig') THEN 'High-risk comorbidity: ' || co[2] END) AS factors_session,
    CASE a WHEN 'CRITICAL' THEN 'critical_threshold_met' WHEN 'HIGH' THEN 'high_threshold_met' WHEN 'MEDIUM' THEN 'medium_threshold_met' ELSE 'within_normal_parameters' END AS trigger_session, a IN ('HIGH', 'CRITICAL') AS alert, CASE WHEN a = 'CRITICAL' THEN 5 ELSE 15 END AS minutes,
    CASE WHEN news2 IS NULL THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, b AS level_agent, concat_ws('; ', {_NEWS_TEXT}, CASE WHEN d > 0.7 THEN 'AI deterioration ' || {_percent("d")}/6h' END, CASE WHEN s > 0.5 THEN 'AI sepsis ' || {_percent("s")}/12h' END,
    CASE WHEN sofa >= 6 THEN 'SOFA=' || sofa END) AS factors_agent, CASE WHEN b = 'LOW' THEN 'NONE' ELSE b END AS priority_agent FROM g""", "vitals")
def risk_variants(spark, sf_dir):
    """Risk level, factors and trigger of each patient as the session's agent and as the plain agent give them; every ninth patient has no early-warning score."""
    v, p = fx.vitals(spark, sf_dir), F.col("patient_id")
    rows = vitals.with_scores(vitals.latest_wide(v)).select(p, F.when(p % 9 > 0, F.col("news2")).alias("news2"), (F.col("sofa") + p % 7).alias("sofa"))
    rows = rows.join(vitals.deterioration(v).select("patient_id", "deterioration", "sepsis", F.round("mortality", 9).alias("mortality")), "patient_id")
    rows = rows.withColumn("comorbidities", F.array(fx.pick(_OTHER, p), fx.pick(_OTHER, F.floor(p / 5))))
    a = sessions.assess_risk(rows).withColumns({"level_session": F.col("risk_level"), "factors_session": F.array_join("risk_factors", "; "), "trigger_session": F.col("trigger")})
    a = a.withColumnsRenamed({"alert_required": "alert", "alert_minutes": "minutes", "risk_confidence": "confidence"})
    b = sessions.assess_risk(a, "agent")
    return b.select("patient_id", "level_session", "factors_session", "trigger_session", "alert", "minutes", "confidence", F.col("risk_level").alias("level_agent"), F.array_join("risk_factors", "; ").alias("factors_agent"), F.col("trigger").alias("priority_agent"))


_EVENT = {"signup": "admission", "error": "status_change", "purchase": "medication_order"}
_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


@query(f"""e AS (SELECT user_id AS patient_id, event_id AS k, ts AS t, list_filter([CASE WHEN event_type IN ('signup', 'error') THEN 'triage' END, 'risk', CASE WHEN event_type = 'purchase' THEN 'pharmacist' END, 'coordinator', 'escalation'], lambda x: x IS NOT NULL) AS agents FROM events),
    n AS (SELECT patient_id, k, t, unnest(agents) AS agent, generate_subscripts(agents, 1) - 1 AS pos FROM e),
    m AS (SELECT *, k * 8 + pos AS seq, {fx._sql_pick(_LEVELS, "k // 3 + pos")} AS level, (k % 64 / 64.0)::DOUBLE AS conf FROM n WHERE (k + pos) % 11 <> 0),
    d AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY patient_id ORDER BY t, seq) < INTERVAL 6 HOUR, false) AS goes_on FROM m), s AS (SELECT *, count(*) FILTER (WHERE NOT goes_on) OVER (PARTITION BY patient_id ORDER BY t, seq) AS session FROM d)
    SELECT patient_id, min(t) AS created_at, max(t) AS updated_at, count(*) AS n_messages, arg_max(level, (t, seq)) FILTER (WHERE agent = 'triage') AS triage, arg_max(level, (t, seq)) FILTER (WHERE agent = 'risk') AS risk,
    arg_max(level, (t, seq)) FILTER (WHERE agent = 'coordinator') AS coordinator, arg_max(conf, (t, seq)) FILTER (WHERE agent = 'coordinator') AS confidence, bool_or(agent = 'pharmacist' AND level = 'CRITICAL' AND (k + pos) % 13 <> 0) AS pharmacy_critical,
    coalesce(sum(k % 3) FILTER (WHERE agent = 'escalation'), 0)::BIGINT AS escalations_active, coalesce(arg_max(level, (t, seq)) FILTER (WHERE agent = 'coordinator') IN ('HIGH', 'CRITICAL'), false) AS immediate FROM s GROUP BY patient_id, session""".replace("e AS", "WITH e AS", 1))
def physician_packages(spark, sf_dir):
    """Every event goes to its agents, whose messages make up sessions; one package a session. Six hours without a message end a session here."""
    e, k = fx.table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _EVENT.items() for x in kv]), F.col("event_type")), F.lit("vitals_update"))
    called = e.select(F.col("user_id").alias("patient_id"), k, F.col("ts").alias("at"), F.posexplode(sessions.called_agents(kind, F.col("event_type") == "purchase")).alias("pos", "agent"))
    at = k + F.col("pos")
    status = F.when(at % 11 == 0, "failed").when(at % 13 == 0, "fallback").otherwise("completed")
    messages = called.select(
        "patient_id", "agent", "at", (k * 8 + F.col("pos")).alias("seq"), fx.pick(_LEVELS, F.floor(k / 3) + F.col("pos")).alias("level"), (k % 64 / 64.0).cast("double").alias("confidence"),
        status.alias("status"), F.when(F.col("agent") == "escalation", k % 3).alias("escalations"),
    )
    p = sessions.packages(messages, 6)
    return p.select("patient_id", "created_at", "updated_at", "n_messages", F.col("triage.level").alias("triage"), F.col("risk.level").alias("risk"), F.col("coordinator.level").alias("coordinator"), F.col("coordinator.confidence").alias("confidence"), "pharmacy_critical", "escalations_active", "immediate")


# ---- prompts -------------------------------------------------------------------------------------------------------
_BUDGET = 2_700
_UNITS = {"heart_rate": "bpm", "temperature": "C"}
_DAY = "'%Y-%m-%d'"


def _sql_context() -> str:
    """The sections one after another: what is left before each is a column of its own."""
    lists = {
        "v": ("""'- ' || parameter || ': ' || value::INT || ' ' || CASE parameter WHEN 'heart_rate' THEN 'bpm' WHEN 'temperature' THEN 'C' ELSE '' END || ' at ' || strftime(time, '%Y-%m-%d %H:%M:%S') || CASE WHEN seq % 9 = 0 THEN ' ⚠️ CRITICAL' ELSE '' END
            || CASE WHEN seq % 4 = 0 THEN ' ⬆️ HIGH' ELSE '' END || CASE WHEN seq % 4 = 1 THEN ' ⬇️ LOW' ELSE '' END""", "vitals", "time DESC, seq DESC", 20, 1),
        "d": ("'- ' || drug || ' ' || (gfr::INT) || ' mg ' || CASE WHEN encounter_id % 2 = 0 THEN 'iv' ELSE '' END || ' daily'", "medications", "encounter_id, drug, gfr", None, 1),
        "l": ("""'- ' || icd10 || ': ' || news2 || ' K/uL (Ref: ' || CASE WHEN charlson > 4 THEN 'N/A' ELSE '4-11' END || ')' || CASE WHEN news2 > 6 THEN ' ⚠️ CRITICAL' WHEN news2 > 4 THEN ' * ABNORMAL' ELSE '' END""", "encounters", "admission DESC, encounter_id", None, 1),
        "i": (f"""'- [' || CASE WHEN k % 2 = 0 THEN 'CT' ELSE 'Unknown' END || '] ' || strftime(t, {_DAY}) || ': ' || coalesce(CASE WHEN k % 3 = 0 THEN 'no acute finding' END, CASE WHEN k % 3 = 1 THEN 'infiltrate' END, 'No findings documented') || CASE WHEN k % 5 = 0 THEN ' 🚨 URGENT' ELSE '' END""",
            "(SELECT user_id AS patient_id, event_id AS k, ts AS t FROM events WHERE event_type IN ('view', 'click'))", "t, k", None, 1),
        "n": ("'[progress — ]: ' || text", "(SELECT document_id, 1 + document_id % (SELECT count(*) FROM customer) AS patient_id, text FROM notes)", "document_id", 5, 2),
        "h": (f"'- [' || strftime(discharge, {_DAY}) || '] ' || disposition || ' after ' || drg", "encounters", "discharge DESC, encounter_id", None, 1),
    }
    ctes = []
    for a, (line, table, order, most, gap) in lists.items():
        ctes.append(f"{a}0 AS (SELECT patient_id, {line} AS line, row_number() OVER (PARTITION BY patient_id ORDER BY {order}) AS n FROM {table})")
        between = " || ".join(["chr(10)"] * gap)
        if a != "h":
            whole = f"{a}1 AS (SELECT * FROM {a}0{f' WHERE n <= {most}' if most else ''}), {a}2 AS (SELECT *, sum(length(line) + {gap}) OVER (PARTITION BY patient_id ORDER BY n) - length(line) - {gap} AS starts FROM {a}1)"
            ctes.append(f"{whole}, {a} AS (SELECT patient_id, string_agg(line, {between} ORDER BY n) FILTER (WHERE starts <= {4 * _BUDGET}) AS {a}, (sum(length(line) + {gap}) - {gap})::BIGINT // 4 AS {a}k FROM {a}2 GROUP BY patient_id)")
    ctes.append("h1 AS (SELECT *, sum(length(line) // 4) OVER (PARTITION BY patient_id ORDER BY n) AS upto FROM h0)")
    default = {"v": "No recent vitals available.", "d": "No active medications on record.", "l": "No recent laboratory results."}
    some = ", ".join(f"coalesce({a}, '{t}') AS {a}t, coalesce({a}k, {len(t) // 4}) AS {a}k" for a, t in default.items())
    ctes.append(f"p AS (SELECT c_custkey AS patient_id, {some}, i, ik, n AS nt, nk FROM customer LEFT JOIN v ON v.patient_id = c_custkey LEFT JOIN d ON d.patient_id = c_custkey LEFT JOIN l ON l.patient_id = c_custkey LEFT JOIN i ON i.patient_id = c_custkey LEFT JOIN n ON n.patient_id = c_custkey)")
    before, left = "p", f"{_BUDGET}"
    for j, a in enumerate("vdl"):
        ctes.append(f"s{j} AS (SELECT *, {left} AS r{j}, {left} - CASE WHEN {a}k < {left} THEN {a}k ELSE 0 END AS x{j} FROM {before})")
        before, left = f"s{j}", f"x{j}"
    ctes.append("s3 AS (SELECT *, x2 AS r3, x2 - CASE WHEN i IS NOT NULL AND x2 > 2000 THEN ik ELSE 0 END AS x3 FROM s2), s4 AS (SELECT *, x3 AS r4, x3 - CASE WHEN nt IS NOT NULL AND x3 > 2000 THEN nk ELSE 0 END AS x4 FROM s3)")
    ctes.append("hh AS (SELECT s4.patient_id, count(*) AS some, coalesce(string_agg(line, chr(10) ORDER BY h1.n) FILTER (WHERE upto <= x4), 'No relevant history retrieved.') AS ht FROM s4 JOIN h1 USING (patient_id) WHERE x4 > 1000 GROUP BY s4.patient_id)")
    head = lambda title, text: f"'### {title}' || chr(10) || {text}"
    return ", ".join(ctes) + f""" SELECT patient_id, concat_ws(chr(10) || chr(10), CASE WHEN vk < r0 THEN {head("CURRENT VITALS (Last 2 Hours)", "vt")} END, CASE WHEN dk < r1 THEN {head("ACTIVE MEDICATIONS + PROBLEMS", "dt")} END,
        CASE WHEN lk < r2 THEN {head("RECENT LABORATORY RESULTS (24h)", "lt")} END, CASE WHEN i IS NOT NULL AND r3 > 2000 THEN {head("IMAGING FINDINGS", "i")} END, CASE WHEN nt IS NOT NULL AND r4 > 2000 THEN {head("CLINICAL NLP SUMMARY", "nt")} END,
        {head("RELEVANT PATIENT HISTORY", "ht")}) AS context, ({_BUDGET} - x4 + coalesce(length(ht) // 4, 0))::BIGINT AS tokens FROM s4 LEFT JOIN hh USING (patient_id)"""


@query(_sql_context(), "vitals medications encounters notes")
def patient_contexts(spark, sf_dir):
    """The whole context of each patient: readings, drugs, values, images, notes and past stays, within a budget small enough to leave some out."""
    c, k = F.col, F.col("event_id")
    customers = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("patient_id"))
    n = customers.count()
    text = lambda x: x.cast("string")
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv]), c("parameter"))
    v = fx.vitals(spark, sf_dir).select(
        "patient_id", "seq", c("time").alias("t"), "parameter", F.rint("value").cast("int").alias("value"), unit.alias("unit"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        (c("seq") % 9 == 0).alias("critical"), (c("seq") % 4 == 0).alias("high"), (c("seq") % 4 == 1).alias("low"),
    )
    m = fx.medications(spark, sf_dir).select("patient_id", "encounter_id", "gfr", c("drug").alias("name"), F.concat(text(F.rint("gfr").cast("int")), F.lit(" mg")).alias("dose"), F.when(c("encounter_id") % 2 == 0, "iv").alias("route"), F.lit("daily").alias("frequency"))
    e = fx.encounters(spark, sf_dir)
    labs = e.select("patient_id", "encounter_id", "admission", c("icd10").alias("test"), c("news2").alias("value"), F.lit("K/uL").alias("unit"), F.when(c("charlson") <= 4, "4-11").alias("reference"), (c("news2") > 6).alias("critical"), (c("news2") > 4).alias("abnormal"))
    images = fx.table(spark, sf_dir, "events").filter(c("event_type").isin("view", "click")).select(
        c("user_id").alias("patient_id"), k, "ts", F.when(k % 2 == 0, "CT").alias("modality"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(k % 3 == 0, "no acute finding").alias("summary"), F.when(k % 3 == 1, "infiltrate").alias("finding"), (k % 5 == 0).alias("urgent"),
    )
    notes = fx.notes(spark, sf_dir).select((1 + c("document_id") % n).alias("patient_id"), "document_id", F.lit("progress").alias("kind"), F.lit(None).cast("string").alias("date"), c("text").alias("summary"))
    past = e.select("patient_id", "encounter_id", "discharge", F.date_format("discharge", "yyyy-MM-dd").alias("date"), F.concat("disposition", F.lit(" after "), "drg").alias("description"))
    return prompts.contexts(customers, {
        "vitals": (v, [F.desc("t"), F.desc("seq")]), "medications": (m, [c("encounter_id"), c("name"), c("gfr")]), "labs": (labs, [F.desc("admission"), c("encounter_id")]),
        "imaging": (images, [c("ts"), c("event_id")]), "notes": (notes, [c("document_id")]), "history": (past, [F.desc("discharge"), c("encounter_id")]),
    }, _BUDGET)
