"""Queries of breakers, retries, streamed baselines, message sources, channels and exactly-once sinks, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wardlight.functions import rules, scores
from wardlight.operators import breakers, business, governance, models, vitals
from wardlight.plans import records, reports
from wardlight.plans.catalog import _BETWEEN, _ENGINE, _INPUTS, _MODEL, _WIDE, MENTIONS, ORACLES, SALT, query
from wardlight.sources import fixtures as fx
from wardlight.sources import folders, hl7, shared, sinks
from wardlight.streaming import baselines, channels, ledger, retries, stateful

# ---- breakers --------------------------------------------------------------------------------------------------
#: One call after the other, by recursion: the failures that count and since when the breaker is open.
_BREAKERS = f"""WITH RECURSIVE calls AS (
    SELECT {fx._sql_pick(reports._AGENTS, 'event_id')} AS agent, event_id AS seq, 1706745600 + 10 * event_id AS sec, event_id % 7 < 5 AS failed, row_number() OVER (PARTITION BY event_id % {len(reports._AGENTS)} ORDER BY event_id) AS i FROM events
), fold AS (
    SELECT DISTINCT agent, 0::BIGINT AS i, NULL::BIGINT AS seq, []::BIGINT[] AS failures, -1::BIGINT AS since, false AS refused FROM calls
    UNION ALL
    SELECT agent, i, seq, now_failed, CASE WHEN shut THEN since WHEN failed AND len(now_failed) >= 3 THEN sec ELSE -1 END, shut FROM (
        SELECT c.agent, c.i, c.seq, c.sec, c.failed, f.since, f.since >= 0 AND c.sec - f.since <= 600 AS shut,
            CASE WHEN f.since >= 0 AND c.sec - f.since <= 600 THEN f.failures WHEN c.failed THEN list_append(list_filter(f.failures, lambda t: t > c.sec - 300), c.sec) ELSE [] END AS now_failed
        FROM fold f JOIN calls c ON c.agent = f.agent AND c.i = f.i + 1)
) SELECT agent, seq, refused, since >= 0 AS open FROM fold WHERE i > 0"""
ORACLES["stream_breakers"] = _BREAKERS


@query(_BREAKERS)
def breaker_scan(spark, sf_dir):
    """The breakers of all agents over their whole histories, by a scan over time slices."""
    return breakers.scan(reports.agent_calls(spark, sf_dir))


# ---- retries ---------------------------------------------------------------------------------------------------
def _attempt(payload: str | None, retry: int) -> str | None:
    """A record of the query says at the end of its payload which retry works (0 to 3), or that none does."""
    return None if payload is not None and retry >= int(payload[-1]) else f"try {retry} failed"


def _records(spark, sf_dir):
    k = F.col("event_id")
    works = F.when(k % 3 == 0, F.lit(0)).otherwise(k % 5)  # 4: never
    return fx.table(spark, sf_dir, "events").select(k.cast("long").alias("record_id"), fx.pick(["hl7", "fhir", "csv"], k).alias("source"), F.col("ts").cast("timestamp_ntz").alias("at"), F.concat("props", F.lit(" "), works.cast("string")).alias("payload"))


_TRIES = """t AS (SELECT event_id AS record_id, ['hl7', 'fhir', 'csv'][1 + event_id % 3] AS source, floor(epoch(ts))::BIGINT AS sec, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS works, props FROM events),
    r AS (SELECT *, n::INT AS retry, sec + [0, 2, 6, 14][n + 1] AS at_sec FROM t, (SELECT unnest(range(4)) AS n) WHERE n <= works)"""


def _tries(spark, sf_dir):
    records = _records(spark, sf_dir)
    cuts = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]
    slices = stateful.in_time_order(spark, records, cuts, "at")
    last = records.agg(F.max("at").alias("at"))  # a tick a minute after the last record: what waits by then comes again
    tick = last.select(F.lit(None).cast("long").alias("record_id"), F.lit("tick").alias("source"), (F.col("at") + F.expr("INTERVAL 60 SECONDS")).alias("at"), F.lit(None).cast("string").alias("payload"))
    slices.frames.append(tick)
    few = str(min(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # 64 buckets need no more
    return stateful.run(spark, slices, lambda s: retries.retried(s, _attempt), end=True, spark__sql__streaming__stateStore__providerClass=retries.ROCKS, spark__sql__shuffle__partitions=few)


@query(f"WITH {_TRIES} SELECT record_id, retry, at_sec AS sec, CASE WHEN works = n THEN 'ok' WHEN n = 3 THEN 'dead' ELSE 'failed' END AS outcome FROM r")
def stream_retries(spark, sf_dir):
    """Every try of every record in a stream: waits of 2, 4 and 8 seconds by timers."""
    return _tries(spark, sf_dir).select("record_id", "retry", "sec", "outcome")


@query(f"WITH {_TRIES} SELECT record_id, source, 'try 3 failed' AS reason, 3::INT AS retry_count, at_sec AS failed_at, sha256(props || ' 4') AS digest FROM r WHERE n = 3 AND works = 4")
def stream_retry_letters(spark, sf_dir):
    """The dead letters of the retried stream."""
    return retries.dead_letters(_tries(spark, sf_dir))


# ---- folders of messages and bundles ---------------------------------------------------------------------------
@query(ORACLES["hl7_observations"])
def hl7_folder(spark, sf_dir):
    """Readings written as HL7 files by sending system, and read back through the data source."""
    work = shared.Workspace(spark, "hl7")
    made = hl7.messages(fx.vitals(spark, sf_dir)).select(F.col("message").alias("value"), F.concat(F.lit("icu"), F.crc32("message") % 3).alias("source"))
    made.write.partitionBy("source").text(work.path("in"))
    obs = hl7.observations(folders.load(spark, "hl7_folder", work.path("in"), columns=["message"], suffix=".txt"))
    return obs.select(F.col("mrn").cast("long").alias("patient_id"), "loinc_display", "value_numeric", "status", "observation_datetime")


@query(f"""WITH o AS (SELECT 'site' || c_custkey % 4 AS source, 'o-' || c_custkey AS resource_id, {records._when} AS date FROM (SELECT *, c_custkey AS k FROM customer) WHERE c_custkey % 13 <> 0 AND c_custkey % 4 < 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY nullif(date, '') DESC NULLS LAST, resource_id)::INT AS position FROM o)
    SELECT source, resource_id, position, false AS failed FROM r WHERE position <= 100 UNION ALL SELECT 'site' || c_custkey % 4, NULL, NULL, true FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 4 < 2""")
def fhir_search(spark, sf_dir):
    """Observations of two sites out of a folder of bundles: the latest hundred of each, and the files that hold none."""
    work = shared.Workspace(spark, "bundles")
    made = records.bundles(spark, sf_dir).select(F.concat(F.lit("site"), F.col("bundle_id") % 4).alias("source"), F.col("bundle").alias("value"))
    made.write.partitionBy("source").text(work.path("in"))
    found = folders.search(folders.load(spark, "fhir_bundles", work.path("in"), suffix=".txt", source=["site0", "site1"], resource_type=["Observation"]), "-date", 100)
    return found.select("source", "resource_id", "position", F.col("error").isNotNull().alias("failed"))


# ---- exactly once ----------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, event_type, value FROM events")
def sink_exactly_once(spark, sf_dir):
    """All events by a stream on a processing-time trigger, stopped half way and started again from its checkpoint."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    work = shared.Workspace(spark, "ledger")
    book = ledger.Ledger(spark, work.path("table"), "events")
    events.repartition(6).write.parquet(work.path("in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(work.path("in"))
    for _ in range(2):
        running = ledger.start(source, book, work.path("state"))
        while not running.exception() and not book.committed():
            running.awaitTermination(1)
        running.processAllAvailable()
        running.stop()
    return book.read(events.schema).select(*events.columns)


# ---- channels, audit loads, data sets --------------------------------------------------------------------------
@query(f"""r AS (SELECT f.seq, alert, patient_id, CASE WHEN patient_id % 11 > 0 THEN patient_id % 4 END AS ward FROM ({ORACLES["critical_flags"]}) f JOIN vitals USING (seq)),
    m AS (SELECT seq, 'ward:' || ward AS channel, 'vitals_update' AS type, NULL AS alert FROM r UNION ALL SELECT seq, 'patient:' || patient_id, 'vital_reading', NULL FROM r UNION ALL SELECT seq, 'alerts:ward:' || ward, 'vital_critical', alert FROM r WHERE alert IS NOT NULL
    UNION ALL SELECT seq, 'alerts:patient:' || patient_id, 'vital_critical', alert FROM r WHERE alert IS NOT NULL) SELECT channel, type, count(*) AS messages, count(alert) AS alerts, max(seq) AS last_seq FROM m WHERE channel IS NOT NULL GROUP BY ALL""", "vitals")
def ward_channels(spark, sf_dir):
    """All readings as messages of their channels, written once each by a stream; every eleventh patient has no ward."""
    work = shared.Workspace(spark, "channels")
    book = ledger.Ledger(spark, work.path("table"), "channels", channels.FOLDERS)
    p = F.col("patient_id")
    readings = vitals.critical_flags(fx.vitals(spark, sf_dir)).select(p, F.when(p % 11 > 0, p % 4).alias("ward"), "parameter", "value", "time", "seq", "alert")
    readings.repartition(6).write.parquet(work.path("in"))
    source = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 3).parquet(work.path("in"))
    sent = channels.messages(source)
    running = ledger.start(sent, book, work.path("state"))
    running.processAllAvailable()
    running.stop()
    got = book.read(sent.schema)
    alert = F.when(F.col("kind") == "alerts", F.get_json_object("payload", "$.alert"))
    return got.groupBy("channel", "type").agg(F.count(F.lit(1)).alias("messages"), F.count(alert).alias("alerts"), F.max("seq").alias("last_seq"))


@query("""SELECT resource_id, actor_id, department, "at"::DATE AS day, outcome FROM audit_burst""", "audit_burst")
def audit_loads(spark, sf_dir):
    """All accesses by three loads that overlap: each access is in the table once."""
    work = shared.Workspace(spark, "audit")
    book = ledger.Ledger(spark, work.path("table"), "audit", ["day"])
    rows = fx.audit_burst(spark, sf_dir).select("resource_id", "actor_id", "department", F.to_date("at").alias("day"), "outcome")
    for i in range(3):
        sinks.append_once(rows.filter(F.col("resource_id") % 3 != i), book, ["resource_id", "day"], "day")
    return book.read(rows.schema).select(*rows.columns)


@query("""b AS (SELECT patient_id, time::DATE AS day, ceil(count(*) / 100.0)::BIGINT AS pages FROM vitals GROUP BY ALL) SELECT 'patients' AS name, count(*) AS rows FROM patients UNION ALL SELECT 'vitals', count(*) FROM vitals
    UNION ALL SELECT 'fhir_bundles', ((SELECT count(*) FROM patients) + sum(pages))::BIGINT FROM b""", "patients vitals")
def json_dataset(spark, sf_dir):
    """Patients, readings and their bundles as JSON files, with the summary that was counted while they were written."""
    work = shared.Workspace(spark, "dataset")
    p, v = fx.patients(spark, sf_dir), fx.vitals(spark, sf_dir)
    return sinks.dataset({"patients": p, "vitals": v, "fhir_bundles": sinks.bundles(p, v)}, work.path("json"))


# ---- baselines in the stream -----------------------------------------------------------------------------------
def _judged(spark, sf_dir):
    readings = vitals.artifact_filter(fx.vitals(spark, sf_dir), "engine")
    slices = stateful.in_time_order(spark, readings.select("patient_id", "parameter", "time", "seq", "value"), reports._CUTS, "time")
    return stateful.run(spark, slices, baselines.judged)


@query(f"SELECT patient_id, parameter, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM vitals WHERE {_ENGINE} GROUP BY ALL", "vitals")
def stream_baseline(spark, sf_dir):
    """The baseline of each patient and parameter that a stream's state ends with; its percentiles are held against exact ones in the tests."""
    return baselines.latest(_judged(spark, sf_dir)).select("patient_id", "parameter", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_PART = " + ".join(f"(time >= TIMESTAMP '{c}')::INT" for c in reports._CUTS)
_OF = lambda i: "CASE parameter " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in rules.POPULATION.items()) + " END"


@query(f"""v AS (SELECT *, {_PART} AS part FROM vitals WHERE {_ENGINE}), b AS (SELECT v.seq, any_value(v.patient_id) AS patient_id, any_value(v.parameter) AS parameter, any_value(v.value) AS value, count(o.value) AS n, avg(o.value) AS mean, stddev_pop(o.value) AS sd
    FROM v LEFT JOIN v o ON o.patient_id = v.patient_id AND o.parameter = v.parameter AND o.part < v.part GROUP BY v.seq),
    z AS (SELECT *, abs(value - CASE WHEN n >= 10 THEN mean ELSE {_OF(0)} END) / CASE WHEN n >= 10 AND sd > 0 THEN sd ELSE {_OF(1)} END AS z FROM b)
    SELECT patient_id, parameter, seq, n AS n_before, round(z, 6) AS z, CASE WHEN z >= 4 THEN 'critical' WHEN z >= 3 THEN 'severe' WHEN z >= 2.5 THEN 'moderate' ELSE 'mild' END AS severity FROM z WHERE z >= 2""", "vitals")
def stream_anomalies(spark, sf_dir):
    """Readings far off the baseline that earlier slices of time gave their patient."""
    return _judged(spark, sf_dir).filter("z >= 2").select("patient_id", "parameter", "seq", "n_before", F.round("z", 6).alias("z"), "severity")


# ---- the gateway as one pass -----------------------------------------------------------------------------------
def _gateway(spark, sf_dir):
    requests, consents = records.gateway_inputs(spark, sf_dir)
    k = F.col("event_id")
    more = fx.table(spark, sf_dir, "events").select(k, (k % 40).alias("actor_id"), (F.lit("2024-01-31").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k * 20)).alias("at"), (k % 3 > 0).alias("out_of_department"))
    patients = fx.patients(spark, sf_dir).select("patient_id", fhir_patient_struct())
    return governance.gateway_run(requests.join(more, "event_id"), consents, patients, SALT, shared.Workspace(spark, "gateway").path("run"), limit=2)


def fhir_patient_struct():
    """A patient record as the normaliser makes it, of the columns of the view."""
    return F.struct(
        F.lit("Patient").alias("resourceType"), F.concat(F.lit("p-"), "patient_id").alias("id"), F.array(F.struct(F.col("mrn").alias("value"))).alias("identifier"), F.lit("unknown").alias("gender"),
        F.date_format("dob", "yyyy-MM-dd").alias("birthDate"), F.array(F.struct(F.lit("MA").alias("state"), F.col("zip").alias("postalCode"))).alias("address"), F.array(F.struct(F.col("last_name").alias("family"))).alias("name"),
    ).alias("patient")


_RUN = ORACLES["gateway_decisions"]
_ROWS = f"""WITH g AS ({_RUN}), r AS (SELECT g.*, e.user_id, event_id % 40 AS actor_id, 20 * event_id AS sec, event_id % 3 > 0 AS away FROM g JOIN events e USING (event_id)),
    b AS (SELECT *, allowed AND away AND count(*) FILTER (WHERE allowed AND away) OVER (PARTITION BY actor_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) > 2 AS breach, allowed AND user_id IN (SELECT c_custkey FROM customer) AS payload FROM r)"""


@query(f"{_ROWS} SELECT event_id, outcome, deidentify, breach, payload, deidentify AND payload AS hidden FROM b")
def gateway_pipeline(spark, sf_dir):
    """Decision, breach flag and payload of every request; hidden: the payload names nobody."""
    run, _ = _gateway(spark, sf_dir)
    hidden = F.coalesce(F.col("payload").contains('"PAT-') & ~F.col("payload").contains('"family"'), F.lit(False))
    return run.select("event_id", "outcome", "deidentify", "breach", F.col("payload").isNotNull().alias("payload"), hidden.alias("hidden"))


@query(f"{_ROWS} SELECT unnest(['requests', 'allowed', 'denied', 'deidentified', 'payloads', 'breaches']) AS metric, unnest([count(*), count(*) FILTER (WHERE allowed), count(*) FILTER (WHERE NOT allowed), count(*) FILTER (WHERE deidentify), count(*) FILTER (WHERE payload), count(*) FILTER (WHERE breach)]) AS n FROM b")
def gateway_counters(spark, sf_dir):
    """What the run of the gateway counted while it wrote."""
    _, counters = _gateway(spark, sf_dir)
    return spark.createDataFrame([(k, int(v)) for k, v in counters.items()], "metric string, n long")


# ---- models in place of rules ----------------------------------------------------------------------------------
class Weighted:
    """A linear model of two features, as one that was trained elsewhere would be handed over."""

    def predict(self, x):
        return (x[:, 0] - 60) / 200 + (100 - x[:, 1]) / 100


@query(f"""{_MODEL}, m AS (SELECT patient_id, greatest(0, least(1, ({_INPUTS["heart_rate"]} - 60) / 200.0 + (100 - {_INPUTS["spo2_pulse_ox"]}) / 100.0)) AS deterioration, model.sepsis FROM wide JOIN model USING (patient_id))
    SELECT patient_id, round(deterioration, 6) AS deterioration, round(sepsis, 6) AS sepsis, round(0.55 * deterioration + 0.45 * sepsis, 6) AS mortality FROM m""", "vitals")
def deterioration_by_model(spark, sf_dir):
    """X4 with a model for deterioration and the rules for sepsis."""
    out = vitals.deterioration(fx.vitals(spark, sf_dir), by={"deterioration": Weighted()})
    return out.select("patient_id", *[F.round(c, 6).alias(c) for c in ("deterioration", "sepsis", "mortality")])


class Marker:
    """An entity model that marks organs, surer than the rules, and the word findings, less sure."""

    WORDS = (("organ", "kidney injury", 0.95), ("symptom", "worsening", 0.70))

    def entities(self, texts):
        return [[(label, m.start(), m.end(), c) for label, w, c in self.WORDS for m in re.finditer(w, t)] for t in texts]


_ORGAN, _SYMPTOM = (f"""SELECT document_id, '{label}' AS label, {c}::DOUBLE AS confidence, len(list_aggregate(parts[1:i], 'string_agg', '{word}'))::INT AS start, {len(word)} AS size FROM (SELECT document_id, string_split(text, '{word}') AS parts, unnest(range(1, len(string_split(text, '{word}')))) AS i FROM notes)""" for label, word, c in Marker.WORDS)


@query(f"""{MENTIONS}, o AS ({_ORGAN}), s AS ({_SYMPTOM}), e AS (SELECT document_id, condition AS label, 0.90::DOUBLE AS confidence, start, "end" - start AS size FROM mentioned m WHERE NOT EXISTS (FROM o WHERE o.document_id = m.document_id AND o.start < m."end" AND m.start < o.start + o.size))
    SELECT document_id, label, confidence, start, (start + size)::INT AS "end" FROM (FROM o UNION ALL FROM e UNION ALL FROM s)""", "notes")
def note_entities(spark, sf_dir):
    """Entities of the rules and of a model: of overlapping ones the surest stays."""
    return models.entities(fx.notes(spark, sf_dir), Marker()).select("document_id", "label", "confidence", "start", "end")


# ---- plans of stays, variants of scores, recent readings -------------------------------------------------------
_LACE = ORACLES["lace_readmission"]


def _plan_sql(*tests: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN {m} END" for t, m in tests) + ")"


_STEPS = [*[("risk = 'HIGH'", records._q(m)) for m in rules.READMISSION_HIGH], *[("risk <> 'LOW'", records._q(m)) for m in rules.READMISSION_RAISED], ("disposition = 'home' AND charlson >= 3", records._q(rules.READMISSION_PLACEMENT)), *[("prior_readmission", records._q(m)) for m in rules.READMISSION_PRIOR]]
_FACTORS = [
    ("prior_readmission", "'Prior readmission within 90 days'"), ("disposition = 'home' AND charlson >= 4", "'Discharge to home with high comorbidity burden'"), ("age >= 75", "'Age ≥ 75'"),
    ("charlson >= 5", "'High comorbidity burden (Charlson=' || charlson || ')'"), ("ed_visits >= 3", "ed_visits || ' ED visits in past 6 months'"),
]


@query(f"SELECT encounter_id, {_plan_sql(*_FACTORS)} AS risk_factors, {_plan_sql(*_STEPS)} AS interventions FROM encounters JOIN (SELECT encounter_id, risk FROM ({_LACE})) USING (encounter_id)", "encounters")
def readmission_plan(spark, sf_dir):
    """Risk factors and interventions of every stay."""
    out = business.readmission_plan(business.lace(fx.encounters(spark, sf_dir)))
    return out.select("encounter_id", F.array_join("risk_factors", "; ").alias("risk_factors"), F.array_join("interventions", "; ").alias("interventions"))


@query(f"SELECT encounter_id, round(probability, 6) AS probability, risk FROM ({_LACE}) WHERE probability >= 0.2")
def readmission_risk_list(spark, sf_dir):
    """Stays at or over a threshold of readmission."""
    return business.risk_list(business.lace(fx.encounters(spark, sf_dir)).withColumn("probability", F.round("probability", 6))).select("encounter_id", "probability", "risk")


_SOCIAL = ["Transport to be arranged", "SNF bed, home not safe", "Family out of town", "Insurance"]


@query(f"""WITH p AS ({ORACLES["los_predict"]}), e AS (SELECT encounter_id, n_pending, n_social FROM encounters), b AS (SELECT *, concat_ws(',', CASE WHEN n_social > 1 THEN 'disposition_placement' END, CASE WHEN n_pending > 0 THEN 'pending_lab_results' END, CASE WHEN n_social > 0 THEN 'transport_needed' END) AS k FROM p JOIN e USING (encounter_id))
    SELECT encounter_id, CASE WHEN n_social > 2 THEN replace(replace('disposition_placement,family_meeting_needed' || CASE WHEN n_pending > 0 THEN ',pending_lab_results' ELSE '' END || ',transport_needed', ',,', ','), ' ', '') ELSE k END AS barriers,
    (n_pending > 0)::INT + (n_social > 1)::INT + (n_social > 0)::INT + (excess > 1)::INT AS steps FROM b""".replace("WITH p", "p", 1), "encounters")
def discharge_plan(spark, sf_dir):
    """Barriers to the discharge of every stay and how many steps they ask for."""
    enc = fx.encounters(spark, sf_dir)
    listed = enc.withColumn("pending", F.array_repeat(F.lit("lab"), F.col("n_pending"))).withColumn("social", F.slice(F.array(*map(F.lit, _SOCIAL)), F.lit(1), F.col("n_social")))
    out = business.discharge_plan(business.predict_los(listed))
    return out.select("encounter_id", F.array_join("barriers", ",").alias("barriers"), F.size("interventions").alias("steps"))


_DRUG = ["aspirin", "Norepinephrine 4mcg", "none", "DOPamine drip"]
_SPO2 = "CASE WHEN coalesce(spo2_pulse_ox, 98) < 90 THEN 3 WHEN coalesce(spo2_pulse_ox, 98) < 93 THEN 2 WHEN coalesce(spo2_pulse_ox, 98) < 96 THEN 1 ELSE 0 END + CASE WHEN patient_id % 4 IN (1, 3) THEN 2 ELSE 0 END"


@query(f"""{_WIDE.format("vitals")} SELECT patient_id, {_SPO2} + CASE WHEN bp_systolic < 90 THEN 2 ELSE 0 END AS systolic, {_SPO2} + CASE WHEN bp_systolic - 40 < 70 THEN 1 ELSE 0 END AS mean FROM wide""", "vitals")
def sofa_vasopressors(spark, sf_dir):
    """The two variants of the agents: with drugs that raise the pressure, by systolic and by mean pressure."""
    wide = vitals.latest_wide(fx.vitals(spark, sf_dir))
    drugs = F.array(fx.pick(_DRUG, F.col("patient_id")))
    v = {"spo2_pulse_ox": F.col("spo2_pulse_ox"), "bp_systolic": F.col("bp_systolic"), "bp_mean": F.col("bp_systolic") - 40}
    return wide.select("patient_id", scores.sofa_agents(v, drugs).alias("systolic"), scores.sofa_agents(v, drugs, by_map=True).alias("mean"))


_NOON = "2024-01-20 12:00:00"


@query(f"SELECT patient_id, parameter, arg_max(value, (time, seq)) AS value FROM vitals WHERE ({_BETWEEN}) AND time > TIMESTAMP '{_NOON}' - INTERVAL 2 HOUR AND time <= TIMESTAMP '{_NOON}' GROUP BY ALL", "vitals")
def recent_clean(spark, sf_dir):
    """What a patient's chart shows at noon: the last clean reading of each parameter in two hours."""
    return vitals.recent_clean(fx.vitals(spark, sf_dir), _NOON).select("patient_id", "parameter", "value")


@query("SELECT seq, abs(value - base) > 0.15 * abs(base) AS is_anomaly FROM (SELECT *, avg(value) OVER (PARTITION BY patient_id, parameter) AS base FROM vitals)", "vitals")
def trend_readings(spark, sf_dir):
    """Readings more than 15 % off their patient's mean."""
    return vitals.trend_readings(fx.vitals(spark, sf_dir)).select("seq", "is_anomaly")


# ---- the month's report ----------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS report_month, count(*) AS stays, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS intervened, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) AS hrrp, avg(1 + o_orderkey % 14) AS los,
    count(*) FILTER (WHERE o_orderkey % 5 = 0) AS flagged, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS acted FROM orders GROUP BY 1), v AS (SELECT *, greatest(0, 7.6::DOUBLE - los) AS shorter FROM m)
    SELECT report_month, (intervened // 5)::BIGINT AS readmissions_prevented, round(hrrp * 2600.0::DOUBLE, 0) AS penalty_avoided, round(shorter, 2) AS los_reduction_days, (3 * acted // 10)::BIGINT AS adverse_events_prevented,
    round(hrrp * 2600.0::DOUBLE + shorter * 3 * 2500 * 30 + 15000 * (3 * acted // 10), 0) AS total_value FROM v""")
def financial_report(spark, sf_dir):
    """What each month of discharges was worth, with its drug-safety part."""
    o, k = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    months = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("report_month")).agg(
        F.count_if(urgent).alias("high_risk_intervened"), F.count_if(urgent & (k % 3 == 0)).alias("hrrp_conditions_intervened"), F.avg((1 + k % 14).cast("double")).alias("avg_los_days"), F.count_if(k % 5 == 0).alias("interactions_flagged"), F.count_if(k % 10 == 0).alias("critical_acted_on"),
    )
    months = months.withColumns({"hospital_id": F.lit("h-1"), "hospital_name": F.lit("General"), "benchmark_los_days": F.lit(7.6), "acceptance_rate": F.lit(0.8)})
    return business.financial_report(months).select("report_month", "readmissions_prevented", "penalty_avoided", "los_reduction_days", "adverse_events_prevented", "total_value")
