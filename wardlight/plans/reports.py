"""Named queries over reports, fused findings, whole notes and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import rules, scores
from wardlight.operators import agents, business, fusion, monitoring, notes, rollups, vitals
from wardlight.plans import catalog
from wardlight.plans.catalog import _FINDINGS, _MODEL, _SCORED, _WIDE, MENTIONS, _case, _findings, _r, query
from wardlight.sources import fixtures as fx
from wardlight.streaming import stateful
from wardlight.streaming import vitals as stream

# ---- roll-ups --------------------------------------------------------------------------------------------------
_AGENTS = ["triage", "risk", "diagnosis", "pharmacist"]


@query(f"""WITH r AS (SELECT {fx._sql_pick(_AGENTS, "event_id")} AS agent, (value * 100)::DOUBLE AS ms, event_id % 13 = 0 AS failed FROM events), l AS (SELECT agent, list_sort(list(ms)) AS v, count(*) AS runs, count(*) FILTER (WHERE failed) AS failures, round(avg(ms), 4) AS avg_ms, count(*) FILTER (WHERE ms > 10000) AS breaches FROM r GROUP BY agent)
    SELECT agent, runs, failures, avg_ms, breaches, v[least(floor(runs * 0.95), runs - 1)::INT + 1] AS p95 FROM l""")
def agent_metrics(spark, sf_dir):
    k = F.col("event_id")
    runs = fx.table(spark, sf_dir, "events").select(fx.pick(_AGENTS, k).alias("agent"), (F.col("value") * 100).cast("double").alias("ms"), (k % 13 == 0).alias("failed"))
    return rollups.agent_metrics(runs).select("agent", "runs", "failures", "breaches", "p95", *_r("avg_ms", d=4))


@query("""m AS (SELECT encounter_id, unnest(list_filter(['VTE-1', 'VTE-2', CASE WHEN starts_with(icd10, 'I21') OR starts_with(icd10, 'I22') THEN 'AMI-1' END, CASE WHEN starts_with(icd10, 'J18') THEN 'PN-6' END, CASE WHEN starts_with(icd10, 'A41') THEN 'SEP-1' END], lambda x: x IS NOT NULL)) AS measure FROM encounters)
    SELECT measure, count(*) AS stays, CASE WHEN starts_with(measure, 'VTE') THEN count(*) ELSE 0 END AS known, CASE WHEN starts_with(measure, 'VTE') THEN count(*) FILTER (WHERE encounter_id % 3 <> 1) ELSE 0 END AS met,
    CASE WHEN starts_with(measure, 'VTE') THEN round(count(*) FILTER (WHERE encounter_id % 3 <> 1) / count(*), 6) END AS rate FROM m GROUP BY measure""", "encounters")
def compliance_rates(spark, sf_dir):
    orders = fx.pick(["heparin 5000", "none", "enoxaparin"], F.col("encounter_id"))
    m = business.core_measures(fx.encounters(spark, sf_dir), orders, F.lit("1998-06-01").cast("timestamp"))
    return rollups.compliance_rates(m).select("measure", "stays", "known", "met", *_r("rate"))


@query("""SELECT c_nationkey AS ward, count(*) AS stays, count(*) FILTER (WHERE datediff('day', DATE '1998-06-01', discharge) <= 1) AS within_1d, count(*) FILTER (WHERE datediff('day', DATE '1998-06-01', discharge) <= 3) AS within_3d
    FROM encounters JOIN customer ON patient_id = c_custkey WHERE admission <= DATE '1998-06-01' AND discharge > DATE '1998-06-01' GROUP BY ALL""", "encounters")
def discharge_forecast(spark, sf_dir):
    day = F.lit("1998-06-01").cast("date")
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("ward"))
    stays = fx.encounters(spark, sf_dir).filter((F.col("admission") <= day) & (F.col("discharge") > day)).join(c, "patient_id")
    return rollups.discharge_forecast(stays, "ward", F.datediff("discharge", day), [1, 3])


def _sql_of(name: str) -> str:
    return f"({catalog.ORACLES[name]})"


@query(f"""SELECT round(sum(readmission_savings), 2) AS readmission_savings, round(sum(los_opportunity), 1) AS los_opportunity, (SELECT count(*) FILTER (WHERE surge) FROM {_sql_of("bed_snapshot")}) AS surge_units,
    (SELECT round(avg(occupancy), 5) FROM {_sql_of("bed_snapshot")}) AS mean_occupancy, (SELECT count(*) FILTER (WHERE "over") FROM {_sql_of("hrrp_report")}) AS conditions_over FROM {_sql_of("financial_monthly")}""")
def executive_summary(spark, sf_dir):
    s = rollups.executive_summary(catalog.financial_monthly(spark, sf_dir), catalog.bed_snapshot(spark, sf_dir), catalog.hrrp_report(spark, sf_dir))
    return s.select(F.round("readmission_savings", 2).alias("readmission_savings"), F.round("los_opportunity", 1).alias("los_opportunity"), "surge_units", F.round("mean_occupancy", 5).alias("mean_occupancy"), "conditions_over")


@query(f"""SELECT patient_id % 4 AS ward, count(*) AS patients, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_level = 'LOW') AS low FROM {_sql_of("ward_board")} GROUP BY 1""")
def ward_counts(spark, sf_dir):
    return rollups.ward_counts(catalog.ward_board(spark, sf_dir), F.col("patient_id") % 4)


@query("SELECT 'events' AS name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def dataset_summary(spark, sf_dir):
    return rollups.dataset_summary(**{n: fx.table(spark, sf_dir, n) for n in ("events", "orders", "customer")})


_LIMITS = rules.ARTIFACT_LIMITS["stream"]
_BRIDGE = f"""b AS (SELECT seq, 'dev' || (seq % 40) AS device_id, parameter, CASE WHEN seq % 19 = 0 THEN NULL WHEN seq % 23 = 0 THEN 999 ELSE value END AS value FROM vitals),
k AS (SELECT *, CASE WHEN (seq % 40) % 8 = 0 THEN 'unknown-' || substr(sha256(device_id), 1, 16) ELSE (seq % 40 + 100)::VARCHAR END AS key, value IS NULL OR NOT CASE {" ".join(f"WHEN parameter = '{p}' THEN value BETWEEN {a} AND {b}" for p, (a, b) in _LIMITS.items())} ELSE true END AS artifact FROM b)"""


def _bridged(spark, sf_dir):
    k = F.col("seq")
    v = fx.vitals(spark, sf_dir).select(k, F.concat(F.lit("dev"), k % 40).alias("device_id"), "parameter", F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, 999.0).otherwise(F.col("value")).alias("value"))
    registry = spark.range(40).filter("id % 8 > 0").select(F.concat(F.lit("dev"), "id").alias("device_id"), (F.col("id") + 100).alias("patient_id"))
    return rollups.bridge(v, registry, _LIMITS)


@query(f"{_BRIDGE} SELECT seq, key, artifact, 'icu.vitals.raw' AS topic FROM k", "vitals")
def device_bridge(spark, sf_dir):
    return _bridged(spark, sf_dir).select("seq", "key", "artifact", "topic")


@query(f"{_BRIDGE} SELECT count(*) AS received, count(*) FILTER (WHERE NOT artifact) AS forwarded, count(*) FILTER (WHERE artifact AND value IS NOT NULL) AS artifacts, count(*) FILTER (WHERE value IS NULL) AS errors FROM k", "vitals")
def bridge_counters(spark, sf_dir):
    return rollups.bridge_counters(_bridged(spark, sf_dir))


@query()
def monte_carlo(spark, sf_dir):
    """Mean and deviation of the deterioration risk over 20 noisy passes."""
    d = vitals.deterioration(fx.vitals(spark, sf_dir))
    return rollups.pass_statistics(d, "patient_id", F.col("deterioration")).select("patient_id", "passes", *_r("mean", "sd"))


@query(f"""l AS (SELECT * FROM {_sql_of("outcome_link")}) SELECT output_type, count(*) AS n, count(*) FILTER (WHERE correct) AS "right", round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy FROM l GROUP BY output_type""".replace("l AS", "WITH l AS", 1))
def validated_accuracy(spark, sf_dir):
    return monitoring.validated_accuracy(catalog.outcome_link(spark, sf_dir), ["output_type"]).select("output_type", "n", "right", *_r("accuracy"))


@query("SELECT seq, parameter, value FROM vitals WHERE seq % 7 > 1 AND seq % 11 > 0", "vitals")
def valid_inputs(spark, sf_dir):
    """All readings as callers send them, some without a number and some of unknown parameters: the valid ones."""
    k, value = F.col("seq"), F.col("value")
    sent = F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, F.when(k % 2 == 0, float("inf"))).otherwise(value)
    return vitals.valid_inputs(fx.vitals(spark, sf_dir).select(k, F.when(k % 11 == 0, "mood").otherwise(F.col("parameter")).alias("parameter"), sent.alias("value")))


_API = " OR ".join(f"(parameter = '{p}' AND value BETWEEN {a} AND {b})" for p, (a, b) in rules.ARTIFACT_LIMITS["api"].items())


@query(f"SELECT seq, parameter, value FROM (SELECT seq, CASE WHEN seq % 6 = 0 THEN 'bp_mean' ELSE parameter END AS parameter, CASE WHEN seq % 5 = 0 THEN value * 2 WHEN seq % 11 = 0 THEN 0 ELSE value END AS value FROM vitals) WHERE parameter = 'bp_mean' OR {_API}", "vitals")
def artifact_filter_api(spark, sf_dir):
    """The limits of single readings; a parameter without limits stays whatever its value."""
    k = F.col("seq")
    v = fx.vitals(spark, sf_dir).withColumn("parameter", F.when(k % 6 == 0, "bp_mean").otherwise(F.col("parameter"))).withColumn("value", F.when(k % 5 == 0, F.col("value") * 2).when(k % 11 == 0, 0.0).otherwise(F.col("value")))
    return vitals.artifact_filter(v, "api").select("seq", "parameter", "value")


# ---- findings --------------------------------------------------------------------------------------------------
_IMAGES = [*fusion.IMAGE_FINDINGS, "shadow"]


@query(f"""WITH i AS (SELECT user_id AS patient_id, event_id AS k, {fx._sql_pick(_IMAGES, "event_id")} AS kind, ((event_id % 64) / 64.0)::DOUBLE AS c, ((event_id % 32) / 32.0)::DOUBLE AS q FROM events)
    SELECT patient_id, {_case({k: f"'{v[1]}'" for k, v in fusion.IMAGE_FINDINGS.items()}, "kind")} AS icd10, kind IN ('pneumothorax', 'mediastinal_widening', 'pneumomediastinum') AND c > 0.6 AS urgent, round(CASE WHEN q < 0.6 THEN least(0.99, 0.15 + (1 - q) * 0.3) ELSE 0.15 END, 9)::DOUBLE AS uncertainty,
    kind, '[left] ' || kind AS description, {_case({k: f"'{v[0]}'" for k, v in fusion.IMAGE_FINDINGS.items()}, "kind", "'incidental'")} AS severity, round(CASE WHEN q < 0.6 THEN c * q ELSE c END, 9)::DOUBLE AS confidence FROM i""")
def image_findings(spark, sf_dir):
    k = F.col("event_id")
    images = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("patient_id"), fx.pick(_IMAGES, k).alias("finding"), F.lit("left").alias("region"), ((k % 64) / 64.0).alias("confidence"), F.lit(0.15).alias("uncertainty"), ((k % 32) / 32.0).alias("quality"))
    f = fusion.image_findings(images)
    return f.select("patient_id", "icd10", "urgent", "kind", "description", "severity", *_r("uncertainty", "confidence", d=9))


@query("""WITH r AS (SELECT event_id AS patient_id, (event_id % 100) / 100.0::DOUBLE AS d, (event_id % 50) / 50.0::DOUBLE AS s FROM events)
    SELECT patient_id, 'deterioration_risk' AS kind, CASE WHEN d > 0.7 THEN 'critical' ELSE 'moderate' END AS severity, 'deterioration probability ' || floor(d * 100 + 0.5)::INT || '% in 6 hours' AS description FROM r WHERE d > 0.5
    UNION ALL SELECT patient_id, 'sepsis_risk', CASE WHEN s > 0.6 THEN 'critical' ELSE 'severe' END, 'sepsis probability ' || floor(s * 100 + 0.5)::INT || '% in 12 hours' FROM r WHERE s > 0.4""")
def vitals_findings(spark, sf_dir):
    k = F.col("event_id")
    scored = fx.table(spark, sf_dir, "events").select(k.alias("patient_id"), (k % 100 / 100.0).alias("deterioration"), (k % 50 / 50.0).alias("sepsis"))
    return fusion.vitals_findings(scored).select("patient_id", "kind", "severity", "description")


@query("""SELECT event_id % 500 AS patient_id, 'Critical lab: wbc=' || (event_id % 30) || ' K/uL' AS description FROM events WHERE event_id % 5 = 0 OR event_id % 4 IN (0, 1)""")
def lab_findings(spark, sf_dir):
    k = F.col("event_id")
    labs = fx.table(spark, sf_dir, "events").select((k % 500).alias("patient_id"), F.lit("wbc").alias("test"), (k % 30).alias("value"), F.lit("K/uL").alias("unit"), fx.pick(["HH", "LL", "H", None], k).alias("flag"), (k % 5 == 0).alias("is_critical"))
    return fusion.lab_findings(labs).select("patient_id", "description")


@query(f"""{_FINDINGS}, fr AS (SELECT * FROM {_sql_of("fusion_risk")}), dc AS (SELECT patient_id, count(*) AS discordances FROM {_sql_of("discordance")} GROUP BY patient_id),
    m AS (SELECT patient_id, array_to_string(list_filter(['imaging', 'labs', 'nlp', 'vitals'], lambda x: NOT list_contains(list(DISTINCT source), x)), ',') AS missing FROM f GROUP BY patient_id)
    SELECT patient_id, CASE WHEN coalesce(discordances, 0) > 0 AND level NOT IN ('HIGH', 'CRITICAL') THEN 'HIGH' ELSE level END AS level, coalesce(discordances, 0) AS discordances, coalesce(discordances, 0) > 0 OR level IN ('HIGH', 'CRITICAL') AS review, missing, modalities
    FROM fr LEFT JOIN dc USING (patient_id) JOIN m USING (patient_id)""")
def fused(spark, sf_dir):
    return fusion.fuse(_findings(spark, sf_dir)).select("patient_id", "level", "discordances", "review", F.array_join("missing_modalities", ",").alias("missing"), "modalities")


# ---- scores ----------------------------------------------------------------------------------------------------
_N2Z = " + ".join(scores.banded_sql(f"nullif({p}, 0)", b) for p, b in rules.NEWS2.items())


@query(f"{_WIDE.format('vitals')} SELECT patient_id, {_N2Z} AS news2_zero FROM wide", "vitals")
def news2_zero(spark, sf_dir):
    """The score where zero stands for a missing vital."""
    wide = vitals.latest_wide(fx.vitals(spark, sf_dir))
    return wide.select("patient_id", scores.news2({p: F.nullif(F.col(p), F.lit(0.0)) for p in rules.NEWS2}).alias("news2_zero"))


_S98 = "CASE WHEN coalesce(spo2_pulse_ox, 98) < 90 THEN 3 WHEN coalesce(spo2_pulse_ox, 98) < 93 THEN 2 WHEN coalesce(spo2_pulse_ox, 98) < 96 THEN 1 ELSE 0 END"


@query(f"""{_WIDE.format('vitals')} SELECT patient_id, {_S98} + CASE WHEN bp_systolic < 90 THEN 2 ELSE 0 END + CASE WHEN 10 + patient_id % 90 < 15 THEN 4 WHEN 10 + patient_id % 90 < 30 THEN 3 WHEN 10 + patient_id % 90 < 60 THEN 2 WHEN 10 + patient_id % 90 < 90 THEN 1 ELSE 0 END AS renal FROM wide""", "vitals")
def sofa_renal(spark, sf_dir):
    wide = vitals.latest_wide(fx.vitals(spark, sf_dir))
    return wide.select("patient_id", scores.sofa({p: F.col(p) for p in ("spo2_pulse_ox", "bp_systolic")}, 10 + F.col("patient_id") % 90).alias("renal"))


@query(f"""{_MODEL}, {_SCORED} SELECT patient_id, concat_ws('; ', CASE WHEN news2 >= 5 THEN 'NEWS2 ' || news2 END, CASE WHEN sofa >= 4 THEN 'SOFA ' || sofa END, CASE WHEN deterioration > 0.7 THEN 'deterioration' END, CASE WHEN sepsis > 0.5 THEN 'sepsis' END) AS factors FROM scored JOIN model USING (patient_id)""", "vitals")
def risk_factors(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    rows = vitals.with_scores(vitals.latest_wide(v)).select("patient_id", "news2", "sofa").join(vitals.deterioration(v).select("patient_id", "deterioration", "sepsis"), "patient_id")
    return rows.select("patient_id", F.array_join(agents.risk_factors(), "; ").alias("factors"))


@query(f"""SELECT a.patient_id, priority, alerts, s.news2, s.mews, s.sofa, deterioration, sepsis, mortality, coalesce(t.trend, 'stable') AS trend, coalesce(o.anomalies, '') AS anomalies, true AS uncertain
    FROM {_sql_of("alerts")} a JOIN (WITH {fx.views_of("vitals")}, {_WIDE.format("vitals")}, {_SCORED} SELECT patient_id, news2, mews, sofa FROM scored) s USING (patient_id) JOIN {_sql_of("deterioration_model")} USING (patient_id) LEFT JOIN {_sql_of("trend")} t USING (patient_id)
    LEFT JOIN (SELECT patient_id, string_agg(parameter || ':' || severity, ',' ORDER BY parameter) AS anomalies FROM {_sql_of("anomalies")} GROUP BY patient_id) o USING (patient_id)
    UNION ALL SELECT -1, 'LOW', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', true""")
def analyzed(spark, sf_dir):
    """Each patient and one without readings, analysed in one row; uncertain: the passes differ a little, or nothing is known."""
    v = fx.vitals(spark, sf_dir)
    everyone = v.select("patient_id").distinct().unionByName(spark.createDataFrame([(-1,)], "patient_id long"))
    rows = vitals.analyze(everyone, v)
    return rows.select("patient_id", "priority", "alerts", "news2", "mews", "sofa", *_r("deterioration", "sepsis", "mortality"), "trend", F.array_join("anomalies", ",").alias("anomalies"), ((F.col("uncertainty") == 1) | F.col("uncertainty").between(0.001, 0.01) | F.col("deterioration").isin(0.01, 0.99)).alias("uncertain"))


# ---- notes -----------------------------------------------------------------------------------------------------
_ACTIVE = "(SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start) AS n FROM mentioned WHERE NOT negated AND temporal = 'current')"


@query(f"""{MENTIONS}, d AS (SELECT document_id, string_agg(substr(text, start + 1, "end" - start), ', ' ORDER BY n) FILTER (WHERE n <= 3) AS d, count(*) AS n_active FROM {_ACTIVE} JOIN notes USING (document_id) GROUP BY document_id),
    e AS (SELECT document_id, count(*) AS n_entities FROM mentioned GROUP BY document_id), l AS (SELECT document_id, count(*) AS n_labs FROM {_sql_of("note_labs")} GROUP BY document_id)
    SELECT document_id, sha256(substr(text, 1, 1000)) AS semantic_hash, note_class, sentiment, coalesce('Active diagnoses: ' || d || '.', 'No significant entities extracted.') AS summary, coalesce(n_entities, 0)::INT AS n_entities, coalesce(n_active, 0)::INT AS n_active, coalesce(n_labs, 0)::INT AS n_labs
    FROM notes JOIN {_sql_of("note_class")} USING (document_id) JOIN (SELECT document_id, sentiment FROM {_sql_of("note_sentiment")}) USING (document_id) LEFT JOIN d USING (document_id) LEFT JOIN e USING (document_id) LEFT JOIN l USING (document_id)""", "notes")
def note_records(spark, sf_dir):
    """Each note with its class, mood, the first diagnoses that hold now, how many entities and labs it names, and the hash of its first thousand characters."""
    rows = notes.process(fx.notes(spark, sf_dir))
    now = F.filter("entities", lambda e: ~e["negated"] & (e["temporal"] == "current"))
    return rows.select("document_id", "semantic_hash", "note_class", "sentiment", "summary", *[F.when(c.isNull(), 0).otherwise(F.size(c)).alias(k) for k, c in (("n_entities", F.col("entities")), ("n_active", now), ("n_labs", F.col("labs")))])


# ---- streams ---------------------------------------------------------------------------------------------------
_CUTS = ["2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00"]


@query(f"""d AS (SELECT *, time >= TIMESTAMP '{_CUTS[-1]}' AS last FROM vitals), w AS (SELECT max(time) - INTERVAL 1 HOUR AS mark FROM d WHERE time < TIMESTAMP '{_CUTS[-2]}' AND seq % 50 <> 0),
    k AS (SELECT d.* FROM d, w WHERE last OR seq % 50 <> 0 OR date_trunc('hour', time) + INTERVAL 1 HOUR > mark)
    SELECT patient_id, parameter, date_trunc('hour', time)::TIMESTAMP AS hour, count(*) AS n, min(value) AS min, max(value) AS max, round(sum(value) / count(*), 6) AS mean FROM k GROUP BY ALL""", "vitals")
def stream_vitals_late(spark, sf_dir):
    """The hourly rollup over micro-batches in time order: every fiftieth reading comes with the last batch, and those more than
    an hour late are left out. Late rows of a batch are judged by the mark that the batch before it began with."""
    folder = stateful.in_time_order(spark, fx.vitals(spark, sf_dir), _CUTS, "time", late="seq % 50 = 0")
    rows = stateful.run(spark, folder, lambda s: stream.hourly(s, delay="1 hour"), "update")
    keys = ["patient_id", "parameter", "hour"]
    last = rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "min", "max", "mean")])
    return last.select(*keys, "n", "min", "max", *_r("mean"))


@query("""b AS (SELECT actor_id, resource_id AS seq, epoch("at")::BIGINT AS s FROM audit_burst WHERE out_of_department)
    SELECT actor_id, seq, count(*) OVER (PARTITION BY actor_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY actor_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) > 50 AS breach FROM b""", "audit_burst")
def stream_sliding_access(spark, sf_dir):
    """The sliding access count as a stream with exact state."""
    rows = fx.audit_burst(spark, sf_dir).filter("out_of_department").select("actor_id", "at", F.col("resource_id").alias("seq"))
    folder = stateful.in_time_order(spark, rows, ["2024-01-31 22:00:00", "2024-01-31 23:00:00"], "at")
    return stateful.run(spark, folder, stateful.sliding_counts).select("actor_id", "seq", "in_window", "breach")


@query("""t AS (SELECT patient_id, seq, floor(epoch(time))::BIGINT AS s, time FROM vitals), g AS (SELECT *, CASE WHEN s - lag(s) OVER w > 86400 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM t WINDOW w AS (PARTITION BY patient_id ORDER BY time, seq)),
    i AS (SELECT *, sum(first) OVER (PARTITION BY patient_id ORDER BY time, seq) AS session FROM g)
    SELECT patient_id, seq, min(s) OVER (PARTITION BY patient_id, session) AS session_start, row_number() OVER (PARTITION BY patient_id, session ORDER BY time, seq) AS n FROM i""", "vitals")
def stream_sessions(spark, sf_dir):
    """Sessions of each patient that a day without readings ends, as a stream with state and a time to live."""
    folder = stateful.in_time_order(spark, fx.vitals(spark, sf_dir).select("patient_id", "time", "seq"), _CUTS, "time")
    return stateful.run(spark, folder, lambda s: stateful.sessions(s, groups=folder.groups)).select("patient_id", "seq", "session_start", "n")


def agent_calls(spark, sf_dir):
    """Calls of four agents, ten seconds apart."""
    k = F.col("event_id")
    at = F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k * 10)
    return fx.table(spark, sf_dir, "events").select(fx.pick(_AGENTS, k).alias("agent"), at.alias("at"), k.alias("seq"), (k % 7 < 5).alias("failed"))


@query()
def stream_breakers(spark, sf_dir):
    """Calls that an agent's breaker refuses, as a stream with state; its SQL is that of breaker_scan."""
    calls = agent_calls(spark, sf_dir)
    slices = stateful.in_time_order(spark, calls, stateful.even_cuts(calls, "at", ["2024-02-01 01:00:00", "2024-02-01 02:00:00"]), "at")
    return stateful.run(spark, slices, stateful.breakers).select("agent", "seq", "refused", "open")


@query("SELECT event_id, sha256(props) AS digest FROM events WHERE value > 100")
def stream_dead_letters(spark, sf_dir):
    folder = stateful.in_time_order(spark, fx.table(spark, sf_dir, "events"), _CUTS, "ts")
    return stateful.split_dead_letters(spark, folder, "value > 100", "props")[1].select("event_id", "digest")


# ---- smaller ones ----------------------------------------------------------------------------------------------
_ACTIONS = ["accepted", "modified", "rejected", "ordered_different", "ignored"]


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'thumbs_up' ELSE 'thumbs_down' END ELSE {_case({k: f"'{v}'" for k, v in rules.ACTION_SIGNAL.items()}, fx._sql_pick(_ACTIONS, "event_id"), "'rejected'")} END AS signal, NOT (event_id % 6 = 3 AND event_id % 4 <> 1) AS in_distribution FROM events""")
def feedback_signals(spark, sf_dir):
    k = F.col("event_id")
    rows = fx.table(spark, sf_dir, "events").select(k, fx.pick(_ACTIONS, k).alias("action"), F.when(k % 3 == 0, k % 2 == 0).alias("is_positive"), F.when(k % 4 == 1, "late").otherwise("").alias("reason"))
    return monitoring.feedback_signals(rows).select("event_id", "signal", "in_distribution")


@query("SELECT patient_id, parameter, arg_max(value, (time, seq)) AS value, max(time) AS time FROM vitals WHERE time > TIMESTAMP '2024-01-30 00:00:00' AND time <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY ALL", "vitals")
def cached_vitals(spark, sf_dir):
    """Last values that are not older than their time to live of twelve hours."""
    return vitals.latest_within(fx.vitals(spark, sf_dir), ["patient_id", "parameter"], "value", 43_200, "2024-01-30 12:00:00")


_THIRDS = ", ".join(f"arg_max(value, rn) FILTER (WHERE parameter = '{p}' AND part = '{t}') AS {t}_{p}" for t in ("first", "last") for p in rules.NEWS2)
_EARLY, _LATE = (" + ".join(scores.banded_sql(f"{t}_{p}", b) for p, b in rules.NEWS2.items()) for t in ("first", "last"))


@query(f"""r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY patient_id) AS n FROM vitals), t AS (SELECT *, CASE WHEN rn <= n // 3 THEN 'first' WHEN rn > n - n // 3 THEN 'last' END AS part FROM r WHERE n >= 10),
    w AS (SELECT patient_id, {_THIRDS} FROM t GROUP BY patient_id), s AS (SELECT patient_id, {_EARLY} AS e, {_LATE} AS l FROM w) SELECT patient_id, CASE WHEN l - e >= 3 THEN 'worsening' WHEN e - l >= 2 THEN 'improving' ELSE 'stable' END AS trend FROM s""", "vitals")
def trend_input_order(spark, sf_dir):
    return vitals.trend_by_order(fx.vitals(spark, sf_dir), "seq")


@query("SELECT encounter_id, (epoch(discharge::TIMESTAMP) - epoch(admission::TIMESTAMP)) / 86400.0::DOUBLE AS days FROM encounters", "encounters")
def stay_days(spark, sf_dir):
    """Length of every stay out of its timestamps."""
    return business.stay_days(fx.encounters(spark, sf_dir)).select("encounter_id", "days")


@query(f"""{MENTIONS} SELECT document_id, string_agg(DISTINCT condition, ',' ORDER BY condition) AS active FROM mentioned WHERE NOT negated AND temporal = 'current' GROUP BY document_id""", "notes")
def note_active_conditions(spark, sf_dir):
    """Conditions that a note says its patient has now: what is negated, past or of the family does not count."""
    found = notes.active(notes.mentions(fx.notes(spark, sf_dir)))
    return found.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("active"))  # at most ten


@query("""SELECT agent, max(event_id) AS seq FROM (SELECT *, ['triage', 'risk', 'diagnosis', 'pharmacist'][event_id % 4 + 1] AS agent FROM events) GROUP BY agent""")
def last_message(spark, sf_dir):
    """The last element of each agent's append-only list."""
    k = F.col("event_id")
    e = fx.table(spark, sf_dir, "events").select(fx.pick(_AGENTS, k).alias("agent"), k.alias("seq"))
    return e.groupBy("agent").agg(F.max("seq").alias("seq"))
