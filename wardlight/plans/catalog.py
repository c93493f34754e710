"""Named queries over the fixture views, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import privacy, rules, scores
from wardlight.operators import agents, business, governance, identity, medication, monitoring, notes, vitals
from wardlight.sources import fixtures as fx
from wardlight.sources import hl7
from wardlight.sources.shared import Workspace
from wardlight.streaming import vitals as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SALT = b"wardlight-demo-salt"
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None, views: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.with_views(sql, *views.split()) if views else sql
        return f

    return register


def _r(*cols: str, d: int = 6) -> list:
    return [F.round(c, d).alias(c) for c in cols]


def _case(values: dict, key: str, default: str = "NULL") -> str:
    return f"CASE {key} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in values.items())} ELSE {default} END"


# ---- vitals ------------------------------------------------------------------------------------------------
_BETWEEN = " OR ".join(f"(parameter = '{p}' AND value BETWEEN {a} AND {b})" for p, (a, b) in rules.ARTIFACT_LIMITS["stream"].items())
_ENGINE = " OR ".join(f"(parameter = '{p}' AND value BETWEEN {a} AND {b})" for p, (a, b) in rules.ARTIFACT_LIMITS["engine"].items())
_WIDE = "wide AS (SELECT patient_id, " + ", ".join(f"arg_max(value, (time, seq)) FILTER (WHERE parameter = '{p}') AS {p}" for p in vitals.PIVOTED) + " FROM {} GROUP BY patient_id)"
_NEWS2 = " + ".join(scores.banded_sql(p, b) for p, b in rules.NEWS2.items())
_GAP = " + ".join(scores.gapped_sql(p, *b) for p, b in rules.NEWS2_GAP.items())
_MEWS = " + ".join(scores.gapped_sql(p, *b) for p, b in rules.MEWS.items())
_SOFA = "(CASE WHEN coalesce(spo2_pulse_ox, 98) < 90 THEN 3 WHEN coalesce(spo2_pulse_ox, 98) < 93 THEN 2 WHEN coalesce(spo2_pulse_ox, 98) < 96 THEN 1 ELSE 0 END + CASE WHEN bp_systolic < 90 THEN 2 ELSE 0 END)"
_SCORED = f"scored AS (SELECT *, {_NEWS2} AS news2, {_MEWS} AS mews, {_SOFA} AS sofa, {_GAP} AS news2_gap FROM wide)"
_RISK = "CASE WHEN news2 >= 7 OR sofa >= 8 THEN 'CRITICAL' WHEN news2 >= 5 THEN 'HIGH' WHEN news2 >= 3 THEN 'MEDIUM' ELSE 'LOW' END"
_FEATURES = """indexed AS (SELECT *, row_number() OVER (PARTITION BY patient_id, parameter ORDER BY time, seq) - 1 AS i FROM vitals),
feats AS (SELECT patient_id, parameter, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS min, max(value) AS max, arg_max(value, i) AS last,
  CASE WHEN count(value) >= 3 THEN regr_slope(value, i) ELSE 0 END AS slope FROM indexed GROUP BY patient_id, parameter)"""
_POP_MEAN, _POP_SD = _case({k: v[0] for k, v in rules.POPULATION.items()}, "parameter"), _case({k: v[1] for k, v in rules.POPULATION.items()}, "parameter")
_BASE = f"""base AS (SELECT patient_id, parameter, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.9) AS p90, (epoch(max(time)) - epoch(min(time))) >= 86400 AS mature FROM vitals WHERE {_ENGINE} GROUP BY patient_id, parameter HAVING count(value) >= 10)"""


@query(f"{_WIDE.format(f'(SELECT * FROM vitals WHERE {_BETWEEN})')}, {_SCORED} SELECT patient_id, {', '.join(vitals.PIVOTED)}, news2, mews, sofa, {_RISK} AS risk_level FROM scored", "vitals")
def ward_board(spark, sf_dir):
    return vitals.ward_board(fx.vitals(spark, sf_dir)).select("patient_id", *vitals.PIVOTED, "news2", "mews", "sofa", "risk_level")


@query("SELECT patient_id, parameter, arg_max(value, (time, seq)) AS value, max(time) AS time FROM vitals GROUP BY patient_id, parameter", "vitals")
def latest_vitals(spark, sf_dir):
    return vitals.latest(fx.vitals(spark, sf_dir))


@query("SELECT patient_id, parameter, value, time, seq FROM vitals WHERE time > TIMESTAMP '2024-01-28 12:00:00' AND time <= TIMESTAMP '2024-01-30 12:00:00'", "vitals")
def vitals_range(spark, sf_dir):
    return vitals.in_range(fx.vitals(spark, sf_dir), "2024-01-30 12:00:00").select("patient_id", "parameter", "value", "time", "seq")


@query(f"{_FEATURES} SELECT patient_id, parameter, n, round(mean, 6) AS mean, round(sd, 6) AS sd, min, max, last, round(slope, 6) AS slope, round((mean - {_POP_MEAN}) / {_POP_SD}, 6) AS z, round(sd / mean * 100, 6) AS cv FROM feats", "vitals")
def vital_features(spark, sf_dir):
    return vitals.features(fx.vitals(spark, sf_dir)).select("patient_id", "parameter", "n", "min", "max", "last", *_r("mean", "sd", "slope", "z", "cv"))


@query(f"{_BASE} SELECT patient_id, parameter, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p10, 8) AS p10, round(median, 6) AS median, round(p90, 8) AS p90, mature FROM base", "vitals")
def vital_baseline(spark, sf_dir):
    return vitals.baseline(fx.vitals(spark, sf_dir)).select("patient_id", "parameter", "n", "mature", *_r("mean", "sd", "median"), *_r("p10", "p90", d=8))


@query(
    f"""{_BASE}, last AS (SELECT patient_id, parameter, arg_max(value, (time, seq)) AS value FROM vitals GROUP BY patient_id, parameter),
    j AS (SELECT patient_id, parameter, value, coalesce(b.mean, {_POP_MEAN}) AS mean, CASE WHEN b.sd > 0 THEN b.sd ELSE {_POP_SD} END AS sd FROM last LEFT JOIN base b USING (patient_id, parameter)),
    z AS (SELECT *, abs((value - mean) / sd) AS z FROM j)
    SELECT patient_id, parameter, value, round(z, 6) AS z, CASE WHEN z >= 4 THEN 'critical' WHEN z >= 3 THEN 'severe' WHEN z >= 2.5 THEN 'moderate' ELSE 'mild' END AS severity,
    CASE WHEN value > mean THEN 'spike' ELSE 'drop' END AS kind FROM z WHERE z >= 2""", "vitals")
def anomalies(spark, sf_dir):
    return vitals.anomalies(fx.vitals(spark, sf_dir)).select("patient_id", "parameter", "value", "severity", "kind", *_r("z"))


_THIRD = ", ".join(f"arg_max(value, rn) FILTER (WHERE parameter = '{p}' AND part = '{t}') AS {t}_{p}" for t in ("first", "last") for p in vitals.PIVOTED)
_N2 = {t: " + ".join(scores.banded_sql(f"{t}_{p}", b) for p, b in rules.NEWS2.items()) for t in ("first", "last")}


@query(
    f"""r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY time, seq) AS rn, count(*) OVER (PARTITION BY patient_id) AS n FROM vitals),
    t AS (SELECT *, CASE WHEN rn <= n // 3 THEN 'first' WHEN rn > n - n // 3 THEN 'last' END AS part FROM r WHERE n >= 10),
    w AS (SELECT patient_id, {_THIRD} FROM t WHERE part IS NOT NULL GROUP BY patient_id), s AS (SELECT patient_id, {_N2["first"]} AS first_news2, {_N2["last"]} AS last_news2 FROM w)
    SELECT *, CASE WHEN last_news2 - first_news2 >= 5 THEN 'critical_change' WHEN last_news2 - first_news2 >= 3 THEN 'worsening' WHEN last_news2 - first_news2 <= -3 THEN 'improving' ELSE 'stable' END AS trend FROM s""", "vitals")
def trend(spark, sf_dir):
    return vitals.trend(fx.vitals(spark, sf_dir))


@query(
    """s AS (SELECT patient_id, parameter, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS sd,
    round((arg_max(value, (time, seq)) - arg_min(value, (time, seq))) / count(*), 6) AS slope FROM vitals GROUP BY patient_id, parameter)
    SELECT *, CASE WHEN slope > 0.5 THEN 'rising' WHEN slope < -0.5 THEN 'falling' ELSE 'stable' END AS direction FROM s""", "vitals")
def trend_stats(spark, sf_dir):
    return vitals.trend_stats(fx.vitals(spark, sf_dir)).select("patient_id", "parameter", "n", "min", "max", "direction", *_r("mean", "sd", "slope"))


_INPUTS = {p: f"coalesce({p}, {d})" for p, d in rules.MODEL_DEFAULTS.items()} | {s: f"coalesce({s}, 0)" for s in ("hr_slope", "sbp_slope")}
_MODEL = f"""{_FEATURES}, {_WIDE.format("vitals")}, slopes AS (SELECT patient_id, max(slope) FILTER (WHERE parameter = 'heart_rate') AS hr_slope, max(slope) FILTER (WHERE parameter = 'bp_systolic') AS sbp_slope FROM feats GROUP BY patient_id),
model AS (SELECT patient_id, {scores.additive_sql(rules.DETERIORATION, _INPUTS)} AS deterioration, {scores.additive_sql(rules.SEPSIS, _INPUTS)} AS sepsis FROM wide JOIN slopes USING (patient_id))"""


@query(f"{_MODEL} SELECT patient_id, round(deterioration, 6) AS deterioration, round(sepsis, 6) AS sepsis, round(0.55 * deterioration + 0.45 * sepsis, 6) AS mortality FROM model", "vitals")
def deterioration_model(spark, sf_dir):
    return vitals.deterioration(fx.vitals(spark, sf_dir)).select("patient_id", *_r("deterioration", "sepsis", "mortality"))


@query(
    f"""{_MODEL}, {_SCORED}, a AS (SELECT patient_id, news2, round(deterioration, 9) AS d, round(sepsis, 9) AS s, round(0.55 * deterioration + 0.45 * sepsis, 9) AS m FROM scored JOIN model USING (patient_id))
    SELECT patient_id, concat_ws(',', CASE WHEN news2 >= 5 THEN 'NEWS2' END, CASE WHEN d >= 0.7 THEN 'DETERIORATION' END, CASE WHEN s >= 0.5 THEN 'SEPSIS' END, CASE WHEN m >= 0.4 THEN 'MORTALITY' END) AS alerts,
    CASE greatest(CASE WHEN news2 >= 7 THEN 3 WHEN news2 >= 5 THEN 2 ELSE 0 END, CASE WHEN d >= 0.7 THEN 2 ELSE 0 END, CASE WHEN s > 0.7 THEN 3 WHEN s >= 0.5 THEN 2 ELSE 0 END, CASE WHEN m > 0.6 THEN 3 WHEN m >= 0.4 THEN 2 ELSE 0 END)
    WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS priority FROM a""", "vitals")
def alerts(spark, sf_dir):
    return vitals.alerts(fx.vitals(spark, sf_dir)).select("patient_id", "alerts", "priority")


for _name in ("news2_gap", "mews", "sofa"):

    def _score(spark, sf_dir, _name=_name):
        return vitals.with_scores(vitals.latest_wide(fx.vitals(spark, sf_dir))).select("patient_id", _name)

    QUERIES[_name] = _score
    ORACLES[_name] = fx.with_views(f"{_WIDE.format('vitals')}, {_SCORED} SELECT patient_id, {_name} FROM scored", "vitals")


@query(
    """r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, parameter ORDER BY time DESC, seq DESC) AS rn FROM vitals)
    SELECT patient_id, parameter, string_agg(value::INT::VARCHAR, ',' ORDER BY time, seq) AS points FROM r WHERE rn <= 30 GROUP BY patient_id, parameter""", "vitals")
def sparkline(spark, sf_dir):
    got = vitals.sparkline(fx.vitals(spark, sf_dir))
    return got.select("patient_id", "parameter", F.array_join(F.transform("points", lambda x: F.rint(x).cast("int").cast("string")), ",").alias("points"))


@query(
    """SELECT patient_id, parameter, seq, round(avg(value) OVER w, 6) AS rolling_mean, count(value) OVER w AS rolling_n FROM (SELECT *, floor(epoch(time))::BIGINT AS s FROM vitals)
    WINDOW w AS (PARTITION BY patient_id, parameter ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""", "vitals")
def rolling_mean(spark, sf_dir):
    return vitals.rolling(fx.vitals(spark, sf_dir)).select("patient_id", "parameter", "seq", "rolling_n", *_r("rolling_mean"))


# ---- ingest and quality --------------------------------------------------------------------------------------
@query(f"SELECT patient_id, parameter, value, seq FROM vitals WHERE {_BETWEEN}", "vitals")
def artifact_filter(spark, sf_dir):
    return vitals.artifact_filter(fx.vitals(spark, sf_dir)).select("patient_id", "parameter", "value", "seq")


_LOW = " OR ".join(f"(parameter = '{p}' AND value < {a})" for p, (a, _) in rules.CRITICAL.items())
_HIGH = " OR ".join(f"(parameter = '{p}' AND value > {b})" for p, (_, b) in rules.CRITICAL.items() if b)


@query(f"SELECT seq, ({_LOW}) AS is_low, ({_HIGH}) AS is_high, CASE WHEN {_LOW} THEN upper(parameter) || '_LOW' WHEN {_HIGH} THEN upper(parameter) || '_HIGH' END AS alert FROM vitals", "vitals")
def critical_flags(spark, sf_dir):
    return vitals.critical_flags(fx.vitals(spark, sf_dir)).select("seq", "is_low", "is_high", "alert")


_VENDOR = ["HR", "SpO2-1", "NBP-S", "RESP", "T1", "Unknown-X"]
_DEVICE_SQL = _case({k: f"'{v}'" for k, v in rules.DEVICE_NAMES.items()}, "vendor", "lower(vendor)")


def device_parameter(name):
    """Canonical name of a vendor's parameter; unknown names are lower-cased."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.DEVICE_NAMES.items() for x in kv]), name), F.lower(name))


@query(f"SELECT event_id, vendor, {_DEVICE_SQL} AS parameter FROM (SELECT event_id, {fx._sql_pick(_VENDOR, 'event_id')} AS vendor FROM events)")
def param_map(spark, sf_dir):
    """Vendor messages as JSON, decoded and mapped."""
    e = fx.table(spark, sf_dir, "events")
    raw = e.select("event_id", F.to_json(F.struct(fx.pick(_VENDOR, F.col("event_id")).alias("parameter"), F.col("value"), F.lit(1).alias("unused"))).alias("json"))
    got = raw.select("event_id", F.from_json("json", "parameter string, value double").alias("m")).select("event_id", F.col("m.parameter").alias("vendor"))
    return got.withColumn("parameter", device_parameter(F.col("vendor")))


_UNITS, _PARAMS = ["bpm", "mmHg", "K/uL", "furlong"], ["heart_rate", "bp_systolic", "wbc", "blood_culture", "unknown"]


@query(
    f"""SELECT event_id, parameter, unit, coalesce({_case({k: f"'{v[1]}'" for k, v in rules.LOINC.items() if v[1]}, 'parameter')}, {_case({k: f"'{v}'" for k, v in rules.UNIT_ALIASES.items()}, 'unit', 'unit')}) AS normalized,
    {_case({k: f"'{v[0]}'" for k, v in rules.LOINC.items()}, 'parameter')} AS loinc
    FROM (SELECT event_id, {fx._sql_pick(_PARAMS, 'event_id')} AS parameter, {fx._sql_pick(_UNITS, 'event_id')} AS unit FROM events)""")
def unit_normalize(spark, sf_dir):
    """The registry's unit wins, then the alias, then the unit as given."""
    of = lambda values, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)
    e = fx.table(spark, sf_dir, "events").select("event_id", fx.pick(_PARAMS, F.col("event_id")).alias("parameter"), fx.pick(_UNITS, F.col("event_id")).alias("unit"))
    unit = F.coalesce(of({k: v[1] for k, v in rules.LOINC.items() if v[1]}, F.col("parameter")), of(rules.UNIT_ALIASES, F.col("unit")), F.col("unit"))
    return e.withColumn("normalized", unit).withColumn("loinc", of({k: v[0] for k, v in rules.LOINC.items()}, F.col("parameter")))


@query(
    f"""g AS (SELECT patient_id, parameter, list_sort(list(value)) AS v FROM vitals GROUP BY ALL), q AS (SELECT patient_id, parameter, len(v) AS n, v[len(v) // 4 + 1] AS q1, v[3 * len(v) // 4 + 1] AS q3 FROM g),
    s AS (SELECT seq, round(pow(2, -(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(time))) / 3600.0 / 6), 4) AS timeliness,
    CASE WHEN n < 5 OR value BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) THEN 1.0 ELSE 0.3 END AS consistency, CASE WHEN {_ENGINE} THEN 1.0 ELSE 0.0 END AS validity FROM vitals JOIN q USING (patient_id, parameter))
    SELECT seq, timeliness, consistency::DOUBLE AS consistency, validity::DOUBLE AS validity, round(0.30 + 0.25 * timeliness + 0.25 * consistency + 0.20 * validity, 6) AS quality,
    round(0.30 + 0.25 * timeliness + 0.25 * consistency + 0.20 * validity, 6) >= 0.60 AS usable FROM s""", "vitals")
def observation_quality(spark, sf_dir):
    q = monitoring.observation_quality(fx.vitals(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return q.select("seq", "timeliness", "consistency", "validity", *_r("quality", d=6)).withColumn("usable", F.col("quality") >= 0.60)


@query(f"SELECT event_type, count(*) AS received, count(*) FILTER (WHERE value BETWEEN 0 AND 100) AS accepted, count(*) FILTER (WHERE NOT (value BETWEEN 0 AND 100)) AS rejected FROM events GROUP BY event_type")
def ingest_counts(spark, sf_dir):
    e, ok = fx.table(spark, sf_dir, "events"), F.col("value").between(0, 100)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query("SELECT event_id, sha256(props) AS digest, least(pow(2, event_id % 9), 60)::DOUBLE AS backoff, event_id % 9 < 3 AS retry FROM events WHERE value > 100 OR value IS NULL")
def dlq_split(spark, sf_dir):
    """Rejected records with digest, backoff and whether they are tried again."""
    e, n = fx.table(spark, sf_dir, "events"), F.col("event_id") % 9
    return e.filter("value > 100 or value is null").select("event_id", F.sha2("props", 256).alias("digest"), F.least(F.pow(F.lit(2.0), n), F.lit(60.0)).alias("backoff"), (n < 3).alias("retry"))


@query("SELECT date_trunc('minute', time) AS minute, parameter, count(*) AS n, round(avg(value), 6) AS mean FROM vitals GROUP BY ALL", "vitals")
def minute_resample(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    return v.groupBy(F.window("time", "1 minute").start.alias("minute"), "parameter").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# ---- governance and privacy ----------------------------------------------------------------------------------
@query(
    f"""SELECT actor_id, department, date_trunc('hour', "at")::TIMESTAMP AS hour_bucket, count(*) AS access_count, count(DISTINCT resource_id) AS distinct_patients, sum(phi::INT)::BIGINT AS phi_access_count
    FROM audit_burst WHERE outcome = 'success' AND "at" > TIMESTAMP '{fx.BURST_END}' - INTERVAL 2 HOUR GROUP BY ALL HAVING count(DISTINCT resource_id) > 30""", "audit_burst")
def breach_candidates(spark, sf_dir):
    return governance.breach_candidates(fx.audit_burst(spark, sf_dir), F.lit(fx.BURST_END).cast("timestamp_ntz"))


@query(
    """SELECT actor_id, resource_id, "at", count(*) OVER (PARTITION BY actor_id ORDER BY epoch("at")::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window,
    count(*) OVER (PARTITION BY actor_id ORDER BY epoch("at")::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) > 50 AS breach FROM audit_burst WHERE out_of_department""", "audit_burst")
def breach_sliding(spark, sf_dir):
    return governance.sliding_access(fx.audit_burst(spark, sf_dir)).select("actor_id", "resource_id", "at", "in_window", "breach")


_ROLES, _RESOURCES = ["physician", "nurse", "radiologist", "pharmacist", "admin", "researcher", "ai_system"], ["Patient", "Observation", "MedicationRequest", "ImagingStudy", "AllergyIntolerance"]


def access_requests(spark, sf_dir):
    e, k = fx.table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        k, fx.pick(_ROLES, k).alias("role"), fx.pick(["read", "write", "infer"], k).alias("action"), fx.pick(["treating", "consulting", "none", "operations"], k).alias("relationship"), fx.pick(["normal", "sensitive"], F.floor(k / 3)).alias("sensitivity"),
        fx.pick(_RESOURCES, k).alias("resource_type"), fx.pick(["treatment", "operations"], F.floor(k / 5)).alias("reason"), (k % 11 < 4).alias("after_hours"), (k % 13 < 6).alias("irb"),
    )


_REQUESTS = f"""req AS (SELECT event_id, {fx._sql_pick(_ROLES, 'event_id')} AS role, {fx._sql_pick(['read', 'write', 'infer'], 'event_id')} AS action, {fx._sql_pick(['treating', 'consulting', 'none', 'operations'], 'event_id')} AS rel,
{fx._sql_pick(['normal', 'sensitive'], 'event_id // 3')} AS sens, {fx._sql_pick(_RESOURCES, 'event_id')} AS res, {fx._sql_pick(['treatment', 'operations'], 'event_id // 5')} AS reason, event_id % 11 < 4 AS ah, event_id % 13 < 6 AS irb FROM events)"""


_ALLOWED = """CASE
    WHEN role = 'ai_system' THEN action IN ('read', 'infer') WHEN role = 'researcher' THEN action = 'read' AND irb WHEN rel = 'none' AND role <> 'admin' THEN false
    WHEN sens = 'sensitive' AND role IN ('nurse', 'admin') THEN false WHEN ah AND sens = 'sensitive' AND role = 'physician' AND rel = 'treating' THEN true
    WHEN role = 'nurse' THEN rel = 'treating' AND res IN ('Observation', 'MedicationRequest', 'Patient') WHEN role = 'physician' THEN rel IN ('treating', 'consulting')
    WHEN role = 'radiologist' THEN res IN ('ImagingStudy', 'DiagnosticReport', 'Patient') WHEN role = 'pharmacist' THEN res IN ('MedicationRequest', 'Observation', 'AllergyIntolerance')
    WHEN role = 'admin' THEN reason = 'operations' ELSE false END"""


@query(f"WITH {_REQUESTS} SELECT event_id, {_ALLOWED} AS allowed FROM req")
def access_decisions(spark, sf_dir):
    return governance.access_decision(access_requests(spark, sf_dir)).select("event_id", "allowed")


@query("""SELECT user_id AS patient_id, coalesce(arg_max(value >= 40, (ts, event_id)) FILTER (WHERE event_id % 2 = 0), false) AS treatment_use, coalesce(arg_max(value >= 40, (ts, event_id)) FILTER (WHERE event_id % 2 = 1), false) AS ai_use FROM events GROUP BY user_id""")
def consent_gate(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    events = e.select(F.col("user_id").alias("patient_id"), F.when(F.col("event_id") % 2 == 0, "treatment_use").otherwise("ai_use").alias("kind"), (F.col("value") >= 40).alias("granted"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return governance.latest_consent(events, ["treatment_use", "ai_use"])


_PATHS, _METHODS, _STATUS = ["/api/patients/1", "/api/vitals/2", "/api/agents", "/health"], ["GET", "POST", "PUT", "DELETE", "HEAD"], [200, 201, 401, 403, 404, 500]


@query(
    f"""SELECT CASE WHEN contains(path, '/patients') THEN 'Patient' WHEN contains(path, '/vitals') THEN 'Observation' WHEN contains(path, '/agents') THEN 'AgentSession' ELSE 'Other' END AS resource_type,
    CASE WHEN method = 'GET' THEN 'read' WHEN method = 'POST' THEN 'create' WHEN method = 'PUT' THEN 'update' WHEN method = 'DELETE' THEN 'delete' ELSE 'other' END AS action,
    CASE WHEN status < 400 THEN 'success' WHEN status IN (401, 403) THEN 'denied' ELSE 'error' END AS outcome, substr(sha256(ip), 1, 16) AS ip_hash, CASE WHEN regexp_matches(id, '^[A-Za-z0-9_-]{{1,64}}$') THEN id END AS safe_id
    FROM (SELECT {fx._sql_pick(_PATHS, 'event_id')} AS path, {fx._sql_pick(_METHODS, 'event_id')} AS method, [200,201,401,403,404,500][event_id % 6 + 1] AS status, '10.0.0.' || (event_id % 250) AS ip, CASE WHEN event_id % 7 = 0 THEN 'bad id!' ELSE 'p-' || event_id END AS id FROM events)""")
def audit_projection(spark, sf_dir):
    e, k = fx.table(spark, sf_dir, "events"), F.col("event_id")
    return governance.audit_projection(e.select(
        fx.pick(_PATHS, k).alias("path"), fx.pick(_METHODS, k).alias("method"), fx.pick(_STATUS, k).alias("status"), F.concat(F.lit("10.0.0."), k % 250).alias("ip"), F.when(k % 7 == 0, "bad id!").otherwise(F.concat(F.lit("p-"), k)).alias("id"),
    ))


@query(f"SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN '' ELSE {privacy.hmac_sql(chr(39) + 'name:' + chr(39) + ' || upper(trim(c_name))', SALT)} END AS digest FROM customer")
def hmac_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", privacy.field_hash(F.col("c_name"), "name", SALT).alias("digest"))


@query(f"SELECT c_custkey, 'PT-' || upper(substr({privacy.hmac_sql('c_custkey::VARCHAR || ' + chr(39) + ':PT' + chr(39), SALT)}, 1, 16)) AS pseudonym FROM customer")
def pseudonymize(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", privacy.pseudonym(F.col("c_custkey").cast("string"), "PT", SALT).alias("pseudonym"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '[DATE-REMOVED]' WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%Y') ELSE
    strftime(o_orderdate::DATE + (('0x' || substr({privacy.hmac_sql('o_custkey::VARCHAR', SALT)}, 1, 4))::INT % 181 - 90)::INT, '%Y-%m-%d') END AS shifted FROM orders""")
def date_shift(spark, sf_dir):
    o, k = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    text = F.when(k == 0, "no date").when(k == 1, F.concat(F.lit("about "), F.year("o_orderdate"))).when(k == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 3, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", privacy.shift_date(text, F.col("o_custkey").cast("string"), SALT).alias("shifted"))


@query("SELECT patient_id, CASE WHEN patient_id % 110 > 89 THEN '90+' ELSE (patient_id % 110)::VARCHAR END AS age, CASE WHEN length(zip) >= 5 THEN substr(zip, 1, 3) || '000' ELSE '00000' END AS zip3 FROM patients", "patients")
def age_zip(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    return p.select("patient_id", privacy.generalize_age(F.col("patient_id") % 110).alias("age"), privacy.generalize_zip(F.col("zip")).alias("zip3"))


@query(f"SELECT doc_id, md5({privacy.scrub_sql('text')}) AS scrubbed_md5 FROM documents")
def scrub_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(privacy.scrub(F.col("text"))).alias("scrubbed_md5"))


@query("SELECT nation, count(*) AS patients, round(sum(balance), 2) AS balance FROM patients WHERE nation = 7 GROUP BY nation", "patients")
def hospital_isolation(spark, sf_dir):
    """Row-level isolation: only one hospital's rows, by a mandatory filter."""
    return fx.patients(spark, sf_dir).filter("nation = 7").groupBy("nation").agg(F.count(F.lit(1)).alias("patients"), F.round(F.sum("balance"), 2).alias("balance"))


# ---- business ------------------------------------------------------------------------------------------------
_HRRP = "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with(icd10, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{n}'" for n, ps, _, _ in rules.HRRP) + " END"
_LACE = f"""l AS (SELECT *, (CASE WHEN los <= 1 THEN 1 WHEN los <= 2 THEN 2 WHEN los <= 3 THEN 3 WHEN los <= 6 THEN 4 WHEN los <= 13 THEN 5 ELSE 7 END + CASE admission_type WHEN 'emergency' THEN 3 ELSE 0 END
+ CASE WHEN charlson = 0 THEN 0 WHEN charlson <= 2 THEN 1 WHEN charlson <= 4 THEN 2 WHEN charlson <= 6 THEN 3 ELSE 5 END + least(ed_visits, 4)) AS lace, {_HRRP} AS condition FROM encounters),
p0 AS (SELECT *, {rules.LACE_PROBABILITY}[least(lace, 19) + 1]::DOUBLE AS p FROM l), p1 AS (SELECT * REPLACE (CASE WHEN prior_readmission THEN least(0.9, p * 1.4::DOUBLE) ELSE p END AS p) FROM p0),
p2 AS (SELECT * REPLACE (CASE WHEN disposition = 'home' AND charlson >= 4 THEN least(0.9, p * 1.15::DOUBLE) ELSE p END AS p) FROM p1), p3 AS (SELECT * REPLACE (CASE WHEN age >= 75 THEN least(0.9, p * 1.1::DOUBLE) ELSE p END AS p) FROM p2),
laced AS (SELECT *, CASE WHEN p > 0.25 THEN 'HIGH' WHEN p > 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS risk, {_case({h[0]: h[3] for h in rules.HRRP}, 'condition', '0')} AS penalty FROM p3)"""
_DRG = _case(rules.DRG_DAYS, "drg", str(rules.DRG_DEFAULT))
_LOS = f"""lp AS (SELECT *, ({_DRG})::DOUBLE AS benchmark, ({_DRG})::DOUBLE * (1.0 + CASE WHEN charlson >= 5 THEN 0.3 ELSE 0 END + CASE WHEN age >= 80 THEN 0.2 ELSE 0 END + CASE WHEN news2 >= 5 THEN 0.2 ELSE 0 END)::DOUBLE + 0.3 * n_pending + 0.5 * n_social AS predicted FROM {{}})"""
_READ = "rd AS (SELECT *, datediff('day', discharge, lead(admission) OVER (PARTITION BY patient_id ORDER BY admission, encounter_id)) AS gap_days FROM encounters)"


@query(f"{_LACE} SELECT encounter_id, lace, round(p, 6) AS probability, risk, condition, penalty FROM laced", "encounters")
def lace_readmission(spark, sf_dir):
    return business.lace(fx.encounters(spark, sf_dir)).select("encounter_id", "lace", "risk", "condition", "penalty", *_r("probability"))


@query(f"{_READ} SELECT encounter_id, gap_days, coalesce(gap_days BETWEEN 0 AND 30, false) AS readmitted FROM rd", "encounters")
def readmission_30d(spark, sf_dir):
    return business.readmissions(fx.encounters(spark, sf_dir)).select("encounter_id", "gap_days", "readmitted")


@query(
    f"""{_READ}, c AS (SELECT {_HRRP} AS condition, count(*) AS stays, count(*) FILTER (WHERE gap_days BETWEEN 0 AND 30) AS readmitted FROM rd WHERE {_HRRP} IS NOT NULL GROUP BY 1)
    SELECT condition, stays, readmitted, round(readmitted / stays, 6) AS rate, ({_case({h[0]: h[2] for h in rules.HRRP}, 'condition')})::DOUBLE AS benchmark, readmitted / stays > {_case({h[0]: h[2] for h in rules.HRRP}, 'condition')} AS over FROM c""", "encounters")
def hrrp_report(spark, sf_dir):
    return business.hrrp_report(fx.encounters(spark, sf_dir)).select("condition", "stays", "readmitted", "benchmark", "over", *_r("rate"))


@query(f"{_LOS.format('encounters')} SELECT encounter_id, benchmark, round(predicted, 4) AS predicted, round(greatest(0, predicted - benchmark), 4) AS excess, round(greatest(0, predicted - benchmark) * 2500, 2) AS excess_cost FROM lp", "encounters")
def los_predict(spark, sf_dir):
    return business.predict_los(fx.encounters(spark, sf_dir)).select("encounter_id", "benchmark", F.round("predicted", 4).alias("predicted"), F.round("excess", 4).alias("excess"), F.round("excess_cost", 2).alias("excess_cost"))


@query(f"SELECT drg, count(*) AS stays, round(avg(los), 6) AS mean_los, ({_DRG})::DOUBLE AS benchmark, round(avg(los) - ({_DRG})::DOUBLE, 6) AS variance FROM encounters GROUP BY drg", "encounters")
def los_by_drg(spark, sf_dir):
    return business.los_by_drg(fx.encounters(spark, sf_dir)).select("drg", "stays", "benchmark", *_r("mean_los", "variance"))


_AT = "1998-06-01"


@query(
    f"""u AS (SELECT c_nationkey AS unit, 40 AS total_beds, count(*) FILTER (WHERE admission <= DATE '{_AT}' AND discharge > DATE '{_AT}')::INT AS occupied, count(*) FILTER (WHERE discharge = DATE '{_AT}')::INT AS cleaning,
    count(*) FILTER (WHERE discharge = DATE '{_AT}' + 1)::INT AS discharges, count(*) FILTER (WHERE admission = DATE '{_AT}' + 1)::INT AS admissions FROM encounters JOIN customer ON patient_id = c_custkey GROUP BY ALL)
    SELECT unit, occupied, round(occupied / total_beds, 6) AS occupancy, greatest(0, total_beds - occupied - cleaning)::INT AS available, CASE WHEN occupied / total_beds >= 0.95 THEN 'CRITICAL' WHEN occupied / total_beds >= 0.85 THEN 'HIGH' WHEN occupied / total_beds >= 0.70 THEN 'MODERATE' ELSE 'NORMAL' END AS status,
    greatest(0, total_beds - occupied - cleaning) + discharges - admissions < 5 AS surge FROM u""", "encounters")
def bed_snapshot(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("unit"))
    d = F.lit(_AT).cast("date")
    n = lambda t: F.count_if(t).cast("int")
    units = fx.encounters(spark, sf_dir).join(c, "patient_id").groupBy("unit").agg(
        n((F.col("admission") <= d) & (F.col("discharge") > d)).alias("occupied"), n(F.col("discharge") == d).alias("cleaning"), n(F.col("discharge") == F.date_add(d, 1)).alias("discharges"), n(F.col("admission") == F.date_add(d, 1)).alias("admissions")
    ).withColumn("total_beds", F.lit(40))
    return business.bed_snapshot(units).select("unit", "occupied", "available", "status", "surge", *_r("occupancy"))


@query(
    f"""{_LACE}, {_LOS.format('laced')} SELECT date_trunc('month', discharge)::TIMESTAMP AS month, count(*) AS stays, count(*) FILTER (WHERE risk = 'HIGH') AS intervened, floor(0.2::DOUBLE * count(*) FILTER (WHERE risk = 'HIGH'))::BIGINT AS prevented,
    round(0.2 * 13000 * count(*) FILTER (WHERE risk = 'HIGH' AND condition IS NOT NULL), 2)::DOUBLE AS readmission_savings, round(sum(greatest(0, predicted - benchmark) * 2500), 2) AS los_opportunity FROM lp GROUP BY 1""", "encounters")
def financial_monthly(spark, sf_dir):
    m = business.monthly_financial(fx.encounters(spark, sf_dir))
    return m.select("month", "stays", "intervened", "prevented", F.round("readmission_savings", 2).alias("readmission_savings"), F.round("los_opportunity", 2).alias("los_opportunity"))


@query(
    f"""m AS (SELECT encounter_id, admission, unnest(list_filter(['VTE-1', 'VTE-2', CASE WHEN starts_with(icd10, 'I21') OR starts_with(icd10, 'I22') THEN 'AMI-1' END, CASE WHEN starts_with(icd10, 'J18') THEN 'PN-6' END, CASE WHEN starts_with(icd10, 'A41') THEN 'SEP-1' END], lambda x: x IS NOT NULL)) AS measure,
    ['heparin 5000', 'none', 'enoxaparin'][encounter_id % 3 + 1] AS orders FROM encounters)
    SELECT encounter_id, measure, CASE WHEN starts_with(measure, 'VTE') THEN (orders <> 'none')::INT ELSE -1 END AS compliant, (epoch(admission::TIMESTAMP) + 86400 - epoch(TIMESTAMP '{_AT}')) / 3600.0 < 4 AND NOT (starts_with(measure, 'VTE') AND orders <> 'none') AS approaching FROM m""", "encounters")
def core_measures(spark, sf_dir):
    orders = fx.pick(["heparin 5000", "none", "enoxaparin"], F.col("encounter_id"))
    return business.core_measures(fx.encounters(spark, sf_dir), orders, F.lit(_AT).cast("timestamp")).select("encounter_id", "measure", F.coalesce(F.col("compliant").cast("int"), F.lit(-1)).alias("compliant"), "approaching")


# ---- medication and agents -----------------------------------------------------------------------------------
_PAIRS = " UNION ALL ".join(f"SELECT patient_id, encounter_id, '{a}' AS drug_a, '{b}' AS drug_b, '{s}' AS severity FROM m GROUP BY patient_id, encounter_id HAVING bool_or(contains(d, '{a}')) AND bool_or(contains(d, '{b}'))" for a, b, s in rules.DRUG_PAIRS)
_RENAL = " OR ".join(f"contains(lower(drug), '{d}')" for d in rules.RENAL_DRUGS)
_ALLERGY = " OR ".join(f"(contains(allergy, '{k}') AND ({' OR '.join(f'contains(lower(drug), {chr(39)}{x}{chr(39)})' for x in v)}))" for k, v in rules.ALLERGY_CLASSES.items())


@query(f"m AS (SELECT *, lower(drug) AS d FROM medications) {_PAIRS}", "medications")
def drug_interactions(spark, sf_dir):
    return medication.drug_interactions(fx.medications(spark, sf_dir))


@query(f"SELECT encounter_id, drug, gfr, CASE WHEN gfr < 15 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM medications WHERE gfr < 30 AND ({_RENAL})", "medications")
def renal_alerts(spark, sf_dir):
    return medication.renal_alerts(fx.medications(spark, sf_dir)).select("encounter_id", "drug", "gfr", "severity")


@query(f"SELECT encounter_id, drug, allergy, 'CRITICAL' AS severity FROM medications WHERE {_ALLERGY}", "medications")
def allergy_alerts(spark, sf_dir):
    return medication.allergy_alerts(fx.medications(spark, sf_dir)).select("encounter_id", "drug", "allergy", "severity")


@query(
    f"""m AS (SELECT *, lower(drug) AS d FROM medications), a AS (SELECT encounter_id, severity FROM ({_PAIRS}) UNION ALL SELECT encounter_id, CASE WHEN gfr < 15 THEN 'CRITICAL' ELSE 'WARNING' END FROM medications WHERE gfr < 30 AND ({_RENAL})
    UNION ALL SELECT encounter_id, 'CRITICAL' FROM medications WHERE {_ALLERGY})
    SELECT encounter_id, count(*) AS n_alerts, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS level, bool_or(severity = 'CRITICAL') AS bypass FROM a GROUP BY encounter_id""", "medications")
def pharmacist(spark, sf_dir):
    return medication.pharmacist(fx.medications(spark, sf_dir))


_COMPLAINTS = ["chest pain since noon", "cough", "Seizure", "ankle sprain", "severe bleeding", "Anaphylaxis", "difficulty breathing"]
_ESI = "CASE WHEN coalesce(spo2_pulse_ox < 85, false) OR patient_id % 16 <= 8 AND patient_id % 16 >= 3 THEN 1 WHEN coalesce(heart_rate > 150 OR heart_rate < 40, false) OR coalesce(spo2_pulse_ox < 90, false) OR coalesce(respiratory_rate > 35 OR respiratory_rate < 6, false) OR 50 + patient_id % 41 < 60 OR patient_id % 7 IN (0, 2, 5, 6) THEN 2 ELSE 3 END"


def _presented(wide):
    """Complaint, coma scale, mean pressure and two labs by key."""
    k = F.col("patient_id")
    extra = {"complaint": fx.pick(_COMPLAINTS, k), "gcs_total": F.when(k % 16 >= 3, k % 16), "bp_mean": 50 + k % 41, "wbc": 8 + k % 8, "lactate": 1.0 + k % 3}
    return wide.withColumns(extra)


def _triaged(spark, sf_dir):
    return agents.triage(_presented(vitals.with_scores(vitals.latest_wide(fx.vitals(spark, sf_dir)))))


@query(f"{_WIDE.format('vitals')} SELECT patient_id, {_ESI} AS esi, CASE {_ESI} WHEN 1 THEN 'immediate_resuscitation' WHEN 2 THEN 'emergency_treatment' ELSE 'urgent_evaluation' END AS pathway, CASE {_ESI} WHEN 1 THEN 2 WHEN 2 THEN 5 END AS page_minutes FROM wide", "vitals")
def triage_esi(spark, sf_dir):
    return _triaged(spark, sf_dir).select("patient_id", "esi", "pathway", "page_minutes")


@query(f"{_MODEL}, {_SCORED} SELECT patient_id, CASE WHEN news2 >= 7 OR round(0.55 * deterioration + 0.45 * sepsis, 9) > 0.6 OR sofa >= 8 THEN 'CRITICAL' WHEN news2 >= 5 OR deterioration > 0.7 OR sepsis > 0.5 THEN 'HIGH' WHEN news2 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scored JOIN model USING (patient_id)", "vitals")
def agent_risk(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    rows = vitals.with_scores(vitals.latest_wide(v)).select("patient_id", "news2", "sofa").join(vitals.deterioration(v).select("patient_id", "deterioration", "sepsis", "mortality"), "patient_id")
    return rows.select("patient_id", scores.risk_level(F.col("news2"), F.col("sofa"), F.col("deterioration"), F.col("sepsis"), F.col("mortality")).alias("level"))


_DIFF = f"""{_WIDE.format('vitals')}, ab AS (SELECT patient_id, coalesce(temperature > 38 AND heart_rate > 100 AND 8 + patient_id % 8 > 12, false) AS a, coalesce(spo2_pulse_ox < 94, false) AND patient_id % 7 = 6 AS b FROM wide),
dx AS (SELECT patient_id, 'Sepsis' AS diagnosis, 'A41.9' AS icd10, CASE WHEN 1 + patient_id % 3 > 2 THEN 0.72 ELSE 0.58 END::DOUBLE AS confidence, 'primary' AS rank FROM ab WHERE a
UNION ALL SELECT patient_id, 'Community-Acquired Pneumonia', 'J18.9', 0.61::DOUBLE, CASE WHEN a THEN 'alternative' ELSE 'primary' END FROM ab WHERE b UNION ALL SELECT patient_id, 'Undifferentiated presentation', 'R69', 0.4::DOUBLE, 'primary' FROM ab WHERE NOT a AND NOT b)"""


@query(f"{_DIFF} SELECT * FROM dx", "vitals")
def differentials(spark, sf_dir):
    return agents.differentials(_presented(vitals.latest_wide(fx.vitals(spark, sf_dir)))).select("patient_id", "diagnosis", "icd10", "confidence", "rank")


@query(f"{_DIFF}, w AS (SELECT patient_id, unnest(CASE icd10 WHEN 'A41.9' THEN ['Blood cultures', 'Serum lactate', 'Procalcitonin'] WHEN 'J18.9' THEN ['Chest X-ray', 'Sputum culture'] ELSE ['Basic metabolic panel and CBC'] END) AS t FROM dx) SELECT patient_id, string_agg(DISTINCT t, '; ' ORDER BY t) AS workup FROM w GROUP BY patient_id", "vitals")
def diagnostic_workup(spark, sf_dir):
    return agents.workup(differentials(spark, sf_dir)).select("patient_id", F.array_join("workup", "; ").alias("workup"))


def _votes(spark, sf_dir):
    f = fx.feedback(spark, sf_dir)
    return f.select(F.col("encounter_id").alias("patient_id"), F.col("signal").alias("agent"), F.col("risk_level").alias("level"), F.col("probability").alias("confidence"), (F.col("feedback_id") % 40 == 0).alias("bypass"))


@query(
    """c AS (SELECT encounter_id AS patient_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk_level))] AS level, avg(probability) AS p, count(*) AS agents, bool_or(feedback_id % 40 = 0) AS b FROM feedback GROUP BY 1)
    SELECT patient_id, CASE WHEN b THEN 'CRITICAL' ELSE level END AS level, CASE WHEN b THEN 1 ELSE round(p, 6) END::DOUBLE AS confidence, agents, NOT b AND p < 0.6 AS arbitration, CASE WHEN b THEN 'pharmacy_critical_override' ELSE 'consensus' END AS kind FROM c""", "feedback")
def consensus(spark, sf_dir):
    return agents.consensus(_votes(spark, sf_dir)).select("patient_id", "level", "agents", "arbitration", "kind", *_r("confidence"))


@query(
    f"""{_MODEL}, {_SCORED}, s AS (SELECT patient_id, {_ESI} AS esi, {_RISK} AS level, patient_id % 6 = 0 AS ph, sepsis FROM scored JOIN model USING (patient_id))
    SELECT patient_id, 'ESI_1' AS kind, 2 AS minutes FROM s WHERE esi = 1 UNION ALL SELECT patient_id, 'CRITICAL_RISK', 5 FROM s WHERE level = 'CRITICAL' UNION ALL SELECT patient_id, 'PHARMACY', 1 FROM s WHERE ph UNION ALL SELECT patient_id, 'SEPSIS', 5 FROM s WHERE sepsis > 0.7""", "vitals")
def escalations(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    rows = _triaged(spark, sf_dir).join(vitals.deterioration(v).select("patient_id", "sepsis"), "patient_id")
    rows = rows.select("patient_id", F.lit(AS_OF).cast("timestamp").alias("at"), "esi", F.col("risk_level").alias("level"), (F.col("patient_id") % 6 == 0).alias("pharmacy_critical"), "sepsis")
    return agents.escalations(rows).select("patient_id", "kind", "minutes")


_SRC, _SEV, _DESC = ["vitals", "labs", "imaging", "nlp"], ["critical", "severe", "moderate", "mild", "incidental"], ["lungs clear, no acute findings", "pneumonia in the left lobe", "patient improving", "heart failure", "normal", "ards likely", "stable overall"]


def _findings(spark, sf_dir):
    e, k = fx.table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("patient_id"), k.alias("seq"), fx.pick(_SRC, k).alias("source"), fx.pick(_SEV, F.floor(k / 2)).alias("severity"), ((k % 64) / 64.0).alias("confidence"), (k % 6 == 0).alias("negated"),
        fx.pick(_DESC, k).alias("description"), (84 + k % 16).alias("spo2"), (12 + k % 20).alias("rr"), (k % 9).alias("news2"),
    )


_FINDINGS = f"""WITH f AS (SELECT user_id AS patient_id, event_id AS seq, {fx._sql_pick(_SRC, 'event_id')} AS source, {fx._sql_pick(_SEV, 'event_id // 2')} AS severity, (event_id % 64) / 64.0 AS confidence, event_id % 6 = 0 AS negated,
{fx._sql_pick(_DESC, 'event_id')} AS d, 84 + event_id % 16 AS spo2, 12 + event_id % 20 AS rr, event_id % 9 AS news2 FROM events)"""
_W, _S = _case(rules.MODALITY_WEIGHT, "source", "0.1"), _case(rules.SEVERITY, "severity")


@query(
    f"""{_FINDINGS}, a AS (SELECT patient_id, sum(({_S}) * ({_W})::DOUBLE * confidence) FILTER (WHERE NOT negated) AS s, sum(({_W})::DOUBLE * confidence) FILTER (WHERE NOT negated) AS w, count(DISTINCT source) AS modalities FROM f GROUP BY patient_id)
    SELECT patient_id, CASE WHEN coalesce(w, 0) = 0 THEN 'LOW' WHEN s / w >= 3 THEN 'CRITICAL' WHEN s / w >= 2 THEN 'HIGH' WHEN s / w >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level,
    round(CASE WHEN coalesce(w, 0) = 0 THEN 0.5 ELSE least(0.95, w / modalities) * modalities / 4.0 END, 6)::DOUBLE AS confidence, modalities FROM a""")
def fusion_risk(spark, sf_dir):
    return agents.fusion_risk(_findings(spark, sf_dir)).select("patient_id", "level", "modalities", *_r("confidence"))


_COND = {"pneumonia": "pneumonia|consolidation|infiltrate", "heart_failure": "heart failure|chf|pulmonary edema", "ards": "ards|respiratory distress"}
_CLASH = " OR ".join(f"(bool_or(source = 'imaging' AND regexp_matches(d, '{p}') AND {x}) AND bool_or(source = 'nlp' AND regexp_matches(d, '{p}') AND {y}))" for p in _COND.values() for x, y in (("negated", "NOT negated"), ("NOT negated", "negated")))


@query(
    f"""{_FINDINGS}, a AS (SELECT patient_id, {_CLASH} AS k1, bool_or(source = 'imaging' AND regexp_matches(d, 'clear|no acute|unremarkable|normal|no evidence')) AND bool_or(source = 'vitals' AND (spo2 < 90 OR rr > 28 OR news2 >= 7)) AS k2,
    bool_or(source = 'nlp' AND regexp_matches(d, 'improving|better|improved|stable|resolving')) AND bool_or(source = 'vitals' AND news2 >= 5) AS k3 FROM f GROUP BY patient_id)
    SELECT patient_id, 'clinical_imaging' AS kind FROM a WHERE k1 UNION ALL SELECT patient_id, 'imaging_vitals' FROM a WHERE k2 UNION ALL SELECT patient_id, 'nlp_vitals' FROM a WHERE k3""")
def discordance(spark, sf_dir):
    return agents.discordance(_findings(spark, sf_dir))


@query(f"{_FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ({_S}) * confidence DESC, seq) AS rank FROM f WHERE NOT negated) SELECT patient_id, seq, source, severity, rank::INT AS rank FROM r WHERE rank <= 5")
def top_findings(spark, sf_dir):
    return agents.top_findings(_findings(spark, sf_dir)).select("patient_id", "seq", "source", "severity", "rank")


@query(
    """SELECT encounter_id AS session_id, risk_level, probability FROM feedback WHERE NOT treating AND risk_level IN ('CRITICAL', 'HIGH')""", "feedback")
def active_high_risk(spark, sf_dir):
    """Open sessions at high risk, worst first, latest first."""
    rows = fx.feedback(spark, sf_dir).filter(~F.col("treating") & F.col("risk_level").isin("CRITICAL", "HIGH"))
    return rows.orderBy(F.when(F.col("risk_level") == "CRITICAL", 1).otherwise(2), F.desc("at")).select(F.col("encounter_id").alias("session_id"), "risk_level", "probability")


# ---- notes -----------------------------------------------------------------------------------------------------
_LABS_SQL = "(?i)" + rules.LABS.replace("'", "''")


@query(
    f"""x AS (SELECT document_id, regexp_extract_all(text, '{_LABS_SQL}', 1) AS l, regexp_extract_all(text, '{_LABS_SQL}', 2) AS r, regexp_extract_all(text, '{_LABS_SQL}', 3) AS u FROM notes)
    SELECT document_id, (i - 1)::INT AS pos, lower(l[i]) AS lab, try_cast(replace(replace(r[i], '<', ''), '>', '') AS DOUBLE) AS value, u[i] AS unit FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM x)""", "notes")
def note_labs(spark, sf_dir):
    return notes.labs(fx.notes(spark, sf_dir)).select("document_id", "pos", "lab", "value", "unit")


@query("SELECT document_id, " + ", ".join(f"try_cast(nullif(regexp_extract(text, '(?i){p}', 1), '') AS DOUBLE) AS {k}" for k, p in rules.NOTE_VITALS.items()) + " FROM notes", "notes")
def note_vitals(spark, sf_dir):
    return notes.note_vitals(fx.notes(spark, sf_dir))


@query("plain AS (SELECT document_id, regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g') AS t FROM notes) " + " UNION ALL ".join(f"SELECT document_id, '{k}' AS condition, '{c}' AS icd10, len(regexp_extract_all(t, '(?i){p}')) AS mentions FROM plain WHERE regexp_matches(t, '(?i){p}')" for k, (p, c) in rules.DISEASES.items()), "notes")
def note_conditions(spark, sf_dir):
    return notes.conditions(fx.notes(spark, sf_dir))


def _spans_of(kind: str, label: str, pattern: str) -> str:
    """Spans of a pattern by the lengths of what lies between and in its matches."""
    return f"""SELECT document_id, '{kind}' AS kind, '{label}' AS label, start, start + length(hits[i]) AS stop FROM (SELECT *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INT AS start
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT document_id, string_split_regex(t, '(?i){pattern}') AS parts, regexp_extract_all(t, '(?i){pattern}') AS hits FROM plain)))"""


_CUES = {"pre": rules.PRE_NEGATION, "post": rules.POST_NEGATION, "doubt": rules.UNCERTAINTY, "past": rules.HISTORICAL, "kin": rules.FAMILY}
#: Mentions with their cues by a plain range join; accented letters count as letters.
MENTIONS = f"""plain AS (SELECT document_id, regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g') AS t FROM notes),
    found AS ({" UNION ALL ".join(_spans_of("disease", k, p) for k, (p, _) in rules.DISEASES.items())}), cues AS ({" UNION ALL ".join(_spans_of(k, "", p) for k, ps in _CUES.items() for p in ps)}),
    near AS (SELECT f.document_id, f.label, f.start, f.stop, c.kind, c.stop <= f.start AND c.start >= f.start - 150 AS ahead, c.start >= f.stop AND c.stop <= f.stop + 100 AS behind FROM found f LEFT JOIN cues c USING (document_id)),
    mentioned AS (SELECT document_id, label AS condition, start, stop AS "end", coalesce(bool_or((kind = 'pre' AND ahead) OR (kind = 'post' AND behind)), false) AS negated, coalesce(bool_or(kind = 'doubt' AND (ahead OR behind)), false) AS uncertain,
        CASE WHEN bool_or(kind = 'kin' AND ahead) THEN 'family_history' WHEN bool_or(kind = 'past' AND ahead) THEN 'historical' ELSE 'current' END AS temporal FROM near GROUP BY ALL)"""


@query(f"{MENTIONS} SELECT * FROM mentioned", "notes")
def note_negation(spark, sf_dir):
    """Each disease mention with what the cues around it say."""
    return notes.mentions(fx.notes(spark, sf_dir)).drop("term")


_UP, _DOWN = (" + ".join(f"contains(lower(text), '{c}')::INT" for c in cues) for cues in (rules.IMPROVING, rules.WORSENING))


@query(f"SELECT document_id, {_UP} AS improving, {_DOWN} AS worsening, CASE WHEN {_DOWN} > {_UP} THEN 'deteriorating' WHEN {_UP} > {_DOWN} THEN 'improving' ELSE 'stable' END AS sentiment FROM notes", "notes")
def note_sentiment(spark, sf_dir):
    return notes.sentiment(fx.notes(spark, sf_dir))


@query("SELECT document_id, CASE " + " ".join(f"WHEN contains(lower(substr(text, 1, 200)), '{c}') THEN '{c}'" for c in rules.NOTE_CLASSES) + " ELSE 'progress' END AS note_class FROM notes", "notes")
def note_class(spark, sf_dir):
    return notes.note_class(fx.notes(spark, sf_dir))


_TERMS = ", ".join(f"({i}, '{t}', '{c}', {p})" for i, (t, c, p) in enumerate(rules.ICD10))


@query(
    f"""h AS (SELECT document_id, term, icd10, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, pos) AS rank FROM notes, (VALUES {_TERMS}) t(pos, term, icd10, confidence) WHERE contains(lower(text), term))
    SELECT document_id, rank::INT AS rank, term, icd10, confidence FROM h WHERE rank <= 5""", "notes")
def icd10_suggest(spark, sf_dir):
    return notes.icd10_suggest(fx.notes(spark, sf_dir))


@query("SELECT md5(text) AS digest, min(document_id) AS document_id, count(*) AS copies FROM notes GROUP BY text", "notes")
def exact_dedup(spark, sf_dir):
    return notes.exact_dedup(fx.notes(spark, sf_dir))


_COSINE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), w AS (SELECT * FROM v UNION ALL
SELECT 1000000 + vec_id, list_transform(v, lambda x, i: x + (0.05 + (vec_id % 4) * 0.01) * ((i - 1) % 3 - 1)) FROM v WHERE vec_id % 5 = 0 UNION ALL SELECT 2000000 + vec_id, v FROM v WHERE vec_id % 7 = 0),
h AS (SELECT v, min(vec_id) AS vec_id FROM w GROUP BY v), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.92
UNION ALL SELECT h.vec_id, w.vec_id, 1.0 FROM w JOIN h USING (v) WHERE w.vec_id > h.vec_id)"""


def _near_vectors(spark, sf_dir):
    """The embeddings, every fifth again with noise around the threshold, every seventh again as it is."""
    e, k = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), F.col("vec_id")
    noisy = F.transform("embedding", lambda x, i: x + (0.05 + (k % 4) * 0.01) * (i % 3 - 1))
    return e.unionByName(e.filter(k % 5 == 0).select((1_000_000 + k).alias("vec_id"), noisy.alias("embedding"))).unionByName(e.filter(k % 7 == 0).select((2_000_000 + k).alias("vec_id"), "embedding"))


@query(f"WITH {_COSINE} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def cosine_dedup(spark, sf_dir):
    return notes.cosine_pairs(_near_vectors(spark, sf_dir)).select("a", "b", *_r("cosine"))


@query(f"WITH {_COSINE} SELECT b AS vec_id, min(a) AS kept FROM p GROUP BY b")
def semantic_duplicates(spark, sf_dir):
    return notes.first_seen(notes.cosine_pairs(_near_vectors(spark, sf_dir)))


@query(
    f"""i AS (SELECT encounter_id AS patient_id, feedback_id AS seq, 12::BIGINT + (feedback_id % 5) AS tokens, round(0.40 * exp(-(epoch(TIMESTAMP '{AS_OF}') - floor(epoch("at"))) / 3600.0 / 6) + 0.35 * probability + 0.25 * ((feedback_id % 8) / 8.0), 9) AS priority FROM feedback),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY patient_id ORDER BY priority DESC, seq ROWS UNBOUNDED PRECEDING) AS running FROM i) SELECT patient_id, seq, tokens, running::BIGINT AS running FROM r WHERE running <= 200""", "feedback")
def context_budget(spark, sf_dir):
    f, k = fx.feedback(spark, sf_dir), F.col("feedback_id")
    items = f.select(F.col("encounter_id").alias("patient_id"), k.alias("seq"), "at", F.col("probability").alias("severity"), ((k % 8) / 8.0).alias("similarity"), F.repeat(F.lit("x"), (48 + k % 5 * 4).cast("int")).alias("text"))
    return notes.context_budget(items, 200, F.lit(AS_OF).cast("timestamp")).select("patient_id", "seq", "tokens", "running")


# ---- identity --------------------------------------------------------------------------------------------------
_BLOCK = """b AS (SELECT a.patient_id AS id_a, c.patient_id AS id_b FROM patients a JOIN patients c ON a.patient_id < c.patient_id AND (a.ssn4 = c.ssn4 OR a.mrn = c.mrn OR (a.dob = c.dob AND substr(a.last_name, 1, 3) = substr(c.last_name, 1, 3))))"""


@query(f"{_BLOCK} SELECT id_a, id_b FROM b", "patients")
def mpi_blocking(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    return identity.blocked_pairs(p, p)


_MATCH = " + ".join(f"CASE WHEN x.{c} = y.{c} THEN {w}::DOUBLE ELSE 0 END" for c, w in identity.WEIGHTS.items())
_MPI = f"""{_BLOCK}, s AS (SELECT id_a, id_b, ({_MATCH}) / CASE WHEN x.ssn4 IS NULL OR y.ssn4 IS NULL THEN 0.65 ELSE 1 END::DOUBLE AS raw, coalesce(x.ssn4 <> y.ssn4, false) AS blocked, (x.mrn <> y.mrn)::INT + (x.dob <> y.dob)::INT + (x.last_name <> y.last_name)::INT AS conflicts FROM b JOIN patients x ON x.patient_id = id_a JOIN patients y ON y.patient_id = id_b),
d AS (SELECT id_a, id_b, conflicts, blocked, round(CASE WHEN conflicts >= 2 THEN least(0.3, raw) ELSE raw END, 6) AS score FROM s), m AS (SELECT *, CASE WHEN blocked THEN 'BLOCKED' WHEN score >= 0.95 THEN 'AUTO_LINK' WHEN score >= 0.8 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM d)"""


@query(f"{_MPI} SELECT id_a, id_b, score, conflicts, decision FROM m", "patients")
def mpi_score(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    return identity.score_rows(identity.met_rows(p, p, list(identity.WEIGHTS)), 6)


@query(f"{_MPI} SELECT decision, count(*) AS pairs FROM m GROUP BY decision", "patients")
def mpi_stats(spark, sf_dir):
    return identity.decision_counts(fx.patients(spark, sf_dir))


@query()
def name_similarity(spark, sf_dir):
    p = fx.patients(spark, sf_dir)
    return identity.named_pairs(p, p, Workspace(spark, "names"), 4)


# ---- monitoring ------------------------------------------------------------------------------------------------
_SIG = _case(rules.FEEDBACK_SIGNAL, "signal")
_ML = f"""ml AS (SELECT *, treating AND in_distribution AS valid, greatest(-1, least(1, CASE WHEN outcome_linked AND ((({_SIG}) > 0 AND occurred) OR (({_SIG}) < 0 AND NOT occurred)) THEN ({_SIG}) * 1.3 ELSE ({_SIG}) END))::DOUBLE AS ml FROM feedback)"""
_AUC = """h AS (SELECT {g} AS g, probability, count(*) AS n, count(*) FILTER (WHERE occurred) AS pos FROM {t} GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM h),
auc AS (SELECT g, sum(n)::BIGINT AS n, CASE WHEN sum(n) >= 10 AND sum(pos) > 0 AND sum(n) > sum(pos) THEN round((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))), 6)::DOUBLE END AS auroc FROM r GROUP BY g)"""


@query(f"{_ML} SELECT feedback_id, valid, ml AS ml_signal FROM ml", "feedback")
def ml_signal(spark, sf_dir):
    return monitoring.ml_signal(fx.feedback(spark, sf_dir)).select("feedback_id", "valid", "ml_signal")


@query(
    f"""{_ML} SELECT date_trunc('week', "at")::TIMESTAMP AS week, count(*) AS total, count(*) FILTER (WHERE valid) AS valid, round(avg(ml), 3) AS avg_signal, count(*) FILTER (WHERE signal = 'accepted') AS accepted,
    count(*) FILTER (WHERE signal IN ('rejected', 'thumbs_down')) AS rejected, count(*) FILTER (WHERE outcome_linked AND occurred) AS confirmed, round(count(*) FILTER (WHERE signal = 'accepted') / count(*), 3) AS acceptance_rate FROM ml GROUP BY 1""", "feedback")
def weekly_feedback(spark, sf_dir):
    w = monitoring.weekly_summary(fx.feedback(spark, sf_dir))
    return w.select("week", "total", "valid", "accepted", "rejected", "confirmed", *_r("avg_signal", "acceptance_rate", d=3))


@query(f"{_AUC.format(g='output_type', t='feedback')} SELECT g AS output_type, n, auroc FROM auc", "feedback")
def auroc(spark, sf_dir):
    return monitoring.auroc(fx.feedback(spark, sf_dir), ["output_type"]).select("output_type", "n", *_r("auroc"))


_WEEKLY = f"""{_ML}, v AS (SELECT *, date_trunc('week', "at")::TIMESTAMP AS week FROM ml WHERE valid), {_AUC.format(g='week', t='v')},
wk AS (SELECT week, round(avg((signal = 'accepted')::INT), 6) AS acceptance, round(avg((signal = 'rejected')::INT), 6) AS rejection, round(avg((signal = 'modified')::INT), 6) AS modification,
round(count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL') AND signal = 'rejected') / nullif(count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')), 0), 6) AS rejected_high FROM v GROUP BY week)"""


@query(f"{_WEEKLY} SELECT wk.*, n, auroc FROM wk LEFT JOIN auc ON g = week", "feedback")
def weekly_metrics(spark, sf_dir):
    m = monitoring.weekly_metrics(fx.feedback(spark, sf_dir))
    return m.select("week", "n", *_r("acceptance", "rejection", "modification", "rejected_high", "auroc"))


@query(
    f"""{_WEEKLY}, m AS (SELECT wk.*, auroc FROM wk LEFT JOIN auc ON g = week), d AS (SELECT week, coalesce(0.88 - auroc > 0.05, false) AS auroc_drop, coalesce(rejected_high - 0.15 > 0.10, false) AS fpr_rise, coalesce(rejection > 0.30, false) AS rejection_high FROM m)
    SELECT *, auroc_drop OR fpr_rise OR rejection_high AS drift, max((auroc_drop OR fpr_rise OR rejection_high)::INT) OVER (ORDER BY week) = 1 AS frozen FROM d""", "feedback")
def drift(spark, sf_dir):
    m = weekly_metrics(spark, sf_dir)
    return monitoring.drift(m).select("week", "auroc_drop", "fpr_rise", "rejection_high", "drift", "frozen")


@query("a AS (SELECT subgroup, avg(((probability > 0.5) = occurred)::INT) AS accuracy FROM feedback GROUP BY subgroup) SELECT round(max(accuracy) - min(accuracy), 6) AS spread, arg_max(subgroup, (accuracy, subgroup)) AS best, arg_min(subgroup, (accuracy, subgroup)) AS worst, count(*) AS groups, max(accuracy) - min(accuracy) > 0.05 AS biased FROM a", "feedback")
def bias_audit(spark, sf_dir):
    return monitoring.bias_audit(fx.feedback(spark, sf_dir)).select("best", "worst", "groups", "biased", *_r("spread"))


_OUT = list(rules.OUTCOME_OUTPUT)


@query(
    f"""o AS (SELECT user_id AS encounter_id, {fx._sql_pick(list(rules.OUTCOME_OUTPUT.values()), 'event_id')} AS output_type, arg_max(value >= 60, (ts, event_id)) AS outcome FROM events GROUP BY 1, 2)
    SELECT feedback_id, output_type, outcome, (probability > 0.5) = outcome AS correct FROM feedback JOIN o USING (encounter_id, output_type)""", "feedback")
def outcome_link(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    outcomes = e.select(F.col("user_id").alias("encounter_id"), fx.pick(_OUT, F.col("event_id")).alias("outcome_type"), (F.col("value") >= 60).alias("occurred"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return monitoring.link_outcomes(fx.feedback(spark, sf_dir), outcomes).select("feedback_id", "output_type", "outcome", "correct")


@query(
    """SELECT s_suppkey AS model, concat_ws(',', CASE WHEN NOT (s_suppkey % 5) / 64.0 >= 0.02 THEN 'gain' END, CASE WHEN s_suppkey % 4 = 0 THEN 'bias' END, CASE WHEN s_suppkey % 60 < 30 THEN 'shadow' END, CASE WHEN s_suppkey % 9 < 5 THEN 'physicians' END, CASE WHEN s_suppkey % 7 = 0 THEN 'drift' END) AS failed,
    (s_suppkey % 5) / 64.0 >= 0.02 AND s_suppkey % 4 <> 0 AND s_suppkey % 60 >= 30 AND s_suppkey % 9 >= 5 AND s_suppkey % 7 <> 0 AS eligible FROM supplier""")
def update_eligibility(spark, sf_dir):
    s, k = fx.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return monitoring.eligibility(s.select(k.alias("model"), ((k % 5) / 64.0).alias("gain"), (k % 4 != 0).alias("bias_ok"), (k % 60).alias("shadow_days"), (k % 9).alias("physicians"), (k % 7 == 0).alias("drifted")))


@query("l AS (SELECT event_type, list_sort(list(value)) AS v, median(value) AS p50 FROM events GROUP BY event_type) SELECT event_type, len(v) AS n, round(p50, 6) AS p50, v[least(floor(len(v) * 0.95), len(v) - 1)::INT + 1] AS p95, v[least(floor(len(v) * 0.99), len(v) - 1)::INT + 1] AS p99 FROM l".replace("l AS", "WITH l AS", 1))
def latency_percentiles(spark, sf_dir):
    return monitoring.latency(fx.table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", "p95", "p99", *_r("p50"))


# ---- messages and streams ----------------------------------------------------------------------------------------
@query("SELECT patient_id, parameter AS loinc_display, value AS value_numeric, 'final' AS status, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS observation_datetime FROM vitals", "vitals")
def hl7_observations(spark, sf_dir):
    """Readings written as HL7 messages, one a patient and day, and read back from them."""
    obs = hl7.observations(hl7.messages(fx.vitals(spark, sf_dir)))
    return obs.select(F.col("mrn").cast("long").alias("patient_id"), "loinc_display", "value_numeric", "status", "observation_datetime")


@query("SELECT patient_id, parameter, date_trunc('hour', time)::TIMESTAMP AS hour, count(*) AS n, min(value) AS min, max(value) AS max, round(sum(value) / count(*), 6) AS mean FROM vitals GROUP BY ALL", "vitals")
def stream_vitals_hourly(spark, sf_dir):
    """The hourly rollup as a stream over the events files; a replay is in no time order, so nothing counts as late."""
    rows = stream.replayed(spark, f"{sf_dir}/events.parquet", lambda e: stream.hourly(fx.vitals_of(e), delay="36500 days"), ["patient_id", "parameter", "hour"])
    return rows.select("patient_id", "parameter", "hour", "n", "min", "max", *_r("mean"))


_CRITICAL = " OR ".join(f"(parameter = '{p}' AND ({' OR '.join(x for x in (f'value < {lo}' if lo is not None else '', f'value > {hi}' if hi is not None else '') if x)}))" for p, (lo, hi) in rules.CRITICAL.items())


@query(f"SELECT patient_id, seq, parameter, value FROM vitals WHERE {_CRITICAL}", "vitals")
def stream_alerts(spark, sf_dir):
    """Critical readings pass a stateless stream at once, without waiting for a window."""
    return stream.replayed(spark, f"{sf_dir}/events.parquet", lambda e: stream.critical(fx.vitals_of(e)), ["seq"]).select("patient_id", "seq", "parameter", "value")
