"""Domain views over the driver's tables, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETER = {"view": "heart_rate", "click": "respiratory_rate", "error": "bp_systolic", "signup": "spo2_pulse_ox", "purchase": "temperature"}
DRUGS = [
    "warfarin 5mg", "aspirin 81mg", "fluoxetine (SSRI)", "phenelzine (MAOI)", "metformin 500mg", "iv contrast", "ciprofloxacin quinolone", "antacid",
    "amiodarone", "simvastatin", "piperacillin", "vancomycin", "clopidogrel", "omeprazole", "linezolid", "amoxicillin",
]
ICD_CODES = ["I21.3", "I50.9", "J18.9", "J44.1", "Z96.641", "Z95.1", "A41.9", "N17.9", "I22.0", "J47.0", "K92.2"]
DRG_CODES = ["291", "292", "293", "177", "178", "193", "194", "470", "287", "189", "871", "872", "999"]
PHRASES = [
    "Patient denies chest pain and has no evidence of pneumonia.", "HR: 112 BP 90/60 SpO2 88% Temp 38.6 RR 24. Sepsis suspected, worsening.", "WBC 14.2 K/uL Lactate: 3.1 mmol/L creatinine 2.1 mg/dL.",
    "History of heart failure, now improving and stable.", "Acute kidney injury resolving; AKI was ruled out.", "Radiology: no acute findings, lungs clear.", "Family history of stroke. Possible pulmonary embolism.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that does much for each, about.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """rows of a table over at least as many tasks as there are cores, and as many as leave some TASK_ROWS each, where what follows is heavy; rows in more tasks than that stay as they are read."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def tasks_for(spark: SparkSession, sf_dir: str, *tables: str, rows: int = 250_000) -> int:
    """As many tasks as leave some ``rows`` rows of the tables each, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-sum(table(spark, sf_dir, t).count() for t in tables) // rows))


def pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, time, seq, parameter, value."""
    return vitals_of(table(spark, sf_dir, "events"))


def vitals_of(events: DataFrame) -> DataFrame:
    """Readings of an events table or stream."""
    e = events.filter(F.col("event_type").isin(*PARAMETER))
    q = F.floor(F.least(F.col("value"), F.lit(200.0))).cast("int")
    value = (
        F.when(F.col("event_type") == "view", F.expr("60 + q div 2")).when(F.col("event_type") == "click", F.expr("12 + q div 8"))
        .when(F.col("event_type") == "error", F.expr("140 - q div 2")).when(F.col("event_type") == "signup", F.expr("99 - q div 12")).otherwise(36.5 + F.col("q") / 64.0)
    )
    name = F.element_at(F.create_map(*[F.lit(x) for kv in PARAMETER.items() for x in kv]), F.col("event_type"))
    return e.withColumn("q", q).select(F.col("user_id").alias("patient_id"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), name.alias("parameter"), value.cast("double").alias("value"))


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    los = (1 + k % 14).cast("int")
    return o.select(
        k.alias("encounter_id"), c.alias("patient_id"), F.to_date("o_orderdate").alias("admission"), los.alias("los"), F.date_add(F.to_date("o_orderdate"), los).alias("discharge"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "emergency").when(F.col("o_orderpriority") == "2-HIGH", "urgent").otherwise("elective").alias("admission_type"),
        F.when(F.col("o_orderstatus") == "F", "home").when(F.col("o_orderstatus") == "O", "snf").otherwise("rehab").alias("disposition"),
        pick(ICD_CODES, k).alias("icd10"), pick(DRG_CODES, k).alias("drg"), (k % 9).cast("int").alias("charlson"), (k % 6).cast("int").alias("ed_visits"),
        (20 + c % 75).cast("int").alias("age"), (k % 5 == 0).alias("prior_readmission"), (k % 8).cast("int").alias("news2"), (k % 3).cast("int").alias("n_pending"), (k % 4).cast("int").alias("n_social"),
    )


def medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, encounter_id, drug, gfr, allergy."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    allergy = pick(["penicillin", "sulfa", "cephalosporin", "none"], F.col("o_custkey"))
    n = tasks_for(spark, sf_dir, "lineitem", "orders")  # a task sorts what it joins, so the tasks grow with the rows
    l, o = l.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("patient_id"), F.col("l_orderkey").alias("encounter_id"), pick(DRUGS, F.col("l_partkey")).alias("drug"), (10 + F.col("l_quantity")).cast("double").alias("gfr"), allergy.alias("allergy")
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    dept = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("department"))
    at = F.to_timestamp(F.col("l_shipdate")) + F.make_dt_interval(F.lit(0), F.col("l_linenumber").cast("int"))
    return l.join(dept, l.l_suppkey == dept.s_suppkey).select(
        F.col("l_suppkey").alias("actor_id"), "department", F.col("l_partkey").alias("resource_id"), at.alias("at"),
        F.when(F.col("l_returnflag") == "R", "denied").otherwise("success").alias("outcome"), (F.col("l_linestatus") == "O").alias("phi"), (F.col("l_partkey") % 7 != 0).alias("out_of_department"),
    )


BURST_END = "2024-02-01 00:00:00"


def audit_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses by few actors within the last three hours."""
    k = F.col("event_id")
    at = F.lit(BURST_END).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k * 37 % 10_000)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("actor_id"), pick(["icu", "er"], F.col("user_id")).alias("department"), k.alias("resource_id"), at.alias("at"), F.when(k % 7 == 0, "denied").otherwise("success").alias("outcome"),
        (k % 2 == 0).alias("phi"), (k % 4 != 0).alias("out_of_department"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    signal = {"click": "accepted", "view": "modified", "error": "rejected", "purchase": "thumbs_up", "signup": "thumbs_down"}
    k = F.get_json_object("props", "$.k").cast("int")
    risk = pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], F.col("event_id"))
    return e.select(
        F.col("event_id").alias("feedback_id"), F.col("user_id").alias("encounter_id"), F.element_at(F.create_map(*[F.lit(x) for kv in signal.items() for x in kv]), F.col("event_type")).alias("signal"),
        risk.alias("risk_level"), pick(list_outputs(), F.col("event_id")).alias("output_type"), (k / 100.0).alias("probability"), (F.col("value") >= 40).alias("occurred"),
        (F.col("event_id") % 3 != 0).alias("treating"), (F.col("event_id") % 10 != 0).alias("in_distribution"), (F.col("event_id") % 2 == 0).alias("outcome_linked"), F.col("ts").alias("at"),
        pick(["<40", "40-64", "65+"], F.col("user_id")).alias("subgroup"),
    )


def list_outputs() -> list[str]:
    from wardlight.functions.rules import OUTCOME_OUTPUT

    return list(OUTCOME_OUTPUT.values())


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.concat(pick(PHRASES, F.col("doc_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer; every tenth is the one before it again under another record."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    who = k - (k % 10 == 1).cast("long")
    return c.select(
        k.alias("patient_id"), pick(["smith", "smyth", "jones", "sharma", "garcia", "garzia", "lee"], who).alias("last_name"), pick(["anna", "ana", "john", "jon", "maria"], who).alias("first_name"),
        F.date_add(F.lit("1950-01-01").cast("date"), (who % 97 * 100).cast("int")).alias("dob"), F.when(k % 9 > 0, F.lpad((F.floor(k / 2) * 7919 % 10_000).cast("string"), 4, "0")).alias("ssn4"), F.concat(F.lit("M"), F.floor(k / 3)).alias("mrn"),
        F.lpad((k % 53 * 17).cast("string"), 5, "0").alias("zip"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
    )


def _sql_list(values: list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list, index: str) -> str:
    return f"{_sql_list(values)}[({index}) % {len(values)} + 1]"


VIEWS: dict[str, str] = {
    "vitals": """SELECT user_id AS patient_id, ts AS time, event_id AS seq,
        CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'respiratory_rate' WHEN 'error' THEN 'bp_systolic' WHEN 'signup' THEN 'spo2_pulse_ox' ELSE 'temperature' END AS parameter,
        (CASE event_type WHEN 'view' THEN 60 + q // 2 WHEN 'click' THEN 12 + q // 8 WHEN 'error' THEN 140 - q // 2 WHEN 'signup' THEN 99 - q // 12 ELSE 36.5 + q / 64.0 END)::DOUBLE AS value
        FROM (SELECT *, floor(least(value, 200))::INT AS q FROM events WHERE event_type IN ('view','click','error','signup','purchase'))""",
    "encounters": f"""SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderdate::DATE AS admission, (1 + o_orderkey % 14)::INT AS los,
        (o_orderdate::DATE + (1 + o_orderkey % 14)::INT)::DATE AS discharge,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'urgent' ELSE 'elective' END AS admission_type,
        CASE o_orderstatus WHEN 'F' THEN 'home' WHEN 'O' THEN 'snf' ELSE 'rehab' END AS disposition,
        {_sql_pick(ICD_CODES, "o_orderkey")} AS icd10, {_sql_pick(DRG_CODES, "o_orderkey")} AS drg, (o_orderkey % 9)::INT AS charlson, (o_orderkey % 6)::INT AS ed_visits,
        (20 + o_custkey % 75)::INT AS age, o_orderkey % 5 = 0 AS prior_readmission, (o_orderkey % 8)::INT AS news2, (o_orderkey % 3)::INT AS n_pending, (o_orderkey % 4)::INT AS n_social FROM orders""",
    "medications": f"""SELECT o_custkey AS patient_id, l_orderkey AS encounter_id, {_sql_pick(DRUGS, "l_partkey")} AS drug, (10 + l_quantity)::DOUBLE AS gfr,
        {_sql_pick(["penicillin", "sulfa", "cephalosporin", "none"], "o_custkey")} AS allergy FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "audit": """SELECT l_suppkey AS actor_id, n_name AS department, l_partkey AS resource_id, l_shipdate::TIMESTAMP + to_hours(l_linenumber::INT) AS "at",
        CASE l_returnflag WHEN 'R' THEN 'denied' ELSE 'success' END AS outcome, l_linestatus = 'O' AS phi, l_partkey % 7 <> 0 AS out_of_department
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "audit_burst": f"""SELECT user_id % 5 AS actor_id, {_sql_pick(["icu", "er"], "user_id")} AS department, event_id AS resource_id, TIMESTAMP '{BURST_END}' - to_seconds(event_id * 37 % 10000) AS "at",
        CASE WHEN event_id % 7 = 0 THEN 'denied' ELSE 'success' END AS outcome, event_id % 2 = 0 AS phi, event_id % 4 <> 0 AS out_of_department FROM events""",
    "feedback": f"""SELECT event_id AS feedback_id, user_id AS encounter_id,
        CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'modified' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'thumbs_up' WHEN 'signup' THEN 'thumbs_down' END AS signal,
        {_sql_pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], "event_id")} AS risk_level, {_sql_pick(list_outputs(), "event_id")} AS output_type,
        (props->>'$.k')::INT / 100.0 AS probability, value >= 40 AS occurred, event_id % 3 <> 0 AS treating, event_id % 10 <> 0 AS in_distribution, event_id % 2 = 0 AS outcome_linked, ts AS "at",
        {_sql_pick(["<40", "40-64", "65+"], "user_id")} AS subgroup FROM events""",
    "notes": f"""SELECT doc_id AS document_id, {_sql_pick(PHRASES, "doc_id")} || ' ' || coalesce(text, '') AS text FROM documents""",
    "patients": f"""SELECT c_custkey AS patient_id, {_sql_pick(["smith", "smyth", "jones", "sharma", "garcia", "garzia", "lee"], "(c_custkey - (c_custkey % 10 = 1)::INT)")} AS last_name,
        {_sql_pick(["anna", "ana", "john", "jon", "maria"], "(c_custkey - (c_custkey % 10 = 1)::INT)")} AS first_name, (DATE '1950-01-01' + ((c_custkey - (c_custkey % 10 = 1)::INT) % 97 * 100)::INT)::DATE AS dob,
        CASE WHEN c_custkey % 9 > 0 THEN lpad((c_custkey // 2 * 7919 % 10000)::VARCHAR, 4, '0') END AS ssn4, 'M' || (c_custkey // 3) AS mrn, lpad((c_custkey % 53 * 17)::VARCHAR, 5, '0') AS zip, c_nationkey AS nation, c_acctbal AS balance FROM customer""",
}


def views_of(*names: str) -> str:
    """The named views as CTEs."""
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def with_views(sql: str, *names: str) -> str:
    """sql, which starts with SELECT or with further CTEs ('x AS (...) SELECT ...'), after the named views."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {head}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"


