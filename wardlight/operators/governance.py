"""Access control, audit and breach detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breach_candidates(audit: DataFrame, as_of: Column | None = None, distinct_limit: int = 30) -> DataFrame:
    rows = audit.filter(F.col("outcome") == "success")
    if as_of is not None:
        rows = rows.filter(F.col("at") > as_of - F.expr("interval 2 hours"))
    return (
        rows.groupBy("actor_id", "department", F.date_trunc("hour", "at").alias("hour_bucket"))
        .agg(F.count(F.lit(1)).alias("access_count"), F.countDistinct("resource_id").alias("distinct_patients"), F.sum(F.col("phi").cast("long")).alias("phi_access_count"))
        .filter(F.col("distinct_patients") > distinct_limit)
    )


def sliding_access(audit: DataFrame, seconds: int = 3600, limit: int = 50) -> DataFrame:
    """Out-of-department accesses of each actor within the trailing window, and whether they exceed the limit.

    The window runs over counts of seconds: a frame has at most ``seconds`` + 1 of them, however many accesses they had.
    """
    rows = audit.filter("out_of_department")
    w = Window.partitionBy("__actor").orderBy("__second").rangeBetween(-seconds, 0)
    counts = rows.groupBy(F.col("actor_id").alias("__actor"), F.unix_timestamp("at").alias("__second")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select("__actor", "__second", F.sum("__n").over(w).alias("in_window"))
    met = rows.join(counts, F.col("actor_id").eqNullSafe(F.col("__actor")) & F.unix_timestamp("at").eqNullSafe(F.col("__second")))
    return met.drop("__actor", "__second").withColumn("breach", F.col("in_window") > limit)


def access_decision(requests: DataFrame) -> DataFrame:
    """(allowed, rule) by ordered rules over role, action, relationship, sensitivity, resource_type, reason, after_hours, irb; default deny."""
    role, c = F.col("role"), F.col
    is_ = lambda x: role == x
    treating = c("relationship") == "treating"
    sensitive = c("sensitivity") == "sensitive"
    steps = [
        (is_("ai_system") & c("action").isin("read", "infer"), True, "ai_read"), (is_("ai_system"), False, "ai_no_write"),
        (is_("researcher") & (c("action") == "read") & c("irb"), True, "researcher_irb"), (is_("researcher") & ~c("irb"), False, "researcher_needs_irb"), (is_("researcher"), False, "researcher_read_only"),
        ((c("relationship") == "none") & ~is_("admin"), False, "no_relationship"),
        (sensitive & is_("nurse"), False, "nurse_sensitive"), (sensitive & is_("admin"), False, "admin_sensitive"),
        (c("after_hours") & sensitive & is_("physician") & treating, True, "after_hours_flagged"),
        (is_("nurse") & ~treating, False, "nurse_assigned_only"), (is_("nurse") & c("resource_type").isin("Observation", "MedicationRequest", "Patient"), True, "nurse_treating"), (is_("nurse"), False, "nurse_resource"),
        (is_("physician") & c("relationship").isin("treating", "consulting"), True, "physician_treating"), (is_("physician"), False, "physician_only_treating"),
        (is_("radiologist") & c("resource_type").isin("ImagingStudy", "DiagnosticReport", "Patient"), True, "radiologist_imaging"), (is_("radiologist"), False, "radiologist_only_imaging"),
        (is_("pharmacist") & c("resource_type").isin("MedicationRequest", "Observation", "AllergyIntolerance"), True, "pharmacist_medication"), (is_("pharmacist"), False, "pharmacist_only_medication"),
        (is_("admin") & (c("reason") == "operations"), True, "admin_operations"), (is_("admin"), False, "admin_only_operations"),
    ]
    chain = None
    for test, allowed, rule in steps:
        got = F.struct(F.lit(allowed).alias("allowed"), F.lit(rule).alias("rule"))
        chain = F.when(test, got) if chain is None else chain.when(test, got)
    chain = chain.otherwise(F.struct(F.lit(False).alias("allowed"), F.lit("no_rule").alias("rule")))
    return requests.withColumn("d", chain).select("*", "d.allowed", "d.rule").drop("d")


def latest_consent(events: DataFrame, kinds: list[str]) -> DataFrame:
    """The last consent of each kind by patient; never given counts as refused."""
    return events.groupBy("patient_id").agg(*[F.coalesce(F.max_by(F.when(F.col("kind") == k, F.col("granted")), F.when(F.col("kind") == k, F.struct("at", "seq"))), F.lit(False)).alias(k) for k in kinds])


def update_consent(events: DataFrame) -> DataFrame:
    """Consent events that may be applied: treatment use is always granted and can't be changed."""
    return events.filter(F.col("kind") != "treatment_use")


def gateway(requests: DataFrame, consents: DataFrame) -> DataFrame:
    """requests decided, with outcome for the audit and whether the data must be de-identified.

    requests: the fields of ``access_decision`` and patient_id; consents: patient_id, ai_use (``latest_consent``).
    Systems and researchers always get de-identified data; others do for inference without the patient's consent.
    """
    decided = access_decision(requests).join(consents.select("patient_id", "ai_use"), "patient_id", "left")
    unnamed = F.col("role").isin("ai_system", "researcher") | ((F.col("reason") == "ai_inference") & ~F.coalesce("ai_use", F.lit(False)))
    return decided.withColumn("outcome", F.when(F.col("allowed"), "success").otherwise("denied")).withColumn("deidentify", F.col("allowed") & unnamed)


#: What a gateway run counts while it writes: name -> aggregate over its rows.
def gateway_metrics() -> dict[str, Column]:
    out = F.col("outcome")
    return {
        "requests": F.count(F.lit(1)), "allowed": F.count_if(out == "success"), "denied": F.count_if(out == "denied"), "deidentified": F.count_if("deidentify"),
        "payloads": F.count_if(F.col("payload").isNotNull()), "breaches": F.count_if("breach"),
    }


def gateway_run(requests: DataFrame, consents: DataFrame, patients: DataFrame, salt: bytes, path: str, seconds: int = 3600, limit: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """Every request through the whole gateway, written once to ``path``: (the written rows, the counters of the run).

    A row is the decision, its audit (a pseudonym for the patient, the outcome), whether the actor has made more than ``limit`` allowed out-of-department
    accesses within the ``seconds`` up to it, and the payload: none if denied, de-identified where that is asked for, else the record as JSON. The
    counters are observed while the rows are written, so no second scan is made.
    requests: those of ``gateway`` with event_id, actor_id, at and out_of_department; patients: patient_id, patient (a struct as ``fhir.deidentify_patient`` takes it).
    """
    from pyspark.sql import Observation

    from wardlight.functions.privacy import pseudonym
    from wardlight.operators.fhir import deidentify_patient

    window = Window.partitionBy("actor_id").orderBy(F.unix_timestamp("at")).rangeBetween(-seconds, 0)
    decided = gateway(requests, consents).withColumn("__counts", (F.col("allowed") & F.col("out_of_department")).cast("int"))
    decided = decided.withColumn("breach", (F.col("__counts") == 1) & (F.sum("__counts").over(window) > limit)).drop("__counts")
    records = deidentify_patient(patients, salt).select("patient_id", F.to_json("patient").alias("__named"), F.to_json("deidentified").alias("__unnamed"))
    rows = decided.join(records, "patient_id", "left").withColumn("payload", F.when(F.col("allowed"), F.when(F.col("deidentify"), F.col("__unnamed")).otherwise(F.col("__named")))).drop("__named", "__unnamed")
    rows = rows.withColumn("audit_patient", pseudonym(F.col("patient_id").cast("string"), "PAT", salt))
    seen = Observation("gateway")
    rows.observe(seen, *[c.alias(k) for k, c in gateway_metrics().items()]).write.mode("overwrite").parquet(path)
    return requests.sparkSession.read.schema(rows.schema).parquet(path), seen.get


def audit_of(run: DataFrame) -> DataFrame:
    """The audit rows of a run: one a request, whatever its outcome."""
    return run.select("event_id", "actor_id", F.col("role").alias("actor_role"), "action", "resource_type", F.col("audit_patient").alias("resource_id"), F.col("reason").alias("access_reason"), "outcome", "at")


def patient_view(patients: DataFrame, role: str) -> DataFrame:
    """The patient list as a role sees it: birth year and three digits of the code; the name for physicians only."""
    name = F.concat_ws(", ", "last_name", "first_name") if role == "physician" else F.lit(None).cast("string")
    return patients.select("patient_id", name.alias("name"), F.year("dob").alias("birth_year"), F.substring("zip", 1, 3).alias("zip3"))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of rows in order, with has_more; one row past the page is looked at."""
    some = rows.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    n = F.row_number().over(Window.orderBy(*order))  # size + 1 rows
    return some.withColumn("__n", n).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size).filter(F.col("__n") <= size).drop("__n")


def audit_projection(requests: DataFrame) -> DataFrame:
    """HTTP-like requests (path, method, status, ip, id) as audit events."""
    resource = F.when(F.col("path").contains("/patients"), "Patient").when(F.col("path").contains("/vitals"), "Observation").when(F.col("path").contains("/agents"), "AgentSession").otherwise("Other")
    action = F.when(F.col("method") == "GET", "read").when(F.col("method") == "POST", "create").when(F.col("method").isin("PUT", "PATCH"), "update").when(F.col("method") == "DELETE", "delete").otherwise("other")
    outcome = F.when(F.col("status") < 400, "success").when(F.col("status").isin(401, 403), "denied").otherwise("error")
    return requests.select(
        resource.alias("resource_type"), action.alias("action"), outcome.alias("outcome"), F.substring(F.sha2("ip", 256), 1, 16).alias("ip_hash"),
        F.when(F.col("id").rlike("^[A-Za-z0-9_-]{1,64}$"), F.col("id")).alias("safe_id"),
    )
