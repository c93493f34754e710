"""Resources as JSON: bundle scan, validation, normalisation of patients, observations and orders, de-identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import privacy, rules


def bundle_entries(bundles: DataFrame, bundle_col: str = "bundle") -> DataFrame:
    """bundles with resource, the JSON text of each entry's resource. What is no Bundle, or no JSON, has no entries."""
    parsed = F.from_json(bundle_col, "resourceType string, entry array<struct<resource string>>")
    rows = bundles.withColumn("__b", parsed).filter("__b.resourceType = 'Bundle'")
    return rows.withColumn("__e", F.explode("__b.entry")).withColumn("resource", F.col("__e.resource")).filter("resource is not null").drop("__b", "__e", bundle_col)


_NONE = "cast(array() as array<string>)"
_CODINGS = "array<struct<system:string,code:string>>"


def parsed(resources: DataFrame, col: str = "resource") -> DataFrame:
    """resources with ``__v``, each as a VARIANT (null where it is no JSON): the one parse of a row. All paths are read from its binary form."""
    return resources.withColumn("__v", F.try_parse_json(col))


def path(name: str, kind: str = "string") -> Column:
    """What a path of the parsed resource holds; null where it is missing or of another kind."""
    return F.try_variant_get("__v", f"$.{name}", kind)


def field(name: str) -> Column:
    """A field as text; null where it is missing or empty (an empty text, list or object, false or zero)."""
    got = path(name)
    return F.when(~F.trim(got).isin("", "[]", "{}", "false", "0"), got)


def _errors(tests: list[tuple[Column, Column | str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for t, m in tests]))


def _table(values: dict[str, list[str]], key: Column) -> Column:
    """The list of a key in a fixed table, empty for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), key), F.expr(_NONE))


def with_present(rows: DataFrame, *tables: dict[str, list[str]]) -> DataFrame:
    """rows with ``__present``: which of the tables' fields the parsed resource has. Each field is looked up once, whatever the number of rules on it."""
    names = sorted({f for t in tables for fields in t.values() for f in fields})
    return rows.withColumn("__present", F.array_compact(F.array(*[F.when(field(n).isNotNull(), F.lit(n)) for n in names])))


def missing_fields(kind: Column, required: dict[str, list[str]], message) -> Column:
    """Messages of the required fields that the resource's type lacks."""
    return F.transform(F.filter(_table(required, kind), lambda f: ~F.array_contains("__present", f)), message)


def check_structure(resources: DataFrame, col: str = "resource") -> DataFrame:
    """resources with structure_errors: type and id, and the fields of four types. What is no JSON has no type."""
    rows = with_present(parsed(resources, col), rules.FHIR_STRUCTURE).withColumn("__kind", path("resourceType")).withColumn("__id", path("id"))
    kind = F.col("__kind")
    missing = missing_fields(kind, rules.FHIR_STRUCTURE, lambda f: F.concat(F.lit("Missing required field for "), kind, F.lit(": "), f))
    rest = F.concat(_errors([(F.col("__id").isNull(), "Missing resource id")]), missing)
    return rows.withColumn("structure_errors", F.when(kind.isNull(), F.array(F.lit("Missing resourceType"))).otherwise(rest)).drop("__v", "__present", "__kind", "__id")


def validate(resources: DataFrame, col: str = "resource") -> DataFrame:
    """resources with resource_type, resource_id, errors, warnings and is_valid: fields, status, codes, values and dates by type.

    A text that is no JSON is of the type Unknown, for which no rule holds. A part of another kind than expected (a text where a list should be) counts
    as missing; the rest is still checked.
    """
    read = {
        "kind": F.coalesce(path("resourceType"), F.lit("Unknown")), "id": F.coalesce(path("id"), F.lit("no-id")), "status": field("status"), "when": field("effectiveDateTime"), "birth": field("birthDate"),
        "codings": F.coalesce(path("code.coding", _CODINGS), F.expr(f"cast(array() as {_CODINGS})")), "drugs": path("medicationCodeableConcept.coding", _CODINGS),
        "categories": path("category", "array<struct<coding:array<struct<code:string>>>>"), "identifiers": path("identifier", "array<struct<type:struct<coding:array<struct<code:string>>>>>"), "names": path("name", "array<struct<family:string>>"),
    }
    own = ["effectivePeriod", "valueQuantity", "valueString", "valueCodeableConcept", "dosageInstruction"]
    rows = with_present(parsed(resources, col), rules.FHIR_REQUIRED, {"": own}).withColumns({f"__{k}": c for k, c in read.items()})
    kind, status, when, birth, codings = (F.col(f"__{k}") for k in ("kind", "status", "when", "birth", "codings"))
    lacks = lambda *names: ~F.arrays_overlap("__present", F.array(*map(F.lit, names)))
    obs, pat, med, con = (kind == t for t in ("Observation", "Patient", "MedicationRequest", "Condition"))
    only = lambda test, found: F.when(test, found).otherwise(F.expr(_NONE))
    some = lambda items, of: F.coalesce(F.exists(items, of), F.lit(False))
    loinc = F.filter(codings, lambda c: c["system"] == "http://loinc.org")
    known = F.array(*[F.lit(code) for code, _ in rules.LOINC.values()])
    code = lambda c: F.coalesce(c["code"], F.lit(""))
    unknown = F.transform(F.filter(loinc, lambda c: ~F.array_contains(known, code(c))), lambda c: F.concat(F.lit("LOINC code '"), code(c), F.lit("' not in the registry")))
    vital = some("__categories", lambda c: some(c["coding"], lambda x: x["code"] == "vital-signs"))
    date = r"^\d{4}(-\d{2}(-\d{2})?)?$"
    bad_icd = F.filter(codings, lambda c: F.lower(c["system"]).contains("icd") & (F.length(c["code"]) > 0) & ~c["code"].rlike(r"^[A-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"))
    nameless = F.filter(F.coalesce(F.col("__names"), F.expr("cast(array() as array<struct<family:string>>)")), lambda n: F.coalesce(n["family"], F.lit("")) == "")
    allowed = _table(rules.FHIR_STATUSES, kind)
    errors = F.concat(
        missing_fields(kind, rules.FHIR_REQUIRED, lambda f: F.concat(F.lit("Missing required field: "), f)),
        _errors([
            ((F.size(allowed) > 0) & status.isNotNull() & ~F.array_contains(allowed, status), F.concat(F.lit("Invalid status '"), status, F.lit("' for "), kind)),
            (obs & vital & lacks("valueQuantity", "valueString", "valueCodeableConcept"), "Vital sign Observation must have a value"),
            (obs & when.isNull() & lacks("effectivePeriod"), "Observation must have effectiveDateTime or effectivePeriod"),
            (obs & when.isNotNull() & ~F.substring(when, 1, 10).rlike(date), F.concat(F.lit("effectiveDateTime format invalid: "), when)),
        ]),
        only(pat, F.transform(nameless, lambda n: F.lit("Patient name missing family (last name)"))),
        _errors([(pat & birth.isNotNull() & ~birth.rlike(date), F.concat(F.lit("birthDate format invalid: "), birth, F.lit(" (expected YYYY-MM-DD)")))]),
        only(con, F.transform(bad_icd, lambda c: F.concat(F.lit("ICD-10 code format invalid: '"), c["code"], F.lit("' (expected A00.0 format)")))),
    )
    mrn = some("__identifiers", lambda i: F.get(i["type"]["coding"], F.lit(0))["code"] == "MR")
    warnings = F.concat(
        _errors([(obs & (F.size(loinc) == 0), "Observation has no LOINC coding")]), only(obs, unknown),
        _errors([
            (pat & ~mrn, "Patient has no MRN identifier (code=MR)"), (med & ~some("__drugs", lambda c: F.lower(c["system"]).contains("rxnorm")), "MedicationRequest has no RxNorm coding"),
            (med & lacks("dosageInstruction"), "MedicationRequest missing dosageInstruction"),
        ]),
    )
    out = rows.withColumn("resource_type", kind).withColumn("resource_id", F.col("__id")).withColumn("errors", errors).withColumn("warnings", warnings)
    return out.withColumn("is_valid", F.size("errors") == 0).drop("__v", "__present", *[f"__{k}" for k in read])


def bundle_counts(validated: DataFrame, bundle_id: str) -> DataFrame:
    """Valid and all resources of each bundle."""
    return validated.groupBy(bundle_id).agg(F.count_if("is_valid").alias("valid"), F.count(F.lit(1)).alias("total"))


def coding(system: str, code: Column, display: Column) -> Column:
    """A CodeableConcept of one coding."""
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"), display.alias("display"))).alias("coding"), display.alias("text"))


def _given(c: Column | str) -> Column:
    """The value, null where it is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > 0, c)


def parsed_date(text: Column) -> Column:
    """The first of four forms that reads: 2024-01-31, 01/31/2024, 20240131, 31/01/2024."""
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))).cast("date") for p, f in forms])


def normalize_patient(raw: DataFrame) -> DataFrame:
    """raw (mrn, last_name, first_name, middle_name, date_of_birth, gender, phone, email, address_line1, city, state, zip) with patient, errors, warnings, success, quality."""
    dob, born = _given("date_of_birth"), parsed_date(F.col("date_of_birth"))
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.GENDERS.items() for x in kv]), F.upper(F.coalesce("gender", F.lit(""))))
    gender = F.coalesce(mapped, F.lit("unknown"))
    errors = _errors([
        (_given("mrn").isNull(), "Missing required field: MRN"), (_given("last_name").isNull(), "Missing required field: last_name"),
        (dob.isNull(), "Missing required field: date_of_birth"), (dob.isNotNull() & born.isNull(), F.concat(F.lit("Cannot parse date_of_birth: "), dob)),
    ])
    warnings = _errors([(gender == "unknown", "Gender unknown or not mapped")])
    telecom = F.array_compact(F.array(F.when(_given("phone").isNotNull(), F.struct(F.lit("phone").alias("system"), F.col("phone").alias("value"))), F.when(_given("email").isNotNull(), F.struct(F.lit("email").alias("system"), F.col("email").alias("value")))))
    address = F.array_compact(F.array(F.when(_given("address_line1").isNotNull(), F.struct(F.lit("home").alias("use"), F.array("address_line1").alias("line"), F.coalesce("city", F.lit("")).alias("city"), F.coalesce("state", F.lit("")).alias("state"), F.coalesce("zip", F.lit("")).alias("postalCode"), F.lit("US").alias("country")))))
    name = F.array_compact(F.array(F.when(_given("last_name").isNotNull(), F.struct(F.upper(F.trim("last_name")).alias("family"), F.array_compact(F.array(F.trim(_given("first_name")), F.trim(_given("middle_name")))).alias("given")))))
    identifier = F.array_compact(F.array(F.when(_given("mrn").isNotNull(), F.struct(coding("v2-0203", F.lit("MR"), F.lit("Medical Record Number")).alias("type"), F.col("mrn").alias("value")))))
    patient = F.struct(F.lit("Patient").alias("resourceType"), identifier.alias("identifier"), name.alias("name"), gender.alias("gender"), F.date_format(born, "yyyy-MM-dd").alias("birthDate"), telecom.alias("telecom"), address.alias("address"))
    out = raw.withColumn("patient", patient).withColumn("errors", errors).withColumn("warnings", warnings).withColumn("success", F.size("errors") == 0)
    return out.withColumn("quality", patient_quality(F.col("patient"), F.col("errors"), F.col("warnings")))


def patient_quality(patient: Column, errors: Column, warnings: Column) -> Column:
    """.30 completeness of six fields, .25 timeliness (new: 1), .25 consistency, .20 validity; .20 where there are errors."""
    full = sum(((F.size(patient[c]) > 0).cast("int") for c in ("name", "identifier", "telecom", "address")), F.lit(0)) + patient["birthDate"].isNotNull().cast("int") + patient["gender"].isNotNull().cast("int")
    n = F.size(warnings)
    score = 0.30 * full / 6 + 0.25 + 0.25 * F.greatest(F.lit(0.0), 1 - 0.15 * n) + 0.20 * F.when(n == 0, 0.90).otherwise(0.70)
    return F.when(F.size(errors) > 0, F.lit(0.20)).otherwise(F.round(F.least(F.lit(1.0), score), 4))


def normalize_observation(readings: DataFrame) -> DataFrame:
    """readings (patient_id, parameter, value, unit, time) with code, status, interpretation, errors, warnings and quality."""
    of = lambda values, i: F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("parameter"))
    limits = {k: [float(x) if x is not None else None for x in v] for k, v in rules.FHIR_RANGES.items()}
    code = of({k: rules.LOINC[k] for k in rules.FHIR_PARAMETERS}, 0)
    low, high, least, most = (of(limits, i).cast("double") for i in range(4))
    v = F.col("value")
    outside = code.isNotNull() & ((v < low) | (v > high))
    near_low = least + F.coalesce(most, 0 - least) * 0.1  # the published form of the rule
    level = F.when(v < least, "LL").when(v > most, "HH").when(v < near_low, "L").when(v > most * 0.9, "H")
    out = readings.withColumn("code", F.coalesce(code, F.lit("UNKNOWN"))).withColumn("status", F.when(outside, "entered-in-error").otherwise("final"))
    out = out.withColumn("interpretation", F.when(code.isNotNull(), level)).withColumn("errors", _errors([(code.isNull(), F.concat(F.lit("Unknown vital type: "), F.col("parameter")))]))
    out = out.withColumn("warnings", _errors([(outside, "outside the possible range")]))
    return out.withColumn("quality", F.when(F.size("errors") > 0, 0.20).when(F.size("warnings") > 0, 0.70).otherwise(0.95))


def normalize_medication(orders: DataFrame) -> DataFrame:
    """orders (patient_id, encounter_id, drug, rxnorm, dose, dose_unit, frequency, route) with request, warnings and quality."""
    rx = _given("rxnorm")
    text = F.concat_ws(" ", F.col("dose").cast("string"), "dose_unit", "frequency", "route")
    request = F.struct(
        F.lit("MedicationRequest").alias("resourceType"), F.lit("active").alias("status"), F.lit("order").alias("intent"), coding("rxnorm", F.coalesce(rx, F.lit("UNKNOWN")), F.col("drug")).alias("medicationCodeableConcept"),
        F.struct(F.concat(F.lit("Patient/"), F.col("patient_id")).alias("reference")).alias("subject"), F.struct(F.concat(F.lit("Encounter/"), F.col("encounter_id")).alias("reference")).alias("encounter"),
        F.array(F.struct(text.alias("text"))).alias("dosageInstruction"),
    )
    out = orders.withColumn("request", request).withColumn("warnings", _errors([(rx.isNull(), F.concat(F.lit("No RxNorm code for "), F.col("drug")))]))
    return out.withColumn("quality", F.when(rx.isNull(), 0.70).otherwise(0.90))


def record_quality(rows: DataFrame, required: list[str]) -> DataFrame:
    """rows with completeness (share of required fields that are filled) and its part of the quality, .30."""
    full = sum((_given(F.col(c).cast("string")).isNotNull().cast("int") for c in required), F.lit(0))
    return rows.withColumn("completeness", full / len(required))


def deidentify_patient(patients: DataFrame, salt: bytes, patient_col: str = "patient", seed: str = "patient_id") -> DataFrame:
    """patients with deidentified: pseudonyms for id, identifiers and name, birth year only, no telecom, address by state and three digits."""
    p, who = F.col(patient_col), F.col(seed).cast("string")
    year = F.nullif(F.regexp_extract(p["birthDate"], r"((?:19|20)\d{2})", 1), F.lit(""))
    made = F.struct(
        F.lit("Patient").alias("resourceType"), privacy.pseudonym(F.concat(F.coalesce(p["id"], F.lit("")), F.lit("__"), who), "PAT", salt).alias("id"),
        F.transform(p["identifier"], lambda i: F.struct(privacy.pseudonym(F.coalesce(i["value"], F.lit("")), "MRN", salt).alias("value"))).alias("identifier"),
        F.array(F.struct(F.lit("anonymous").alias("use"), privacy.pseudonym(who, "NAME", salt).alias("text"))).alias("name"), p["gender"].alias("gender"), year.alias("birthDate"),
        F.transform(p["address"], lambda a: F.struct(a["state"].alias("state"), privacy.generalize_zip(F.coalesce(a["postalCode"], F.lit(""))).alias("postalCode"))).alias("address"),
    )
    return patients.withColumn("deidentified", made)


def code_registry() -> Column:
    """The registry as a map from code to parameter and category."""
    return F.create_map(*[x for k, (code, _) in rules.LOINC.items() for x in (F.lit(code), F.struct(F.lit(k).alias("parameter"), F.lit("vital-signs" if k in rules.VITAL_SIGNS else "laboratory").alias("category")))])


def with_parameter(coded: DataFrame, code: str = "code") -> DataFrame:
    """coded with parameter and category out of its code; null for codes that the registry lacks."""
    found = F.try_element_at(code_registry(), F.col(code))
    return coded.withColumn("parameter", found["parameter"]).withColumn("category", found["category"])


def registry_gaps(registry: DataFrame) -> DataFrame:
    """registry (parameter, code, display, unit) with issues and complete: a missing code or display counts, a missing unit is only named."""
    issues = _errors([(_given(c).isNull(), f"missing {c}") for c in ("code", "display", "unit")])
    return registry.withColumn("issues", issues).withColumn("complete", _given("code").isNotNull() & _given("display").isNotNull())
