"""Model outputs as text: reading, validation and safe correction; sections and notes written from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import rules

#: Fields of an output by kind; lists are read element by element, so a part of a wrong kind is missing alone.
TEXTS = ["patient_state_summary", "risk_level", "risk_justification", "overall_confidence", "human_review_reason"]
DIFFERENTIAL = {"condition": "string", "supporting_evidence": "array<string>", "probability_rank": "string", "confidence": "double"}
ACTION = {"action": "string", "urgency": "string", "rationale": "string"}


def unfenced(text: Column) -> Column:
    """Text without code fences at its ends."""
    out = F.trim(text)
    for pattern in ("^```json", "^```", "```$"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def object_of(rows: DataFrame, raw: Column, name: str) -> DataFrame:
    """rows with the JSON object in a text as a map from its keys to VARIANTs: all of the text without fences, else what stands from the first to the last brace.

    Null where neither reads. The second parse is only made where the first gives no object.
    """
    keyed = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    rows = rows.withColumn("__clean", unfenced(raw)).withColumn("__first", keyed(F.col("__clean")))
    inner = keyed(F.regexp_extract("__clean", r"(?s)(\{.*\})", 1))
    return rows.withColumn(name, F.when(F.col("__first").isNotNull(), F.col("__first")).otherwise(inner)).drop("__clean", "__first")


def _errors(*tests: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for t, m in tests]))


def validate_outputs(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """rows with output (typed, corrected), errors and valid.

    Missing fields come first and alone. High risk always needs human review: where it is not asked for, that is an
    error and is put right. A text without a JSON object has the error ``unreadable``.
    """
    rows = object_of(rows, F.col(raw_col), "__j")
    of = lambda v, kind: F.try_variant_get(v, "$", kind)
    get = lambda f, kind: of(F.try_element_at("__j", F.lit(f)), kind)
    items = lambda f, fields: F.transform(get(f, "array<variant>"), lambda x: F.struct(*[F.try_variant_get(x, f"$.{n}", k).alias(n) for n, k in fields.items()]))
    read = {f: get(f, "string") for f in TEXTS} | {
        "human_review_required": get("human_review_required", "boolean"), "data_gaps": get("data_gaps", "array<string>"),
        "differential_diagnoses": items("differential_diagnoses", DIFFERENTIAL), "recommended_actions": items("recommended_actions", ACTION),
    }
    rows = rows.withColumns({f"__o_{f}": c for f, c in read.items()})
    o = lambda f: F.col(f"__o_{f}")
    missing = F.transform(F.array_except(F.array(*[F.lit(f) for f in sorted(rules.OUTPUT_FIELDS)]), F.map_keys("__j")), lambda f: F.concat(F.lit("Missing required field: "), f))
    high = F.coalesce(o("risk_level").isin("HIGH", "CRITICAL"), F.lit(False))
    review = F.coalesce(o("human_review_required"), F.lit(False))
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    none = F.array().cast("array<string>")

    def each(items: Column, of) -> Column:
        return F.coalesce(F.flatten(F.transform(items, of)), none)

    def differential(d: Column, i: Column) -> Column:
        name = F.concat(F.lit("differential["), i.cast("string"), F.lit("]"))
        return _errors(
            (empty(d["condition"]), F.concat(name, F.lit(" missing condition"))), (F.coalesce(F.size(d["supporting_evidence"]), F.lit(0)) < 1, F.concat(F.lit("GUARDRAIL: "), name, F.lit(" has no supporting_evidence"))),
            (~F.coalesce(d["probability_rank"], F.lit("")).isin(rules.OUTPUT_RANK), F.concat(name, F.lit(" invalid probability_rank"))), (~d["confidence"].between(0.0, 1.0), F.concat(name, F.lit(" confidence out of range"))),
        )

    def action(a: Column, i: Column) -> Column:
        name = F.concat(F.lit("action["), i.cast("string"), F.lit("]"))
        return _errors(
            (empty(a["action"]), F.concat(name, F.lit(" missing action field"))), (empty(a["rationale"]), F.concat(F.lit("GUARDRAIL: "), name, F.lit(" missing rationale"))),
            (~F.coalesce(a["urgency"], F.lit("")).isin(rules.OUTPUT_URGENCY), F.concat(name, F.lit(" invalid urgency"))),
        )

    words = F.size(F.filter(F.split(F.trim(F.coalesce(o("patient_state_summary"), F.lit(""))), r"\s+"), lambda w: F.length(w) > 0))
    found = F.concat(
        _errors(
            (~F.coalesce(o("risk_level"), F.lit("")).isin(rules.OUTPUT_RISK), F.concat(F.lit("Invalid risk_level: "), F.coalesce(o("risk_level"), F.lit("None")))),
            (~F.coalesce(o("overall_confidence"), F.lit("")).isin(rules.OUTPUT_CONFIDENCE), F.concat(F.lit("Invalid overall_confidence: "), F.coalesce(o("overall_confidence"), F.lit("None")))),
            (high & ~review, "GUARDRAIL: HIGH/CRITICAL risk but human_review_required=False"),
        ),
        each(o("differential_diagnoses"), differential), each(o("recommended_actions"), action), _errors((words < 15, F.format_string("patient_state_summary too short (%d words, min 15)", words))),
    )
    errors = F.when(F.col("__j").isNull(), F.array(F.lit("unreadable"))).when(F.size(missing) > 0, missing).otherwise(found)
    rows = rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    reason = F.when(high & empty(o("human_review_reason")), F.concat(o("risk_level"), F.lit(" risk: physician review required"))).otherwise(o("human_review_reason"))
    summary = F.when(empty(o("patient_state_summary")), "Clinical summary unavailable. Physician review required.").otherwise(o("patient_state_summary"))
    gaps = F.coalesce(o("data_gaps"), F.array(F.lit("Model output incomplete")))
    gaps = F.when(F.col("valid"), gaps).otherwise(F.concat(gaps, F.array(F.lit("Output corrected after validation errors"))))
    put = {"human_review_required": high | review, "human_review_reason": reason, "patient_state_summary": summary, "data_gaps": gaps}
    fixed = F.struct(*[put.get(f, o(f)).alias(f) for f in read])
    return rows.withColumn("output", F.when(F.col("__j").isNotNull(), fixed)).drop("__j", *[f"__o_{f}" for f in read])


def first_valid(attempts: DataFrame, key: str, attempt: str = "attempt", most: int = 3) -> DataFrame:
    """Of up to ``most`` attempts of each key the first valid one, else the last readable one, corrected; status reasoning_failed where none reads."""
    rows = validate_outputs(attempts.filter(F.col(attempt) < most))
    ok, last = F.when(F.col("valid"), F.col(attempt)), F.when(F.col("output").isNotNull(), F.col(attempt))
    pick = rows.groupBy(key).agg(F.min(ok).alias("ok"), F.max(last).alias("last")).withColumn("chosen", F.coalesce("ok", "last"))
    chosen = rows.join(pick, key).filter(F.col(attempt) == F.col("chosen")).select(key, F.col(attempt).alias("retries"), "output", "errors")
    return pick.select(key).join(chosen, key, "left").withColumn("status", F.when(F.col("output").isNull(), "reasoning_failed").otherwise("success"))


def section(rows: DataFrame, key: str, line: Column, order: list[Column], most: int) -> DataFrame:
    """One text a key: a line for each of its first ``most`` rows in order."""
    from pyspark.sql import Window

    top = rows.withColumn("__line", line).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n").alias("text"))


def assemble(sections: DataFrame, key: str, budget: int = 52_000) -> DataFrame:
    """sections (key, pos, title, text) as one context a key: in order, a section that does not fit the tokens left is passed over.

    Sections of a key are few (a fixed list), so they are folded in one row. A token is four characters.
    """
    item = F.struct("pos", "title", "text", F.floor(F.length("text") / 4).alias("tokens"))
    rows = sections.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("parts"))

    def take(state, x):
        fits = x["tokens"] < state["left"]
        part = F.concat(F.lit("### "), x["title"], F.lit("\n"), x["text"])
        return F.struct(F.when(fits, state["left"] - x["tokens"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"))

    done = F.aggregate("s", start, take)
    return rows.withColumn("d", done).select(key, F.array_join("d.parts", "\n\n").alias("context"), (F.lit(budget) - F.col("d.left")).alias("tokens"))


def soap_note(rows: DataFrame) -> DataFrame:
    """rows (complaint, esi, level, diagnosis, has_diagnosis, has_pharmacy) with note, plan and gaps."""
    plan = F.concat_ws(" | ", F.when(F.col("esi") == 1, "Immediate resuscitation"), F.when(F.col("level").isin("HIGH", "CRITICAL"), "Escalate to physician"), F.lit("Continue monitoring"))
    gaps = _errors((~F.col("has_diagnosis"), "Differential diagnosis not documented"), (~F.col("has_pharmacy"), "Medication reconciliation pending"))
    note = F.format_string("S: %s\nO: ESI %d, risk %s\nA: %s\nP: %s", "complaint", "esi", "level", F.coalesce("diagnosis", F.lit("pending")), plan)
    return rows.withColumn("plan", plan).withColumn("gaps", gaps).withColumn("note", note)


def route_events(events: DataFrame) -> DataFrame:
    """events (event_type) with the agents each goes to, in order; unknown types go to the risk agent only."""
    routes = {
        "admission": ["triage", "risk", "diagnosis", "pharmacist", "documentation", "coordinator", "escalation"], "vitals_update": ["risk", "coordinator", "escalation"],
        "medication_order": ["pharmacist", "coordinator", "escalation"], "diagnosis_request": ["diagnosis", "documentation", "coordinator"],
    }
    table = F.create_map(*[x for k, v in routes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return events.withColumn("agents", F.coalesce(F.try_element_at(table, F.col("event_type")), F.array(F.lit("risk"))))
