"""A patient's context for a model: one text of sections in order of weight, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _or(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def _mark(flag: str, text: str) -> Column:
    return F.when(F.coalesce(F.col(flag), F.lit(False)), text).otherwise("")


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def vital_line() -> Column:
    """From parameter, value, unit, time, critical, high, low."""
    return _say("- ", _or("parameter", "Unknown"), ": ", _or("value", "N/A"), " ", _or("unit"), " at ", _or("time", "Unknown time"), _mark("critical", " ⚠️ CRITICAL"), _mark("high", " ⬆️ HIGH"), _mark("low", " ⬇️ LOW"))


def drug_line() -> Column:
    """From name, dose, route, frequency."""
    return _say("- ", _or("name", "Unknown"), " ", _or("dose"), " ", _or("route"), " ", _or("frequency"))


def lab_line() -> Column:
    """From test, value, unit, reference, critical, abnormal; a critical value is not called abnormal too."""
    flag = F.when(F.coalesce(F.col("critical"), F.lit(False)), " ⚠️ CRITICAL").otherwise(_mark("abnormal", " * ABNORMAL"))
    return _say("- ", _or("test", "Unknown"), ": ", _or("value", "N/A"), " ", _or("unit"), " (Ref: ", _or("reference", "N/A"), ")", flag)


def image_line() -> Column:
    """From modality, date, summary, finding, urgent; the finding stands in for a missing summary."""
    return _say("- [", _or("modality", "Unknown"), "] ", _or("date"), ": ", F.coalesce("summary", "finding", F.lit("No findings documented")), _mark("urgent", " 🚨 URGENT"))


def note_line() -> Column:
    """From kind, date, summary."""
    return _say("[", _or("kind", "Note"), " — ", _or("date"), "]: ", _or("summary"))


def history_line() -> Column:
    """From date, description."""
    return _say("- [", _or("date"), "] ", _or("description"))


#: name -> (title, line, text where there are no rows, lines at most, what stands between lines, tokens that must be left over). The first three are
#: taken where they fit; the next two where rows exist and more tokens than that are left; history then fills what is left, line by line.
SECTIONS = {
    "vitals": ("CURRENT VITALS (Last 2 Hours)", vital_line, "No recent vitals available.", 20, "\n", None), "medications": ("ACTIVE MEDICATIONS + PROBLEMS", drug_line, "No active medications on record.", None, "\n", None),
    "labs": ("RECENT LABORATORY RESULTS (24h)", lab_line, "No recent laboratory results.", None, "\n", None), "imaging": ("IMAGING FINDINGS", image_line, None, None, "\n", 2000),
    "notes": ("CLINICAL NLP SUMMARY", note_line, None, 5, "\n\n", 2000), "history": ("RELEVANT PATIENT HISTORY", history_line, "No relevant history retrieved.", None, "\n", 1000),
}


def _lines(rows: DataFrame, name: str, key: str, order: list[Column], bound: int) -> DataFrame:
    """One row a key: lines in order with the tokens up to each, and the characters of all lines.

    Only the lines that start within ``bound`` characters are kept, as no text beyond them is ever shown, so a list is bounded by the budget, however long a
    patient's record is; the window before it sorts and spills.
    """
    _, line, _, most, between, _ = SECTIONS[name]
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    said = rows.select(key, line().alias("__line"), F.row_number().over(w).alias("__n"))
    if most:
        said = said.filter(F.col("__n") <= most)
    by_n = Window.partitionBy(key).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("__upto", F.sum(F.floor(F.length("__line") / 4)).over(by_n)).withColumn("__end", F.sum(F.length("__line") + len(between)).over(by_n))
    kept = F.when(F.col("__end") - F.length("__line") - len(between) <= bound, F.struct(F.col("__n").alias("n"), F.col("__upto").alias("upto"), F.col("__line").alias("line")))
    return said.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias(name), (F.max("__end") - len(between)).alias(f"{name}_chars"))


def contexts(patients: DataFrame, tables: dict[str, tuple[DataFrame, list[Column]]], budget: int = 52_000, key: str = "patient_id", complaint: str | None = None) -> DataFrame:
    """key, context, tokens of each row of patients; tables: section name -> (rows with the columns of its line, order of the lines).

    A token is four characters. A list of images or notes longer than what is left is still shown, as far as ``budget`` reaches: what is left then is
    negative and history stays out. Missing tables are empty ones; several rows of one patient give the same context each.
    """
    out = patients
    for name in SECTIONS:
        if name in tables:
            rows, order = tables[name]
            out = out.join(_lines(rows, name, key, order, 4 * budget), key, "left")
        else:
            out = out.withColumns({name: F.lit(None).cast("array<struct<n:int,upto:bigint,line:string>>"), f"{name}_chars": F.lit(None).cast("long")})
    left, parts = F.lit(budget).cast("long"), []
    for name, (title, _, none, _, between, floor) in SECTIONS.items():
        shown, text = F.col(name), F.array_join(F.transform(name, lambda x: x["line"]), between)
        if name == "history":
            shown = F.filter(shown, lambda x: x["upto"] <= F.col("__left"))  # noqa: B023  evaluated at once
            text = F.when(F.size(shown) > 0, F.array_join(F.transform(shown, lambda x: x["line"]), between)).otherwise(none)
            take = F.col(name).isNotNull() & (F.col("__left") > floor)
            tokens = F.floor(F.length(text) / 4)
        else:
            tokens = F.coalesce(F.floor(F.col(f"{name}_chars") / 4), F.lit(len(none or "") // 4).cast("long"))
            text = F.coalesce(text, F.lit(none))
            take = (tokens < F.col("__left")) if floor is None else F.col(name).isNotNull() & (F.col("__left") > floor)
        out = out.withColumn("__left", left)  # so each section reads what the one before has left
        out = out.withColumns({f"__t_{name}": F.when(take, F.concat(F.lit(f"### {title}\n"), text)), "__next": F.col("__left") - F.when(take, tokens).otherwise(0)})
        left = F.col("__next")
        parts.append(F.col(f"__t_{name}"))
    body = F.concat_ws("\n\n", *parts)
    if complaint:
        body = F.concat(F.when(F.length(complaint) > 0, F.concat(F.lit("**Chief Complaint / Reason for Visit**: "), F.col(complaint), F.lit("\n\n"))).otherwise(""), body)
    return out.select(key, body.alias("context"), (F.lit(budget) - F.col("__next")).alias("tokens"))


def user_message(context: Column, findings: dict[str, Column]) -> Column:
    """The whole message to a model: the context, each kind of finding that is there (JSON texts: imaging, nlp, vitals, discordances), and the task."""
    titles = {"imaging": "AI IMAGING ANALYSIS", "nlp": "AI NLP ANALYSIS", "vitals": "AI VITALS PREDICTIONS", "discordances": "⚠️ MODALITY DISCORDANCES (require physician review)"}
    found = [F.when(F.length(findings[k]) > 0, F.concat(F.lit(f"## {t}\n"), findings[k])) for k, t in titles.items() if k in findings]
    return F.concat_ws("\n\n", F.concat(F.lit("## PATIENT DATA\n\n"), context), *found, F.lit("## TASK\nApply the 5-step reasoning protocol. Return valid JSON only."))
