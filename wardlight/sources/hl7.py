"""HL7 v2 messages: observations out of OBX segments with built-in functions, and messages made of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Observation status codes.
STATUS = {"F": "final", "P": "preliminary", "C": "amended", "X": "cancelled"}


def _field(segment: Column, i: int) -> Column:
    return F.coalesce(F.get(segment, F.lit(i)), F.lit(""))


def _part(field: Column, i: int) -> Column:
    """Component i of a field; the separator is the message's own, in column ``sep``."""
    return F.coalesce(F.get(F.split(field, F.concat(F.lit(r"\Q"), F.col("sep"), F.lit(r"\E"))), F.lit(i)), F.lit(""))


def segments(messages: DataFrame, message_col: str = "message") -> DataFrame:
    """messages plus ``segments``, an array of field arrays, and ``sep``, the component separator (the character after MSH and the field
    separator). A text without MSH at its start (or null) has no segments."""
    text = F.regexp_replace(F.trim(F.col(message_col)), "\r\n|\n", "\r")
    lines = F.filter(F.split(text, "\r"), lambda x: F.length(F.trim(x)) > 0)
    between = F.concat(F.lit(r"\Q"), F.substring(text, 4, 1), F.lit(r"\E"))
    split = F.when(text.startswith("MSH"), F.transform(lines, lambda x: F.split(x, between)))
    return messages.withColumn("segments", split).withColumn("sep", F.when(F.length(F.substring(text, 5, 1)) > 0, F.substring(text, 5, 1)).otherwise("^"))


def patients(messages: DataFrame, message_col: str = "message") -> DataFrame:
    """Demographics of each message that has a PID segment, with its type (MSH-9) and control id (MSH-10); MSH counts its separator as a field."""
    split = segments(messages, message_col).filter("segments is not null")
    first = lambda name: F.get(F.filter("segments", lambda s: s[0] == name), F.lit(0))
    rows = split.withColumn("pid", first("PID")).withColumn("msh", first("MSH")).filter("pid is not null")
    f = lambda i: _field(F.col("pid"), i)
    born, sex, ssn = f(7), F.upper(f(8)), f(19)
    return rows.select(
        _field(F.col("msh"), 8).alias("message_type"), _field(F.col("msh"), 9).alias("message_id"), _part(f(3), 0).alias("mrn"), _part(f(5), 0).alias("last_name"), _part(f(5), 1).alias("first_name"), _part(f(5), 2).alias("middle_name"),
        F.when(F.length(born) >= 8, F.concat_ws("-", F.substring(born, 1, 4), F.substring(born, 5, 2), F.substring(born, 7, 2))).alias("date_of_birth"), F.when(sex.isin("M", "F", "O", "U"), sex).otherwise("U").alias("gender"),
        F.when(F.length(ssn) >= 4, F.substring(ssn, -4, 4)).otherwise("").alias("ssn_last4"), _part(f(11), 0).alias("address_line1"), _part(f(11), 2).alias("city"), _part(f(11), 3).alias("state"), _part(f(11), 4).alias("zip_code"),
    )


def observations(messages: DataFrame, message_col: str = "message", as_of: Column | None = None) -> DataFrame:
    """One row an OBX segment, with the record number (PID-3) of its message; numbers may hold thousands commas. An unreadable time is as_of."""
    split = segments(messages, message_col).filter("segments is not null")
    pid = F.get(F.filter("segments", lambda s: s[0] == "PID"), F.lit(0))
    rows = split.select("sep", _part(_field(pid, 3), 0).alias("mrn"), F.explode(F.filter("segments", lambda s: s[0] == "OBX")).alias("obx"))
    at, raw, status = _field(F.col("obx"), 14), _field(F.col("obx"), 5), _field(F.col("obx"), 11)
    day = F.concat_ws("-", F.substring(at, 1, 4), F.substring(at, 5, 2), F.substring(at, 7, 2))
    clock = F.concat_ws(":", F.substring(at, 9, 2), F.substring(at, 11, 2), F.substring(at, 13, 2))
    when = F.when(F.length(at) >= 14, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(F.length(at) >= 8, F.concat(day, F.lit("T00:00:00Z")))
    when = when if as_of is None else F.coalesce(when, F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return rows.select(
        "mrn", _part(_field(F.col("obx"), 3), 0).alias("loinc_code"), _part(_field(F.col("obx"), 3), 1).alias("loinc_display"),
        raw.alias("value_raw"), F.regexp_replace(raw, ",", "").try_cast("double").alias("value_numeric"), _part(_field(F.col("obx"), 6), 0).alias("units"),
        _field(F.col("obx"), 7).alias("reference_range"), _field(F.col("obx"), 8).alias("abnormal_flag"),
        F.coalesce(F.element_at(names, status), F.lit("final")).alias("status"), when.alias("observation_datetime"),
    )


def messages(vitals: DataFrame) -> DataFrame:
    """One message a patient and day, which bounds its length."""
    obx = F.concat_ws("|", F.lit("OBX"), F.col("seq"), F.lit("NM"), F.concat(F.lit("^"), F.col("parameter")), F.lit(""), F.col("value"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit("F"), F.lit(""), F.lit(""), F.date_format("time", "yyyyMMddHHmmss"))
    days = vitals.groupBy("patient_id", F.to_date("time").alias("day")).agg(F.array_join(F.collect_list(obx), "\r").alias("obx"))
    return days.select(F.concat(F.lit("MSH|^~\\&|device\rPID|1||"), F.col("patient_id"), F.lit("\r"), F.col("obx")).alias("message"))
