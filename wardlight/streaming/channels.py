"""Readings as messages of wards, patients and alerts: a stream writes each message once, and a subscriber reads the folders of its channel only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.streaming.ledger import Ledger

#: Folders of each kind of channel in a batch. Channels are dealt to them by hash, so their number does not grow with the patients.
SHARDS = 8
FOLDERS = ["kind", "shard"]


def shard(channel: Column) -> Column:
    return F.pmod(F.xxhash64(channel), F.lit(SHARDS)).cast("int")


def messages(readings: DataFrame) -> DataFrame:
    """kind, shard, channel, type, payload (JSON), at, seq: one row for each reading and channel that takes it.

    readings: patient_id, ward, parameter, value, time, seq, alert (the kind of a critical reading, else null). Each goes to its ward and its patient, a critical one
    also to the alerts of both. A reading without ward or patient is sent to the other alone. Takes a table or a stream; one pass, no shuffle.
    """
    c = F.col
    body = lambda kind: F.to_json(F.struct(F.lit(kind).alias("type"), "patient_id", "ward", "parameter", "value", "time", "alert"))
    send = lambda kind, to, what: F.when(to.isNotNull(), F.struct(F.lit(kind).alias("kind"), to.alias("channel"), F.lit(what).alias("type"), body(what).alias("payload")))
    ward, patient, alert = F.concat(F.lit("ward:"), "ward"), F.concat(F.lit("patient:"), "patient_id"), c("alert").isNotNull()
    sent = F.array_compact(F.array(
        send("ward", ward, "vitals_update"), send("patient", patient, "vital_reading"),
        send("alerts", F.when(alert, F.concat(F.lit("alerts:"), ward)), "vital_critical"), send("alerts", F.when(alert, F.concat(F.lit("alerts:"), patient)), "vital_critical"),
    ))
    rows = readings.select(F.explode(sent).alias("m"), c("time").alias("at"), "seq").select("m.*", "at", "seq")
    return rows.withColumn("shard", shard(c("channel")))


def follow(book: Ledger, schema, channel: str) -> DataFrame:
    """All messages of a channel so far; only the folders that it can be in are read."""
    which = book.spark.range(1).select(shard(F.lit(channel))).first()[0]
    return book.read(schema).filter((F.col("kind") == channel.split(":")[0]) & (F.col("shard") == which) & (F.col("channel") == channel))
