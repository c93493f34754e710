"""Structured Streaming over vitals: hourly rollup with a watermark, and critical readings without state.

The same functions take a stream or a table. ``replayed`` runs a stream over all files that a path holds, keeps what
each micro-batch emits in the shared folder and returns the last state of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import rules
from wardlight.sources.shared import Workspace


def hourly(vitals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """n, min, max and mean of each patient, parameter and hour; readings more than ``delay`` late are left out."""
    hour = F.window("time", "1 hour")
    timed = vitals.withColumn("time", F.col("time").cast("timestamp"))  # a watermark needs an instant
    rolled = timed.withWatermark("time", delay).groupBy("patient_id", "parameter", hour).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return rolled.select("patient_id", "parameter", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "min", "max", "mean")


def critical(vitals: DataFrame) -> DataFrame:
    """Readings outside the critical limits of their parameter."""
    tests = [(F.col("parameter") == p) & ((F.col("value") < lo if lo is not None else F.lit(False)) | (F.col("value") > hi if hi is not None else F.lit(False))) for p, (lo, hi) in rules.CRITICAL.items()]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return vitals.filter(found)


def replayed(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """What a stream over the files of ``path`` has emitted in the end: the row of the last batch for each key."""
    work = Workspace(spark, "stream")
    root = work.root
    out = transform(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))  # a pattern, as path may be one file

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")  # a repeated batch replaces its own rows

    out.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    work.drop("state")
    emitted = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{root}/out")
    rest = [c for c in out.columns if c not in keys]
    return emitted.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
