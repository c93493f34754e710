"""Reports over services, beds, stays and model passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators import monitoring


def agent_metrics(runs: DataFrame, sla_ms: int = 10_000) -> DataFrame:
    """runs (agent, ms, failed): runs, failures, mean and p95 latency (the element at floor(.95 n)) and runs past the limit, by agent."""
    p95 = monitoring.at_ranks(runs, ["agent"], "ms", {"p95": lambda n: F.least(F.floor(n * 0.95), n - 1)}).select("agent", "p95")
    agg = runs.groupBy("agent").agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), F.avg("ms").alias("avg_ms"), F.count_if(F.col("ms") > sla_ms).alias("breaches"))
    return agg.join(p95, "agent")


def compliance_rates(measures: DataFrame) -> DataFrame:
    """measures (measure, compliant: true, false or unknown): share met among those known."""
    known = F.count_if(F.col("compliant").isNotNull())
    return measures.groupBy("measure").agg(F.count(F.lit(1)).alias("stays"), known.alias("known"), F.count_if("compliant").alias("met")).withColumn("rate", F.when(F.col("known") > 0, F.col("met") / F.col("known")))


def discharge_forecast(stays: DataFrame, ward: str, days_left: Column, horizons: list[int]) -> DataFrame:
    """Stays expected to end within each horizon of days, by ward."""
    counts = [F.count_if(days_left <= h).alias(f"within_{h}d") for h in horizons]
    return stays.groupBy(ward).agg(F.count(F.lit(1)).alias("stays"), *counts)


def executive_summary(monthly: DataFrame, beds: DataFrame, hrrp: DataFrame) -> DataFrame:
    """One row: savings and opportunity of all months, units in surge, mean occupancy, conditions over their benchmark. Inputs are small reports."""
    m = monthly.agg(F.sum("readmission_savings").alias("readmission_savings"), F.sum("los_opportunity").alias("los_opportunity"))
    b = beds.agg(F.count_if("surge").alias("surge_units"), F.avg("occupancy").alias("mean_occupancy"))
    h = hrrp.agg(F.count_if("over").alias("conditions_over"))
    return m.join(F.broadcast(b)).join(F.broadcast(h))  # one row each


def ward_counts(board: DataFrame, ward: Column) -> DataFrame:
    """Patients of each ward by risk level, and how many have any alert-worthy score."""
    level = lambda x: F.count_if(F.col("risk_level") == x).alias(x.lower())
    return board.groupBy(ward.alias("ward")).agg(F.count(F.lit(1)).alias("patients"), level("CRITICAL"), level("HIGH"), level("MEDIUM"), level("LOW"))


def pass_statistics(rows: DataFrame, key: str, value: Column, passes: int = 20, spread: float = 0.005, seed: int = 42) -> DataFrame:
    """Mean and deviation of a value over noisy passes. The noise of a pass is Gaussian with the given deviation (two uniform numbers by Box and Muller) and depends on key and pass only."""
    uniform = lambda s: (F.pmod(F.xxhash64(F.col(key), F.col("pass"), F.lit(s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    noise = F.sqrt(-2 * F.log(uniform(seed))) * F.cos(2 * F.pi() * uniform(seed + 1)) * spread
    noisy = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("__v") + noise))
    many = rows.select(key, value.alias("__v")).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).withColumn("x", noisy)
    return many.groupBy(key).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count(F.lit(1)).alias("passes"))


def dataset_summary(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def bridge(messages: DataFrame, registry: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """messages (device_id, parameter, value) with the patient of the device, an artifact flag and the outgoing key and topic; unknown devices get a pseudonymous patient made from their id."""
    of = lambda i: F.try_element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v[i])))]), F.col("parameter"))
    known = messages.join(registry.select("device_id", "patient_id"), "device_id", "left")
    patient = F.coalesce(F.col("patient_id").cast("string"), F.concat(F.lit("unknown-"), F.substring(F.sha2("device_id", 256), 1, 16)))
    rows = known.withColumn("patient_id", patient).withColumn("artifact", F.coalesce(~F.col("value").between(of(0), of(1)), F.lit(False)) | F.col("value").isNull())
    return rows.withColumn("topic", F.lit("icu.vitals.raw")).withColumn("key", F.col("patient_id"))


def bridge_counters(bridged: DataFrame) -> DataFrame:
    """received, forwarded, artifacts and errors (no value) of a batch."""
    bad = F.col("value").isNull()
    return bridged.agg(F.count(F.lit(1)).alias("received"), F.count_if(~F.col("artifact")).alias("forwarded"), F.count_if(F.col("artifact") & ~bad).alias("artifacts"), F.count_if(bad).alias("errors"))
