"""Drug safety: pair interactions, renal rules and allergy cross-reactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions import rules


def _values(spark, rows: list[tuple], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])))


def drug_interactions(meds: DataFrame) -> DataFrame:
    """Rule pairs both of whose substances occur among an encounter's drugs.

    Drugs are matched against the rule substances before the shuffle, so each encounter is reduced to a short set of
    substances and no pairs of drugs are formed.
    """
    names = sorted({d for a, b, _ in rules.DRUG_PAIRS for d in (a, b)})
    hit = F.array_compact(F.array(*[F.when(F.lower("drug").contains(n), n) for n in names]))
    found = meds.withColumn("hit", F.explode(hit)).groupBy("patient_id", "encounter_id").agg(F.collect_set("hit").alias("hits"))
    both = [F.when(F.array_contains("hits", a) & F.array_contains("hits", b), F.struct(F.lit(a).alias("drug_a"), F.lit(b).alias("drug_b"), F.lit(s).alias("severity"))) for a, b, s in rules.DRUG_PAIRS]
    return found.select("patient_id", "encounter_id", F.inline(F.array_compact(F.array(*both))))


def renal_alerts(meds: DataFrame) -> DataFrame:
    test = None
    for d in rules.RENAL_DRUGS:
        t = F.lower("drug").contains(d)
        test = t if test is None else test | t
    return meds.filter((F.col("gfr") < 30) & test).withColumn("severity", F.when(F.col("gfr") < 15, "CRITICAL").otherwise("WARNING"))


def allergy_alerts(meds: DataFrame) -> DataFrame:
    """Drugs related to a class the patient is allergic to; the class's own name is no related drug."""
    cross = None
    for name, drugs in rules.ALLERGY_CLASSES.items():
        some = F.lit(False)
        for d in drugs:
            some = some | F.lower("drug").contains(d)
        t = F.lower("allergy").contains(name) & some
        cross = t if cross is None else cross | t
    return meds.filter(cross).withColumn("severity", F.lit("CRITICAL"))


def pharmacist(meds: DataFrame) -> DataFrame:
    """Highest alert of each encounter from all three rules, and whether it bypasses review."""
    rank = lambda df: df.select("encounter_id", F.when(F.col("severity") == "CRITICAL", 2).otherwise(1).alias("rank"))
    every = rank(drug_interactions(meds)).unionByName(rank(renal_alerts(meds))).unionByName(rank(allergy_alerts(meds)))
    return every.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.max("rank").alias("rank")).select("encounter_id", "n_alerts", F.when(F.col("rank") == 2, "CRITICAL").otherwise("WARNING").alias("level"), (F.col("rank") == 2).alias("bypass"))
