"""Writers: append-only tables without repeated keys, folders by ward, JSON files, a data set with its summary."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wardlight.streaming.ledger import Ledger


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at path does not have, each key once; nothing there is changed."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates(keys)
    try:
        there = spark.read.schema(rows.schema).parquet(path).select(*keys)
    except AnalysisException:  # the first load
        there = None
    (fresh if there is None else fresh.join(there, keys, "left_anti")).select(rows.columns).write.mode("append").parquet(path)


def by_ward(rows: DataFrame, path: str, ward: str) -> None:
    """One folder a ward, for readers that follow one."""
    rows.repartition(ward).write.mode("append").partitionBy(ward).parquet(path)


def as_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_once(rows: DataFrame, book: Ledger, keys: list[str], day: str) -> int:
    """Appends the rows whose keys are not in the ledger's table yet, each key once, and returns the number of the load.

    ``day`` is one of the keys and of the ledger's folders: only the days that the load holds are read again, at most one row a day being broadcast for that. Of
    two loads at a time one takes the next number; the other looks again at what is there now. Of rows with equal keys any one is kept. Nulls in keys are
    equal to each other.
    """
    if day not in keys or day not in book.folders:
        raise ValueError(f"{day} must be a key and a folder of the table")
    fresh, there = rows.dropDuplicates(keys), None
    days = F.broadcast(rows.select(F.col(day).alias("__day")).distinct())
    same = None
    for k in keys:
        one = F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}"))
        same = one if same is None else same & one
    while True:
        done = book.committed()
        load = done[-1] + 1 if done else 0
        if done:
            old = book.read(rows.schema).select(*keys)
            there = old.join(days, F.col(day) == F.col("__day"), "left_semi").unionByName(old.filter(F.col(day).isNull())).alias("old")
        new = fresh if there is None else fresh.alias("new").join(there, same, "left_anti")
        if book.write(new.select(rows.columns), load):
            return load


def bundles(patients: DataFrame, readings: DataFrame, most: int = 100) -> DataFrame:
    """FHIR bundles of each patient: one with the patient, then one for each ``most`` readings of a day, so that none grows with a record.

    patients: patient_id and any columns; readings: patient_id, time, seq, parameter, value. Readings of unknown patients are bundled too.
    """
    known = [c for c in patients.columns if c != "patient_id"]
    first = patients.select("patient_id", F.lit(None).cast("date").alias("day"), F.lit(0).alias("page"), F.array(F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("patient_id").alias("id"), *known))).alias("entry"))
    n = F.row_number().over(Window.partitionBy("patient_id", F.to_date("time")).orderBy("time", "seq"))
    item = F.to_json(F.struct(F.lit("Observation").alias("resourceType"), F.col("seq").alias("id"), F.concat(F.lit("Patient/"), "patient_id").alias("subject"), "parameter", "value", "time"))
    paged = readings.select("patient_id", F.to_date("time").alias("day"), F.floor((n - 1) / most).cast("int").alias("page"), F.struct(n.alias("n"), item.alias("item")).alias("e"))
    rest = paged.groupBy("patient_id", "day", "page").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["item"]).alias("entry"))  # at most ``most``
    return first.unionByName(rest).select("patient_id", "day", "page", F.lit("Bundle").alias("resourceType"), F.size("entry").alias("total"), "entry")


def dataset(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as JSON lines under its name, and ``summary`` (name, rows) beside them; rows are counted while they are written. Returns the summary as read again."""
    spark, counts = next(iter(tables.values())).sparkSession, []
    for name, rows in tables.items():
        seen = Observation(name)
        as_json(rows.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{name}")
        counts.append((name, seen.get["rows"]))
    summary = spark.createDataFrame(counts, "name string, rows long")
    as_json(summary.coalesce(1), f"{path}/summary")
    return spark.read.schema(summary.schema).json(f"{path}/summary")
