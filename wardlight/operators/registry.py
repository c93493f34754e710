"""The patient index: canonical records, links with an audit trail, statistics; loads that pass over what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import privacy


def canonical_records(sources: DataFrame, salt: bytes) -> DataFrame:
    """sources (source_system, mrn, last_name, first_name, middle_name, dob, ssn4, zip, gender) with hashed identity fields and a stable id.

    The id is made from system and record number, so a repeated load makes the same record.
    """
    h = lambda c, p: privacy.field_hash(F.coalesce(F.col(c), F.lit("")), p, salt)
    link = F.concat_ws(":", "source_system", "mrn")
    return sources.select(
        privacy.pseudonym(link, "MPI", salt).alias("global_id"), F.array(link).alias("mrn_list"), F.array("source_system").alias("source_systems"),
        F.concat_ws("|", h("last_name", "LN"), h("first_name", "FN"), h("middle_name", "MN")).alias("name_hash"), "dob", F.when(F.col("ssn4").isNotNull(), h("ssn4", "SSN4")).otherwise("").alias("ssn_hash"),
        "gender", F.when(F.length("zip") >= 3, F.substring("zip", 1, 3)).otherwise("").alias("zip3"),
    )


def link_records(records: DataFrame, links: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(records with their new record numbers and systems, audit entries).

    links: global_id, source_system, mrn, confidence, decision, linked_by, reviewed_by. A link for REVIEW without a
    reviewer, and any BLOCKED or NO_MATCH one, is refused: it stands in the audit as such and changes nothing.
    """
    allowed = (F.col("decision") == "AUTO_LINK") | ((F.col("decision") == "REVIEW") & F.col("reviewed_by").isNotNull())
    audit = links.select("global_id", "source_system", "mrn", "confidence", "decision", "linked_by", "reviewed_by", allowed.alias("linked"), at.alias("at"))
    new = audit.filter("linked").groupBy("global_id").agg(F.collect_set(F.concat_ws(":", "source_system", "mrn")).alias("keys"), F.collect_set("source_system").alias("systems"))
    none = F.array().cast("array<string>")
    joined = records.join(new, "global_id", "left")
    add = lambda have, more: F.array_sort(F.array_union(F.col(have), F.coalesce(F.col(more), none)))
    return joined.withColumn("mrn_list", add("mrn_list", "keys")).withColumn("source_systems", add("source_systems", "systems")).drop("keys", "systems"), audit


def index_statistics(records: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: records, those of several systems, links waiting for review, automatic links, refused ones."""
    r = records.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("source_systems") > 1).alias("multi_source"))
    a = audit.agg(
        F.count_if((F.col("decision") == "REVIEW") & F.col("reviewed_by").isNull()).alias("pending_review"), F.count_if((F.col("decision") == "AUTO_LINK") & F.col("linked")).alias("auto_linked"),
        F.count_if(F.col("decision").isin("BLOCKED", "NO_MATCH")).alias("conflicts"),
    )
    return r.join(F.broadcast(a))  # one row each


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: the first of each key, without keys that the target has."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def ranked_matches(scored: DataFrame, least: float = 0.50) -> DataFrame:
    """Candidates of each record above ``least``, best first; ties to the smaller id."""
    w = Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b")
    return scored.filter(F.col("score") > least).withColumn("rank", F.row_number().over(w))
