"""Predicates of single tables: flags of drugs, allergies and stays, and the work lists that are open at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import rules


def renally_cleared(name: Column) -> Column:
    """Whether a drug's dose depends on the kidneys; a missing name says no."""
    return F.coalesce(F.lower(name).rlike("|".join(rules.RENALLY_CLEARED)), F.lit(False))


def drug_allergy(kind: Column) -> Column:
    return F.coalesce(kind == "drug", F.lit(False))


def life_threatening(severity: Column) -> Column:
    return F.coalesce(severity == "life_threatening", F.lit(False))


def active(status: Column) -> Column:
    return F.coalesce(status == "active", F.lit(False))


def open_lists(as_of: Column) -> dict[str, Column]:
    """The condition of each work list, over the columns of its own table. What a condition reads and is missing leaves the row out, but for an outcome, whose absence is the condition.

    All are plain comparisons with columns or literals, so they reach the scan.
    """
    c, before = F.col, lambda col, hours: F.col(col) < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return {
        "active_encounters": c("status") == "active", "active_medications": c("status") == "active", "coded_medications": c("rxnorm").isNotNull(), "anomalies": c("is_anomaly"),
        "unvalidated_predictions": c("outcome_occurred").isNull() & before("predicted_at", rules.UNVALIDATED_HOURS), "training_feedback": c("valid_for_training"),
        "unlinked_feedback": ~c("outcome_linked") & before("at", rules.UNLINKED_HOURS), "phi_accesses": c("phi"), "denied_accesses": c("outcome") == "denied",
        "pending_reviews": c("status") == "pending", "available_beds": c("status") == "available",
    }


def work_list(name: str, rows: DataFrame, as_of: Column) -> DataFrame:
    """The rows of a table that are on the named list at the given time."""
    return rows.filter(open_lists(as_of)[name])


def by_entry(entries: DataFrame, tasks: int) -> DataFrame:
    """entries (list, id, ..) dealt to tasks by list and id: few repeat within what one task reads, so counting them before they are dealt would hold nearly all of a task's rows."""
    return entries.repartition(tasks, "list", "id")
