"""Early-warning scores as column expressions. A missing vital scores nothing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions import rules


def banded(value: Column, bands: list[tuple]) -> Column:
    """Points of the first band whose upper bound holds the value."""
    out = None
    for upper, points in bands:
        if upper is None:
            out = out.otherwise(points)
        else:
            out = F.when(value <= upper, points) if out is None else out.when(value <= upper, points)
    return F.when(value.isNotNull(), out).otherwise(0)


def gapped(value: Column, bands: list[tuple], rest: int) -> Column:
    """Points of the band that contains the value; values between bands get ``rest``."""
    out = None
    for low, high, points in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        out = F.when(inside, points) if out is None else out.when(inside, points)
    return F.when(value.isNotNull(), out.otherwise(rest)).otherwise(0)


def news2(vitals: Mapping[str, Column]) -> Column:
    return sum((banded(vitals[p], bands) for p, bands in rules.NEWS2.items()), F.lit(0))


def news2_gap(vitals: Mapping[str, Column]) -> Column:
    return sum((gapped(vitals[p], *bands) for p, bands in rules.NEWS2_GAP.items()), F.lit(0))


def mews(vitals: Mapping[str, Column]) -> Column:
    return sum((gapped(vitals[p], *bands) for p, bands in rules.MEWS.items()), F.lit(0))


def sofa(vitals: Mapping[str, Column], gfr: Column | None = None) -> Column:
    """From saturation (98 if missing), systolic pressure and, if given, filtration rate."""
    spo2, sbp = F.coalesce(vitals["spo2_pulse_ox"], F.lit(98.0)), vitals["bp_systolic"]
    out = F.when(spo2 < 90, 3).when(spo2 < 93, 2).when(spo2 < 96, 1).otherwise(0) + F.when(sbp < 90, 2).otherwise(0)
    if gfr is not None:
        out = out + F.when(gfr < 15, 4).when(gfr < 30, 3).when(gfr < 60, 2).when(gfr < 90, 1).otherwise(0)
    return out


def sofa_agents(vitals: Mapping[str, Column], drugs: Column, by_map: bool = False) -> Column:
    """The variants of the agents: from saturation, pressure (systolic under 90, or mean under 70 with ``by_map``) and whether a drug of the list (array of names) raises the pressure."""
    spo2 = F.coalesce(vitals["spo2_pulse_ox"], F.lit(98.0))
    pressure = F.when(vitals["bp_mean"] < 70, 1) if by_map else F.when(vitals["bp_systolic"] < 90, 2)
    raised = F.exists(drugs, lambda d: F.lower(d).rlike("|".join(rules.VASOPRESSORS)))
    return F.when(spo2 < 90, 3).when(spo2 < 93, 2).when(spo2 < 96, 1).otherwise(0) + pressure.otherwise(0) + F.when(raised, 2).otherwise(0)


def additive_risk(model: tuple, inputs: Mapping[str, Column]) -> Column:
    """base plus the first rule that holds in each group, kept in .01 to .99 and rounded to nine places, so that sums meet thresholds exactly."""
    base, groups = model
    total = F.lit(base)
    for group in groups:
        part = None
        for name, op, threshold, points in group:
            test = inputs[name] > threshold if op == ">" else inputs[name] < threshold
            part = F.when(test, points) if part is None else part.when(test, points)
        total = total + part.otherwise(0.0)
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), total)), 9)


def risk_level(news: Column, sofa_score: Column, deterioration: Column | None = None, sepsis: Column | None = None, mortality: Column | None = None) -> Column:
    over = lambda c, t: F.coalesce(c > t, F.lit(False)) if c is not None else F.lit(False)
    return (
        F.when((news >= 7) | over(mortality, 0.60) | (sofa_score >= 8), "CRITICAL")
        .when((news >= 5) | over(deterioration, 0.70) | over(sepsis, 0.50), "HIGH")
        .when(news >= 3, "MEDIUM").otherwise("LOW")
    )


# The same expressions as SQL text, for the oracles.
def banded_sql(value: str, bands: list[tuple]) -> str:
    cases = " ".join(f"WHEN {value} <= {u} THEN {p}" if u is not None else f"ELSE {p}" for u, p in bands)
    return f"(CASE WHEN {value} IS NULL THEN 0 ELSE (CASE {cases} END) END)"


def gapped_sql(value: str, bands: list[tuple], rest: int) -> str:
    cases = " ".join(f"WHEN {' AND '.join([f'{value} >= {a}'] * (a is not None) + [f'{value} <= {b}'] * (b is not None))} THEN {p}" for a, b, p in bands)
    return f"(CASE WHEN {value} IS NULL THEN 0 ELSE (CASE {cases} ELSE {rest} END) END)"


def additive_sql(model: tuple, inputs: Mapping[str, str]) -> str:
    base, groups = model
    parts = [f"(CASE {' '.join(f'WHEN {inputs[n]} {op} {t} THEN {p}::DOUBLE' for n, op, t, p in g)} ELSE 0::DOUBLE END)" for g in groups]
    return f"round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, {base}::DOUBLE + {' + '.join(parts)})), 9)"
