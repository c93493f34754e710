"""A patient's baseline as stream state: count, mean, deviation and a mergeable quantile sketch of each parameter.

Readings of a micro-batch are judged by what earlier batches held, then enter the state. The sketch keeps levels of at most SIZE values: a full level is
sorted, every other value goes up with twice the weight. A rank is off by no more than (number of levels) / SIZE of all values, and sketches of
parts merge into one with the same bound. Its size grows with the logarithm of the number of readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlight.functions import rules

SIZE = 256
#: Groups that keys are dealt to, as a state of its own costs a call a key and micro-batch.
GROUPS = 1_024
STATE = "known array<boolean>, patients array<long>, parameters array<string>, n array<long>, mean array<double>, m2 array<double>, turns array<int>, levels array<int>, sizes array<int>, items array<double>"
OUT = "patient_id long, parameter string, seq long, value double, n_before long, z double, severity string, n long, mean double, sd double, p10 double, median double, p90 double"


class Sketch:
    """Values by level; one of level i stands for 2**i values."""

    def __init__(self, levels: list[np.ndarray] | None = None, turns: int = 0):
        self.levels, self.turns = levels or [np.zeros(0)], turns

    def add(self, values: np.ndarray) -> Sketch:
        return self._merged([np.asarray(values, float)])

    def merge(self, other: Sketch) -> Sketch:
        self.turns += other.turns
        return self._merged(other.levels)

    def _merged(self, levels: list[np.ndarray]) -> Sketch:
        while len(self.levels) < len(levels):
            self.levels.append(np.zeros(0))
        for i, more in enumerate(levels):
            self.levels[i] = np.concatenate([self.levels[i], more])
        i = 0
        while i < len(self.levels):
            if len(self.levels[i]) > SIZE:
                full = np.sort(self.levels[i])
                rest, full = full[len(full) - len(full) % 2 :], full[: len(full) - len(full) % 2]
                if i + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                self.levels[i], self.levels[i + 1] = rest, np.concatenate([self.levels[i + 1], full[self.turns % 2 :: 2]])
                self.turns += 1
            i += 1
        return self

    def bound(self) -> float:
        """The share of all values by which a rank may be off."""
        return len(self.levels) / SIZE if len(self.levels) > 1 else 0.0

    def quantiles(self, shares: list[float]) -> list[float]:
        """Values at these shares, between neighbours in proportion (exact while nothing was dropped)."""
        values, weights = np.concatenate(self.levels), np.repeat(2.0 ** np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        middle = np.cumsum(weights) - weights / 2 - 0.5  # the place among all values, from 0
        return np.interp(np.array(shares) * (weights.sum() - 1), middle, values).tolist() if len(values) else [float("nan")] * len(shares)


def judged(readings: DataFrame, least: int = 10) -> DataFrame:
    """Each reading (patient_id, parameter, seq, value) of a stream with n_before, z and severity against the baseline of earlier batches (the population's below ``least`` readings), and the baseline after its batch.

    Readings outside the engine's limits of their parameter, and those of parameters without such limits that have no value, are left out.
    Keys share states; each keeps a baseline of its own.
    """
    population = dict(rules.POPULATION)

    def after(parameter: str | None, x: np.ndarray, held: tuple | None) -> tuple[tuple, dict]:
        """The baseline (n, mean, m2, sketch) with the values of one key of one micro-batch, and what is said of these."""
        n, mean, m2, sketch = held or (0, 0.0, 0.0, Sketch())
        sd = np.sqrt(m2 / n) if n else 0.0
        usual, spread = population.get(parameter, (np.nan, np.nan))[:2]
        z = np.abs(x - (mean if n >= least else usual)) / (sd if n >= least and sd > 0 else spread)
        before, more, delta = n, len(x), x.mean() - mean
        n += more
        mean += delta * more / n
        m2 += ((x - x.mean()) ** 2).sum() + delta**2 * before * more / n
        sketch.add(x)
        p10, median, p90 = sketch.quantiles([0.1, 0.5, 0.9])
        return (n, float(mean), float(m2), sketch), {"n_before": before, "z": z, "n": n, "mean": mean, "sd": np.sqrt(m2 / n), "p10": p10, "median": median, "p90": p90}

    def step(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat([f.drop(columns="dealt") for f in frames], ignore_index=True)  # one group of keys of one micro-batch
        state = {}
        if held.exists:
            *keys, ns, means, m2s, turns, levels, sizes, items = held.get
            parts = iter(np.split(np.array(items, float), np.cumsum(sizes)[:-1]))
            for *key, n, mean, m2, turn, deep in zip(*keys, ns, means, m2s, turns, levels):
                state[tuple(key)] = n, mean, m2, Sketch([next(parts) for _ in range(deep)], turn)
        values, said = batch["value"].to_numpy(float), {c: np.zeros(len(batch)) for c in ("n_before", "z", "n", "mean", "sd", "p10", "median", "p90")}
        for (known, patient, parameter), at in batch.groupby(["known", "patient_id", "parameter"], sort=False, dropna=False).indices.items():
            key = bool(known), int(patient), parameter if isinstance(parameter, str) else None
            state[key], found = after(key[2], values[at], state.get(key))
            for c, v in found.items():
                said[c][at] = v
        sketches = [v[3] for v in state.values()]
        held.update((
            *([k[i] for k in state] for i in range(3)), *([v[i] for v in state.values()] for i in range(3)), [x.turns for x in sketches], [len(x.levels) for x in sketches],
            [len(v) for x in sketches for v in x.levels], np.concatenate([v for x in sketches for v in x.levels]).tolist(),
        ))
        z = said["z"]
        severity = np.select([z >= 4, z >= 3, z >= 2.5, z >= 2], ["critical", "severe", "moderate", "mild"], "usual")
        patients = batch["patient_id"].astype("Int64").where(batch["known"])
        yield pd.DataFrame({"patient_id": patients, "parameter": batch["parameter"], "seq": batch["seq"], "value": values, "n_before": said["n_before"].astype("int64"), "z": z, "severity": severity, "n": said["n"].astype("int64"), **{c: said[c] for c in ("mean", "sd", "p10", "median", "p90")}})

    rows = readings.filter("value is not null").select(F.pmod(F.xxhash64("patient_id", "parameter"), F.lit(GROUPS)).cast("int").alias("dealt"), F.col("patient_id").isNotNull().alias("known"), F.coalesce("patient_id", F.lit(0)).cast("long").alias("patient_id"), "parameter", "seq", "value")
    return rows.groupBy("dealt").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """The baseline of each patient and parameter after the last batch that had readings of it; rows: what the stream wrote, with ``batch``."""
    after = F.max_by(F.struct("n", "mean", "sd", "p10", "median", "p90"), "batch")
    return rows.groupBy("patient_id", "parameter").agg(after.alias("b")).select("patient_id", "parameter", "b.*")
