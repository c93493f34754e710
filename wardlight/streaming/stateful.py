"""Stateful streams by key: exact sliding counts, sessions and breakers, and the dead-letter branch.

The functions take a stream whose micro-batches come in time order; rows within a batch may come in any order and are
sorted by (time, seq) in their group. State is small: the accesses of one window, one session, or one breaker. A key
that is not seen for the stated time loses its state.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlight.sources.shared import Workspace


#: Rows that go back to Spark together, groups that patients are dealt to.
OUT_ROWS, GROUPS = 1 << 17, 2_048
#: Rows of a slice whose keys are few, so that each holds many of them.
BATCH_ROWS = 2_000_000
#: Rows of a slice that a task folds, groups of a task. Each task and each group costs a micro-batch its time (a store of states to load and commit, a call), however few rows it has.
TASK_ROWS, TASK_GROUPS = 500_000, 16


def seconds_of(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[s]").astype("int64")


def dealt(rows: DataFrame, key: str, groups: int | None = None) -> DataFrame:
    """rows with the group that many keys share (``dealt``; keys of null have their own), as a state a key costs a call a key and micro-batch. A stream keeps its number of groups (GROUPS if not given)."""
    return rows.withColumn("dealt", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups or GROUPS))).cast("int")).withColumn(key, F.coalesce(key, F.lit(0)))


def _folded(rows: DataFrame, key: str, time: str, delay: str, idle_ms: int, state: str, out: str, fold: Callable[[object, tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]) -> DataFrame:
    """fold(key, state, rows of the key in order, without the key) -> (state, rows out), for each key and micro-batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        batch = pd.concat([f.drop(columns=key) for f in frames]).sort_values([time, "seq"], ignore_index=True)  # one key of one micro-batch
        new, made = fold(k[0], held.get if held.exists else None, batch)
        held.update(new)
        held.setTimeoutTimestamp(max(int(batch[time].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + idle_ms)
        for first in range(0, len(made), OUT_ROWS):
            yield made.iloc[first : first + OUT_ROWS]

    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def sliding_counts(accesses: DataFrame, seconds: int = 3600, limit: int = 50, delay: str = "1 hour") -> DataFrame:
    """accesses (actor_id, at, seq): how many the actor made in the trailing window, rows of the same second included, and whether that exceeds the limit.

    The state has one count a second of the window, however many accesses that had.
    """

    def fold(actor, held, batch):
        at = seconds_of(batch["at"])
        old, n_old = (np.array(x, "int64") for x in held) if held else (np.zeros(0, "int64"),) * 2
        times, where = np.unique(np.concatenate([old, at]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([n_old, np.ones(len(at))])).astype("int64")
        total = np.concatenate([[0], np.cumsum(counts)])
        n = total[np.searchsorted(times, at, side="right")] - total[np.searchsorted(times, at - seconds, side="left")]
        keep = times >= at.max() - seconds
        return (times[keep].tolist(), counts[keep].tolist()), pd.DataFrame({"actor_id": actor, "seq": batch["seq"], "in_window": n, "breach": n > limit})

    return _folded(accesses, "actor_id", "at", delay, 2_000 * seconds, "times array<long>, counts array<long>", "actor_id long, seq long, in_window long, breach boolean", fold)


def sessions(readings: DataFrame, idle_hours: int = 24, delay: str = "1 hour", groups: int | None = None) -> DataFrame:
    """readings (patient_id, time, seq): the session each belongs to, by its first second, and its number in it. A session ends after idle_hours without a reading.

    Patients share states; one that is idle for so long leaves the state of its group.
    """
    idle = idle_hours * 3600

    def fold(group, held, batch):
        batch = batch.sort_values("patient_id", kind="stable")
        who, at = batch["patient_id"].to_numpy("int64"), seconds_of(batch["time"])
        ids, starts, lasts, counts = (np.array(x, "int64") for x in held) if held else (np.zeros(0, "int64"),) * 4
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        place = np.searchsorted(ids, who[first])  # ids are in order
        there = np.zeros(len(first), bool)
        there[place < len(ids)] = ids[place[place < len(ids)]] == who[first][place < len(ids)]
        before = np.concatenate([[0], at[:-1]])
        before[first[there]] = lasts[place[there]]
        new = at - before > idle
        new[first[~there]] = True
        row = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(new, row, -1))  # the row that began the session, or one of an earlier patient
        patient = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        goes_on = begin < first[patient]
        start, n = at[np.maximum(begin, 0)], row - begin + 1
        old = np.zeros(len(first), "int64")
        old[there] = place[there]
        if goes_on.any():
            start[goes_on], n[goes_on] = starts[old[patient[goes_on]]], counts[old[patient[goes_on]]] + row[goes_on] - first[patient[goes_on]] + 1
        end = np.append(first[1:], len(at)) - 1
        stay = ~np.isin(ids, who[first]) & (lasts >= at.max() - idle)
        now = [np.concatenate(x) for x in ((ids[stay], who[end]), (starts[stay], start[end]), (lasts[stay], at[end]), (counts[stay], n[end]))]
        order = np.argsort(now[0], kind="stable")
        made = pd.DataFrame({"patient_id": pd.array(who, "Int64") if group >= 0 else pd.array([None] * len(who), "Int64"), "seq": batch["seq"].to_numpy(), "session_start": start, "n": n})
        return tuple(x[order].tolist() for x in now), made

    state = "ids array<long>, starts array<long>, lasts array<long>, counts array<long>"
    return _folded(dealt(readings, "patient_id", groups), "dealt", "time", delay, idle * 1_000, state, "patient_id long, seq long, session_start long, n long", fold)


def breaker(failures: list[int], open_since: int, at: int, failed: bool, threshold: int = 3, window: int = 300, reset: int = 600) -> tuple[list[int], int, bool]:
    """One call at a second: (failures, open since or -1, whether it was refused). Open after ``threshold`` failures within ``window`` seconds, tried again ``reset`` seconds later."""
    if open_since >= 0 and at - open_since > reset:
        open_since = -1
    if open_since >= 0:
        return failures, open_since, True
    if not failed:
        return [], -1, False
    failures = [*(t for t in failures if t > at - window), at]
    return failures, at if len(failures) >= threshold else -1, False


def breakers(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """calls (agent, at, seq, failed): whether each was refused by the agent's breaker, and whether that is open after it."""

    def fold(agent, held, batch):
        failures, since = (list(held[0]), held[1]) if held else ([], -1)
        at, failed = seconds_of(batch["at"]), batch["failed"].to_numpy(bool)
        refused, opened = np.zeros(len(at), bool), np.zeros(len(at), bool)
        for first in range(0, len(at), OUT_ROWS):
            for i, (t, bad) in enumerate(zip(at[first : first + OUT_ROWS].tolist(), failed[first : first + OUT_ROWS].tolist()), first):
                failures, since, refused[i] = breaker(failures, since, t, bad)
                opened[i] = since >= 0
        return (failures, since), pd.DataFrame({"agent": agent, "seq": batch["seq"], "refused": refused, "open": opened})

    return _folded(calls, "agent", "at", delay, 3_600_000, "failures array<long>, since long", "agent string, seq long, refused boolean, open boolean", fold)


class Slices:
    """Rows cut into time slices, each written when its turn comes: several files, one micro-batch."""

    def __init__(self, work: Workspace, frames: list[DataFrame]):
        self.work, self.frames, self.schema = work, frames, frames[0].schema

    @functools.cached_property
    def tasks(self) -> int:
        """As many tasks as leave some TASK_ROWS rows of the largest slice each, one a core at least."""
        return max(self.work.spark.sparkContext.defaultParallelism, -(-max(f.count() for f in self.frames) // TASK_ROWS))

    @property
    def groups(self) -> int:
        """Groups to deal keys to: their rows in a slice do not grow with the table, and neither do the groups of a task."""
        return TASK_GROUPS * self.tasks

    def source(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(self.schema).parquet(self.work.path("in") + "/slice-*")

    def arrive(self, i: int) -> None:
        self.frames[i].write.parquet(self.work.path(f"in/slice-{i}"))


def even_cuts(rows: DataFrame, time: str, cuts: list[str], most: int = BATCH_ROWS) -> list[str]:
    """The cuts and as many more as leave some ``most`` rows a slice, by approximate percentiles of the time; rows of one time stay together.

    A key whose rows are folded one after the other holds a slice's rows of it at once, so its memory does not grow with the table. Any cuts give the same rows.
    """
    n = -(-rows.count() // most)
    if n < 2:
        return cuts
    ends = rows.agg(F.percentile_approx(time, [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted({*cuts, *(str(x) for x in ends or [])})


def in_time_order(spark: SparkSession, rows: DataFrame, cuts: list[str], time: str, late: str | None = None) -> Slices:
    """rows between the cuts, slice by slice; rows where ``late`` holds come with the last one."""
    held = F.expr(late) if late else F.lit(False)
    bounds, frames = [None, *cuts, None], []
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = F.lit(True)
        if low is not None:
            part = part & (F.col(time) >= F.lit(low).cast("timestamp_ntz"))
        if high is not None:
            part = part & (F.col(time) < F.lit(high).cast("timestamp_ntz"))
        frames.append(rows.filter((part & ~held) if high is not None else (part | held)))
    return Slices(Workspace(spark, "replay"), frames)


@contextlib.contextmanager
def settings(spark: SparkSession, **on: str):
    """Settings (dots as __) that a stream takes over when it starts; the session has its own again afterwards."""
    before = {k: spark.conf.get(k.replace("__", "."), None) for k in on}
    try:
        for k, v in on.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k.replace("__", ".")) if v is None else spark.conf.set(k.replace("__", "."), v)


def replay(spark: SparkSession, slices: Slices, transform: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], mode: str = "append", end: bool = False, **on: str) -> DataFrame:
    """Runs a stream over the slices as they arrive: it ends after each and goes on from its checkpoint with the next. Returns the stream's frame, for its schema.

    end: timers that are due by the last watermark fire too. The states lie in as many tasks as the slices ask for, if ``on`` does not say it.
    """
    on = on if "spark__sql__shuffle__partitions" in on else on | {"spark__sql__shuffle__partitions": str(slices.tasks)}
    for i in range(len(slices.frames)):
        slices.arrive(i)
        final = end and i == len(slices.frames) - 1
        with settings(spark, spark__sql__streaming__noDataMicroBatches__enabled=str(final).lower(), **on):
            out = transform(slices.source(spark))
            query = out.writeStream.outputMode(mode).option("checkpointLocation", slices.work.path("state")).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    slices.work.drop("in", "state")
    return out


def run(spark: SparkSession, slices: Slices, transform: Callable[[DataFrame], DataFrame], mode: str = "append", end: bool = False, **on: str) -> DataFrame:
    """What a stream over the slices has written in the end. A repeated batch replaces its own rows."""
    where = slices.work.path("out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batch={number}")

    out = replay(spark, slices, transform, write, mode, end, **on)
    return spark.read.schema(out.schema.add("batch", "long")).parquet(where)


def split_dead_letters(spark: SparkSession, slices: Slices, bad: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with digest) of a stream: both branches are written in the same micro-batch, so a repeated batch replaces both."""
    good, dead = slices.work.path("good"), slices.work.path("dead")

    def write(batch: DataFrame, number: int) -> None:
        batch.filter("not __bad").drop("__bad").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter("__bad").drop("__bad").withColumn("digest", F.sha2(payload, 256)).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    replay(spark, slices, lambda s: s.withColumn("__bad", F.coalesce(F.expr(bad), F.lit(True))), write)
    return spark.read.parquet(good), spark.read.parquet(dead)
