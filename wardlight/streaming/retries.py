"""Failed records wait and come again: retries with growing waits as timers of a keyed state, and dead letters in the end.

A record that fails its n-th retry (n from 1) waits min(2**(n + 1), 60) seconds; one that fails its last is a dead letter. Waiting records are kept in the state
of the bucket their id falls in, so a bucket's timer fires once for all that are due, and no key has more than its share of what is
waiting. Timers run on event time: a replay gives the same tries at the same seconds as the stream did.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRIES = "record_id long, source string, retry int, sec long, outcome string, reason string, payload string"


def wait_seconds(retry: int, most: int = 60) -> int:
    """Seconds before a retry: 2, 4, 8 and so on, at most ``most``."""
    return min(2**retry, most)


class Retrying(StatefulProcessor):
    """Tries records of one bucket; ``attempt(payload, retry)`` gives the reason of a failure or None."""

    def __init__(self, attempt: Callable[[str, int], str | None], most: int):
        self.attempt, self.most = attempt, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "record_id long, source string, payload string, retry int, due long")

    def _tried(self, record: tuple, retry: int, sec: int, out: list, held: list) -> None:
        """One try at a second, and what follows from it."""
        record_id, source, payload = record
        reason = self.attempt(payload, retry)
        outcome = "ok" if reason is None else "dead" if retry >= self.most else "failed"
        out.append((record_id, source, retry, sec, outcome, reason, payload if outcome == "dead" else None))
        if outcome == "failed":
            held.append((*record, retry + 1, sec + wait_seconds(retry + 1)))

    def _settle(self, held: list) -> None:
        """Keeps what waits, and one timer for the first that is due."""
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if held:
            self.waiting.put(held)
            self.handle.registerTimer(1_000 * min(h[4] for h in held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], [tuple(x) for x in self.waiting.get()]
        for frame in rows:
            for record_id, source, sec, payload in zip(frame["record_id"], frame["source"], frame["sec"], frame["payload"]):
                if record_id == record_id and record_id is not None:  # a tick of the clock has none
                    self._tried((int(record_id), source, payload), 0, int(sec), out, held)
        self._settle(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1_000
        out, held = [], [tuple(x) for x in self.waiting.get()]
        while due := [h for h in held if h[4] <= now]:  # a retry that fails again may be due as well
            held = [h for h in held if h[4] > now]
            for record_id, source, payload, retry, sec in due:
                self._tried((record_id, source, payload), retry, sec, out, held)
        self._settle(held)
        yield self._frame(out)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["record_id", "source", "retry", "sec", "outcome", "reason", "payload"]).astype({"record_id": "int64", "retry": "int32", "sec": "int64"})

    def close(self) -> None:
        pass


def retried(records: DataFrame, attempt: Callable[[str, int], str | None], most: int = 3, buckets: int = 64, delay: str = "0 seconds") -> DataFrame:
    """Every try of a stream of records (record_id, source, at, payload): retry (0: the first try), sec, outcome (ok, failed, dead), reason, and the payload of dead letters.

    Rows without record_id only move the clock. A null payload is handed to ``attempt`` as None. The session's state store has to be ROCKS when the
    stream starts. Records that come again under their id are tried again on their own.
    """
    sec = F.unix_seconds(F.col("at").cast("timestamp"))
    rows = records.select("record_id", "source", sec.alias("sec"), "payload", F.col("at").cast("timestamp").alias("at"), F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int").alias("bucket")).withWatermark("at", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Retrying(attempt, most), outputStructType=TRIES, outputMode="Append", timeMode="EventTime")


def dead_letters(tries: DataFrame) -> DataFrame:
    """What operations review of each dead letter: reason, number of retries, digest of the payload."""
    return tries.filter("outcome = 'dead'").select("record_id", "source", "reason", F.col("retry").alias("retry_count"), F.col("sec").alias("failed_at"), F.sha2("payload", 256).alias("digest"))
