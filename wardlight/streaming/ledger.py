"""A sink that takes every micro-batch exactly once, however often it is handed over.

A batch is written to a folder of its own and becomes part of the table by one rename to the name that the ledger has for (stream, batch). A batch whose name
is taken has been committed before: what was written again goes. So a stream that dies between write and commit, or between commit and its own
checkpoint, loses and repeats nothing when it starts again; of two writers of one batch one wins. Needs a file system that renames folders in one
step, as HDFS and local ones do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardlight.sources import shared


class Ledger:
    """The table under a folder: ``entries/<stream>-<batch>`` are its committed batches, ``open`` holds what is being written."""

    def __init__(self, spark: SparkSession, path: str, stream: str, folders: list[str] | None = None):
        """``folders``: columns of few values by which the rows of a batch are laid out, so that readers skip the others."""
        self.spark, self.path, self.stream, self.folders = spark, path.rstrip("/"), stream, folders or []

    def _entry(self, batch: int) -> str:
        return f"{self.path}/entries/stream={self.stream}/batch={batch:012d}"

    def committed(self) -> list[int]:
        return [int(n.split("=")[1]) for n in shared.listed(self.spark, f"{self.path}/entries/stream={self.stream}")]

    def write(self, rows: DataFrame, batch: int, before_commit: Callable[[int], None] = lambda batch: None) -> bool:
        """Whether this call committed the batch; False if it was there. ``before_commit`` runs between write and commit (tests fail there)."""
        if shared.exists(self.spark, self._entry(batch)):
            return False
        opened = f"{self.path}/open/{self.stream}-{batch}-{uuid.uuid4().hex[:12]}"
        rows.write.partitionBy(*self.folders).parquet(opened)
        before_commit(batch)
        if shared.rename(self.spark, opened, self._entry(batch)):
            return True
        shared.delete(self.spark, opened)
        return False

    def read(self, schema) -> DataFrame:
        """All committed rows, with stream and batch."""
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/entries").option("recursiveFileLookup", "false").parquet(f"{self.path}/entries")

    def clean(self) -> None:
        """Removes what dead writers left; only while no writer runs."""
        shared.delete(self.spark, f"{self.path}/open")


def start(rows: DataFrame, ledger: Ledger, checkpoint: str, every: str = "500 milliseconds", before_commit: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """A running stream into the ledger, a micro-batch whenever ``every`` has passed; its source bounds a batch (``maxFilesPerTrigger``), so a batch closes by size or by time."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: ledger.write(batch, n, before_commit)).trigger(processingTime=every).start()
