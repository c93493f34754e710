"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scans of sorted buckets of one file each count as sorted.
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: In Spark 4.1.2 a union of bucketed tables counts as bucketed too but is not, and aggregates of it come out wrong.
UNION = "spark.sql.unionOutputPartitioning"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary folder only for a local master without one."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if conf.get("spark.master", "").startswith("local-cluster") or not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="wardlight-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named intermediate tables of one query. ``drop`` frees a table early; the rest goes when Python exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wardlight-{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        atexit.register(self.close)

    @contextlib.contextmanager
    def settings(self, **on: str):
        before = {k: self.spark.conf.get(k) for k in on}
        try:
            for k, v in on.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, files: int | None = None, row_group: int | None = None) -> DataFrame:
        """df as a table; ``files`` (made from counted rows) keeps small tables from being written as very many files, ``row_group`` bounds the bytes of long rows that are read at once."""
        if files:
            df = df.coalesce(files)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if row_group:
            writer = writer.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 1)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with self.settings(**{CLEAN_UP: "true", UNION: "false"}):  # what is written needs its shuffles no more
            writer.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def save_sorted(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> None:
        """A table named ``name``, bucketed and sorted by the keys: joins and aggregates by them need no exchange of it, nor a sort."""
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{self.root}/{name}").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys)
        with self.settings(**{CLEAN_UP: "true", SORTED: "true", UNION: "false"}):
            writer.saveAsTable(name)
        self.tables.append(name)

    def drop_tables(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables.remove(name)
            self.drop(name)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self.drop_tables(*list(self.tables))
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone already; the files lie in the shared folder
            pass


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows by a hash of key: the same rows on each run. Rows that can't be among them are filtered before the sort."""
    total = df.count()
    mixed = F.xxhash64(F.col(key), F.lit(97))
    if total > n:
        share = min(1.0, 1.1 * n / total + 200 / total)
        df = df.filter(mixed <= F.lit(int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1))
    return df.orderBy(mixed, key).limit(n)


#: A key of more rows than this, and than a thousandth of all rows, gets its label by broadcast.
HOT_ROWS = 1_000


def with_labels(rows: DataFrame, labels: DataFrame, key: str | list[str], n_rows: int) -> DataFrame:
    """rows joined with labels (one row a key, __n: about how many rows have it). Keys of very many rows are joined by broadcast, so no task gets all rows of one.

    n_rows is about the sum of __n over all keys, so at most a thousand labels are broadcast.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(labels.filter(F.col("__n") > max(HOT_ROWS, n_rows // 1_000)).drop("__n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(labels.drop("__n"), keys)
    return rows.join(hot, keys).unionByName(rest)


def numbered(rows: DataFrame, name: str = "copy") -> DataFrame:
    """rows with a number that tells equal rows apart, 0 for the first: equal rows are counted and dealt out again, so no task gets all rows of one kind."""
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    first = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(4_096).cast("long"))
    some = counts.withColumn("__first", F.explode(first))
    return some.withColumn(name, F.explode(F.sequence(F.col("__first"), F.least(F.col("__n"), F.col("__first") + 4_096) - 1))).drop("__n", "__first")
