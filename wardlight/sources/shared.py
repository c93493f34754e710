"""Working folders of one query in the folder that all executors share: written tables cut lineage, streams keep their state there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master without it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="wardlight-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is missing."""
    fs, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether the folder now has the new name; false if that was taken. A rename within one file system is one step."""
    fs, target = _file_system(spark, new)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    return fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


class Workspace:
    """A folder of its own for one query. ``drop`` frees a part early; the rest goes when Python exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone; the files lie in the shared folder
            pass
