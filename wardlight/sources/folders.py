"""Folders of HL7 messages and of FHIR bundles as data sources, for tables and streams.

``load(spark, "hl7_folder", path)`` is a table, ``load(.., stream=True)`` a stream. Files are planned into partitions of about equal
bytes; a file that can't be read, or a part of one that is no message, is a row with ``error`` instead of a failed job. What is wanted is part of the load: values of
``source`` (the sub-folder, one for each sending system) leave whole files out, those of ``resource_type`` and ``patient_ref`` and a list of columns leave rows and
fields out before they reach Spark. (``pushFilters`` is not used: in Spark 4.1.2 all branches of a plan that read one loaded frame share what was pushed last, so a union of two
filters of one frame gives wrong rows.) A stream's offset is the newest (modification time, path) it has read, so files are read once, in that order, a bounded number a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of the files of one partition at most (a larger file is a partition of its own), files of one micro-batch.
PARTITION_BYTES, FILES_PER_BATCH = 64 << 20, 1_000


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str]]  # source, path within the file system


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def _listed(root: str, suffix: str) -> list[tuple[int, str, str, int]]:
    """(modification time, path, source, bytes) of the files under a folder, oldest first; names that begin with _ or . don't count."""
    system, base = _open(root)
    out = []
    for info in system.get_file_info(arrow_fs.FileSelector(base, recursive=True, allow_not_found=True)):
        below = info.path[len(base) :].strip("/").split("/")
        if info.type == arrow_fs.FileType.File and info.path.endswith(suffix) and not any(p[0] in "_." for p in below):
            source = below[-2].split("=", 1)[-1] if len(below) > 1 else ""
            out.append((info.mtime_ns or 0, info.path, source, info.size or 0))
    return sorted(out)


def _planned(files: list[tuple[int, str, str, int]]) -> list[Files]:
    parts, size = [], PARTITION_BYTES
    for _, path, source, n in files:
        if size + n > PARTITION_BYTES:
            parts.append(Files([]))
            size = 0
        parts[-1].paths.append((source, path))
        size += n
    return parts


class _Reading:
    """What tables and streams share: the rows of planned files that pass the filters."""

    def __init__(self, options: dict, suffix: str, parse, columns: list[str]):
        self.root, self.suffix, self.parse, self.columns = options["path"], options.get("suffix", suffix), parse, columns
        self.wanted = {k: set(json.loads(options[k])) for k in ("source", "resource_type", "patient_ref") if k in options}

    def chosen(self, files: list) -> list:
        sources = self.wanted.get("source")
        return [f for f in files if sources is None or f[2] in sources]

    def rows(self, part: Files) -> Iterator[tuple]:
        system, _ = _open(self.root)
        for source, path in part.paths:
            try:
                with system.open_input_stream(path) as f:
                    found = self.parse.rows(f.read().decode("utf-8"), self.wanted, self.columns)
            except (OSError, UnicodeDecodeError) as e:
                found = [{"error": f"{type(e).__name__}: unreadable file"}]
            for row in found:
                row |= {"source": source, "path": path}
                yield tuple(row.get(c) for c in self.columns)


class FolderReader(DataSourceReader):
    """Reads the whole folder once."""

    def __init__(self, reading: _Reading):
        self.reading = reading

    def partitions(self) -> list[Files]:
        return _planned(self.reading.chosen(_listed(self.reading.root, self.reading.suffix))) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.reading.rows(partition)


class FolderStream(DataSourceStreamReader):
    """Reads new files in the order of their modification times."""

    def __init__(self, reading: _Reading, most: int):
        self.reading, self.most = reading, most
        self.reached = None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _after(self, offset: dict) -> list:
        return [f for f in self.reading.chosen(_listed(self.reading.root, self.reading.suffix)) if (f[0], f[1]) > (offset["time"], offset["path"])]

    def latestOffset(self) -> dict:
        new = self._after(self.reached or self.initialOffset())[: self.most]
        if new:
            self.reached = {"time": new[-1][0], "path": new[-1][1]}
        return self.reached or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.reached = max(self.reached or start, end, key=lambda o: (o["time"], o["path"]))
        return _planned([f for f in self._after(start) if (f[0], f[1]) <= (end["time"], end["path"])])

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.reading.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class _Hl7:
    """Messages begin with MSH at the start of a line; what stands before the first one is no message."""

    @staticmethod
    def rows(text: str, wanted: dict, columns: list[str]) -> Iterator[dict]:
        lost, found = False, []
        for line in text.replace("\r\n", "\r").replace("\n", "\r").split("\r"):
            if line.startswith("MSH"):
                found.append([line])
            elif line.strip() and found:
                found[-1].append(line)
            else:
                lost |= bool(line.strip())
        if lost:
            yield {"error": "text before the first MSH"}
        for i, lines in enumerate(found):
            yield {"position": i, "message": "\r".join(lines)}


class _Bundles:
    """Entries of bundles, one JSON document a file or one a line."""

    @staticmethod
    def rows(text: str, wanted: dict, columns: list[str]) -> Iterator[dict]:
        try:
            documents = [json.loads(text)]
        except ValueError:
            documents = [x for x in text.splitlines() if x.strip()] or [""]
        for d in documents:
            try:
                bundle = json.loads(d) if isinstance(d, str) else d
                if bundle.get("resourceType") != "Bundle":
                    raise ValueError(bundle.get("resourceType"))
                entries = [e["resource"] for e in bundle.get("entry") or [] if isinstance(e, dict) and isinstance(e.get("resource"), dict)]
            except (ValueError, AttributeError, TypeError):
                yield {"error": "no Bundle"}
                continue
            for r in entries:
                subject = r.get("subject") or r.get("patient")
                row = {"resource_type": r.get("resourceType"), "resource_id": r.get("id"), "patient_ref": subject.get("reference") if isinstance(subject, dict) else None}
                row["date"] = r.get("effectiveDateTime") or r.get("authoredOn") or r.get("recordedDate") or r.get("birthDate")
                row = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in row.items()}
                if all(row[k] in wanted[k] for k in ("resource_type", "patient_ref") if k in wanted):
                    yield row | ({"resource": json.dumps(r, ensure_ascii=False)} if "resource" in columns else {})


class _Folder(DataSource):
    parse, suffix, fields = None, "", ""

    def schema(self) -> str:
        chosen = json.loads(self.options.get("columns", "null"))
        return ", ".join(f for f in self.fields.split(", ") if chosen is None or f.split()[0] in chosen)

    def _reading(self) -> _Reading:
        return _Reading(self.options, self.suffix, self.parse, [f.split()[0] for f in self.schema().split(", ")])

    def reader(self, schema) -> FolderReader:
        return FolderReader(self._reading())

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self._reading(), int(self.options.get("maxFilesPerTrigger", FILES_PER_BATCH)))


class Hl7Folder(_Folder):
    """Files of one or more HL7 v2 messages."""

    parse, fields = _Hl7, "source string, path string, position int, message string, error string"

    @classmethod
    def name(cls) -> str:
        return "hl7_folder"


class BundleFolder(_Folder):
    """The entries of FHIR bundles."""

    parse, suffix, fields = _Bundles, ".json", "source string, path string, resource_type string, resource_id string, patient_ref string, date string, resource string, error string"

    @classmethod
    def name(cls) -> str:
        return "fhir_bundles"


def load(spark: SparkSession, kind: str, path: str, stream: bool = False, columns: list[str] | None = None, suffix: str | None = None, most_files: int | None = None, **wanted: list[str]) -> DataFrame:
    """The rows of a folder: kind is hl7_folder or fhir_bundles, wanted are the values to keep of source, resource_type and patient_ref. Error rows of the sources that are read always come."""
    for source in (Hl7Folder, BundleFolder):
        spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(kind).options(**{k: json.dumps(list(v)) for k, v in wanted.items() if v is not None})
    given = {"columns": None if columns is None else json.dumps(columns), "suffix": suffix, "maxFilesPerTrigger": None if most_files is None else str(most_files)}
    return reader.options(**{k: v for k, v in given.items() if v is not None}).load(path)


def search(resources: DataFrame, sort: str = "-date", count: int | None = None) -> DataFrame:
    """A search's answer from each source: rows in the order of ``sort`` (date or -date; without a date last, then by id), ``count`` a source at most, with their position.

    Error rows of a source come besides, with no position. resources: a loaded frame with source, resource_id, date, resource and error.
    """
    order = [F.col("date").desc_nulls_last() if sort.startswith("-") else F.col("date").asc_nulls_last(), F.col("resource_id"), F.col("resource")]
    rows = resources.filter("error is null").withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
    rows = rows if count is None else rows.filter(F.col("position") <= count)
    return rows.unionByName(resources.filter("error is not null").withColumn("position", F.lit(None).cast("int")))
