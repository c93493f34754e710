"""Line dedup over levelled sorted runs of line hashes [native].

The state is a set of runs, each a table bucketed and sorted by line hash. A run entry says in how many
documents of its batch a line was seen and, if no older run had the line, which document keeps it.
Batches arrive in descending doc_id order, so the keeper is fixed when a line is first seen: a new batch
is merged with each run in turn, run by run in the order of the hashes and without moving the runs; its fresh lines get
a keeper, its known lines only add to the count, and both become a new run. When a level holds ``fanout`` runs they
are merged into one run of the next level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch, with_labels

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """All \\n-separated lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space, A-Z lower-cased; the plain ``lower`` is taken where all is ASCII."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levelled runs (h1, h2, n_docs, keeper), each bucketed and sorted by (h1, h2), in a shared folder."""

    def __init__(self, scratch: Scratch, fanout: int = 3):
        self.scratch, self.fanout, self.spark = scratch, fanout, scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.levels, self.made = f"line_runs_{uuid.uuid4().hex[:12]}", [[]], 0

    def entries(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        self.scratch.save_sorted(run, name, self.buckets, KEY)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: distinct (h1, h2, did), every did smaller than those of earlier batches."""
        seen = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("did").alias("keeper"))
        for run in self.entries():  # a line that an older run has keeps that run's keeper
            seen = seen.join(run.select(*KEY, F.lit(True).alias("old")), KEY, "left").withColumn("keeper", F.when(F.col("old").isNull(), F.col("keeper"))).drop("old")
        self._write(seen, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(self._merged([self.spark.table(x) for x in names]), level + 1)
            self.scratch.drop_tables(*names)
            level += 1

    def totals(self) -> DataFrame:
        return self._merged(self.entries())


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs plus n_lines, n_dropped and kept_text, which replace columns of these names.

    A line of at least min_chars code points (as a key) found in at least min_docs documents is dropped
    everywhere but in the document with the largest id, where all its copies stay. Rows with the same id are one document;
    a null id is one document below all others. A null or empty text is one empty line, which stays. Texts of any length
    are cut at their dropped lines in one pass. An empty table gives an empty result; further columns pass through.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    did, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col)
    same = F.xxhash64(F.coalesce(text, F.lit("")))  # rows of one id that have one text drop the same lines
    cuts = docs.select(F.percentile_approx(did, [i / n_batches for i in range(1, n_batches)], 1000).alias("c")).first()["c"] or []
    batch = sum((F.when(F.col("did") <= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    keys = docs.select(did.alias("did"), same.alias("same"), F.posexplode(lines_of(text)).alias("pos", "line")).select("did", "same", "pos", line_key(F.col("line")).alias("key"))
    found = keys.filter(F.char_length("key") >= min_chars).select("did", "same", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    found = scratch.save(found.withColumn("batch", batch.cast("int")), "found", ["batch"])

    runs = LineRuns(scratch)
    for b in range(len(set(cuts)) + 1):
        runs.add(found.filter(F.col("batch") == b).select(*KEY, "did").distinct())
    common = scratch.save(runs.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper", F.col("n_docs").alias("__n")), "common")
    drops = (
        with_labels(found.select("did", "same", "pos", *KEY), common, KEY, found.count()).filter(F.col("did") != F.col("keeper"))
        .groupBy(F.col("did").alias("__did"), F.col("same").alias("__same")).agg(F.sort_array(F.collect_set(F.col("pos"))).alias("__drop"))
    )  # at most the lines of one text

    lines = lines_of(text)
    joined = docs.drop("n_lines", "n_dropped", "kept_text").withColumn("__did", did).withColumn("__same", same).join(drops, ["__did", "__same"], "left").drop("__did", "__same")
    drop, n = F.col("__drop"), F.size("__drop")
    begin = lambda i: F.when(i == 0, 1).otherwise(F.get(drop, i - 1) + 2)  # noqa: E731  1-based, after the dropped line before
    end = lambda i: F.when(i < n, F.get(drop, i)).otherwise(F.col("n_lines").cast("int"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("__lines", begin(i), F.greatest(F.lit(0), end(i) - begin(i) + 1))))
    return (
        joined.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", F.when(drop.isNull(), 0).otherwise(n).cast("long"))
        .withColumn("kept_text", F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .drop("__drop", "__lines")
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines of 40 code points or more found in five of them: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, all_lines[pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(all_lines) + 1)) AS pos) p
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
