"""The corpus pipeline: quality rules, line dedup, near-duplicates, source mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight.llm.line_dedup import dedup_lines
from wardlight.llm.mixing import mix_to_targets, word_count
from wardlight.llm.near_dups import one_of_each, row_hash
from wardlight.llm.pieces import encode
from wardlight.llm.quality_rules import judge
from wardlight.llm.scratch import Scratch

#: The stages learn rules, solve for rates and encode; SQL can't express them. Tests compare with brute force.
ORACLE_SQL = None
#: Columns that stages know; all others are the user's and pass through as they are.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing_through(stage: Stage) -> Stage:
    """The stage on docs whose other columns have names of their own meanwhile, so none that an operator makes or works with can replace them."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in KNOWN else f"__user_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

    return run


@passing_through
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go; null and empty texts are among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).filter("kept").select(docs.columns)


@passing_through
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; text and n_chars are those of the kept lines. A null text becomes an empty one.

    Very long texts are cut at their dropped lines in one pass; an empty table gives an empty one.
    """
    kept = dedup_lines(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long"))
    return kept.select(docs.columns)


@passing_through
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the smallest id stays, once; different texts under one id, and rows without words, stay."""
    return one_of_each(docs)


@passing_through
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; documents without words go.

    Very long texts count with all their words; an empty table gives an empty one. Rows equal in id, source and size share their copies in the order of their hashes. Who stands how often is settled on
    ids, sizes and hashes; whole rows move once.
    """
    same = ["__id", "__source", "__size"]
    number = lambda *order: F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    keys = [F.struct("doc_id").alias("__id"), F.struct("source").alias("__source")]  # a struct is never null, so rows without id or source meet
    mixed = mix_to_targets(docs).filter("copies > 0").select(*keys, F.col("size").alias("__size"), F.col("copies").alias("__copies")).withColumn("__n", number(F.desc("__copies")))
    marked = docs.withColumn("__row", row_hash(docs))
    small = marked.select(*keys, word_count(F.col("text")).alias("__size"), "__row").withColumn("__n", number("__row"))
    times = small.join(mixed, [*same, "__n"]).groupBy("__id", "__row").agg(F.sum("__copies").cast("int").alias("__copies"))  # equal rows as one
    taken = marked.withColumn("__id", keys[0]).join(times, ["__id", "__row"]).dropDuplicates(["__id", "__row"])
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with whether they decode to its text. Null and empty texts have no ids."""
    out = encode(docs, check_col="round_trip", carry=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
