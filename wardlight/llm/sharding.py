"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix [native].

1. Rows fall into P source partitions by a hash of doc_id, size and checksum, so a re-run or a lost executor sees the same
   ones. Rows equal in all three are numbered by counting, so they spread and shuffle like any others.
2. From the P row counts alone the driver draws, partition by partition, how many rows go to each shard:
   a multivariate hypergeometric draw from the capacities that are left. P is at most ``MAX_PARTS``.
3. Each partition permutes its rows by a random hash, and the drawn counts cut that order into shards.
4. Rows are exchanged by shard and permuted again inside; a shard is ranked in hash sub-ranges whose
   offsets come from their counts, so that no task holds a whole shard.
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch, numbered

MAX_PARTS = 4096
ROWS_PER_PART, ROWS_PER_FILE = 32_768, 1 << 20
MAX_SUBS = 256


def _hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """One exact draw by inversion outwards from the mode; takes about as many steps as the deviation."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p_mode = math.exp(lc(good, mode) + lc(bad, drawn - mode) - lc(good + bad, drawn))
    u = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(part_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Exact counts from each partition to each shard; row sums are part_rows, column sums shard_rows."""
    rng, left, matrix = random.Random(seed), list(shard_rows), []
    for rows in part_rows:
        total, need, out = sum(left), rows, []
        for cap in left:
            got = _hypergeometric(rng, cap, total - cap, need) if need else 0
            out.append(got)
            total, need = total - cap, need - got
        left = [a - b for a, b in zip(left, out)]
        matrix.append(out)
    return matrix


def _json_table(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def uniform_shards(docs: DataFrame, n_shards: int = 40, seed: int = 20_011, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row once, shards at most one row apart (law ``rows``).

    A null text has no bytes and the checksum of the empty text. Rows that repeat an id, or lack one, are rows of their
    own; rows equal in id, checksum and size are interchangeable, and each falls where chance puts it. An empty table
    gives an empty result. Other columns, of any names, are ignored. Reruns agree.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = lambda salt: F.xxhash64("doc_id", "size", "text_crc32", "copy", F.lit(seed + salt))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = scratch.save(numbered(rows), "rows")
    n = rows.count()
    n_parts = min(MAX_PARTS, max(16, n // ROWS_PER_PART))
    part: Column = F.pmod(mixed(0), F.lit(n_parts)).cast("int")
    counted = {r[0]: r[1] for r in rows.groupBy(part.alias("part")).count().collect()}  # at most MAX_PARTS
    matrix = communication_matrix([counted.get(p, 0) for p in range(n_parts)], [n // n_shards + (s < n % n_shards) for s in range(n_shards)], seed)
    table = [{"part": p, "ends": list(itertools.accumulate(row))} for p, row in enumerate(matrix)]
    ends = _json_table(spark, table, "part int, ends array<bigint>")  # at most MAX_PARTS * n_shards numbers

    first = Window.partitionBy("part").orderBy(mixed(1), "doc_id", "text_crc32", "size", "copy")
    placed = (
        rows.withColumn("part", part)
        .withColumn("rn", F.row_number().over(first))
        .join(F.broadcast(ends), "part")
        .select("doc_id", "size", "text_crc32", "copy", F.size(F.filter("ends", lambda e: e < F.col("rn"))).alias("shard"))
    )
    placed = scratch.save(placed, "placed")

    bits = min(MAX_SUBS, max(1, n // (n_shards * ROWS_PER_PART))).bit_length() + 1
    sub = F.shiftrightunsigned(mixed(2), 64 - bits).cast("int")
    placed = placed.withColumn("sub", sub)
    offsets = (
        placed.groupBy("shard", "sub").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count"))
        .select("shard", "sub", "before")
    )  # at most n_shards * 4 * MAX_SUBS rows
    second = Window.partitionBy("shard", "sub").orderBy(mixed(2), "doc_id", "text_crc32", "size", "copy")
    return (
        placed.withColumn("rn", F.row_number().over(second))
        .join(F.broadcast(offsets), ["shard", "sub"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rn") - 1).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, **options) -> None:
    """Whole rows as Parquet: folders shard=0.., each of files of rows_per_file slots in order. Ids must be there and unique (checked)."""
    id_col = options.get("id_col", "doc_id")
    if docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        raise ValueError(f"{id_col} is null or repeats")
    places = uniform_shards(docs, **options).select(F.col("doc_id").alias(id_col), "shard", "slot")
    rows = docs.drop("shard", "slot").join(places, id_col).withColumn("__file", F.floor(F.col("slot") / rows_per_file))
    rows.repartition("shard", "__file").sortWithinPartitions("shard", "__file", "slot").drop("__file").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Law ``rows`` over all documents into shards 0..39."""
    placed = uniform_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
