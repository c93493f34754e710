"""Source divergence audit: how far the term distributions of the sources of one language lie apart, exactly.

Tasks count the terms of their documents; Spark adds the counts up by (lang, source, term) and keeps the terms of
enough documents. Kept terms are dealt into vocabulary chunks by a hash and numbered inside them, and a source's counts
in one chunk are packed in one row. Sources are dealt into blocks of BLOCK; a row goes to each tile (a pair of blocks) that its
block is in. A task has one tile and one segment, SEGMENT successive chunks: it lays the counts of a chunk out as a matrix, turns them into
whole-number shares and adds up the differences of all pairs; Spark adds the segments up. So a task's memory is bounded
by BLOCK, CHUNK and SEGMENT, whatever the number of sources or terms, and only the small packed rows are replicated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch
from wardlight.llm.terms import LETTERS, coded_chunks

#: Sources of a block, terms of a vocabulary chunk on average, chunks of a segment, bytes of text counted together: they bound a task's memory only.
BLOCK, CHUNK, SEGMENT, TEXT = 32, 4_096, 4, 16 << 20
SMOOTH = 5


def _counts(batches):
    """Rows (lang, source, text) as counts of each term in each group of a chunk, with the number of documents."""
    for b in batches:
        lang, source = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
        pair = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
        _, row_of, group = np.unique(pair, return_index=True, return_inverse=True)
        for first, end, coded in coded_chunks(b.column("text"), LETTERS, TEXT):
            n_words = max(1, len(coded.words))
            seen, times = np.unique(coded.doc_of_word() * n_words + coded.codes, return_counts=True)  # a key for each document and term
            cell, of = np.unique(group[first:end][seen // n_words] * n_words + seen % n_words, return_inverse=True)
            n, docs = np.bincount(of, weights=times, minlength=len(cell)), np.bincount(of, minlength=len(cell))
            at = pa.array(row_of[cell // n_words])
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").take(at), b.column("source").take(at), coded.words.take(pa.array(cell % n_words)).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
                names=["lang", "source", "term", "n", "docs"],
            )


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + SMOOTH) / total) in whole numbers, by long division, three digits a step; exact for totals below 9e15."""
    out, rest = np.divmod(count + SMOOTH, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1_000, total)
        out = out * 1_000 + digits
    return out + 1


def share(count: Column, total: Column) -> Column:
    """The same of columns."""
    out, rest = F.call_function("div", count + SMOOTH, total), (count + SMOOTH) % total
    for _ in range(3):
        out, rest = out * 1_000 + F.call_function("div", rest * 1_000, total), rest * 1_000 % total
    return out + 1


def tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences between the sources of two blocks over the chunks of one segment; each pair once.

    A row with a negative chunk names a source (g), its block, its total (d) and the number of the segment's terms (v); the others have its counts in one chunk.
    """
    lang, block_a, block_b = pdf["lang"].iat[0], int(pdf["block_a"].iat[0]), int(pdf["block_b"].iat[0])
    heads = pdf[pdf["chunk"] < 0].sort_values("g")
    g, total = heads["g"].to_numpy(np.int64), heads["d"].to_numpy(np.int64)
    side = heads["block"].to_numpy(np.int64)
    left, right = np.flatnonzero(side == block_a), np.flatnonzero(side == block_b)
    sums = np.zeros((len(left), len(right)), np.int64)
    seen = 0
    for _, rows in pdf[pdf["chunk"] >= 0].groupby("chunk"):
        terms = np.concatenate(rows["pos"].to_list())
        at, column = np.unique(terms, return_inverse=True)
        counts = np.zeros((len(g), len(at)), np.int64)
        counts[np.repeat(np.searchsorted(g, rows["g"].to_numpy()), [len(x) for x in rows["pos"]]), column] = np.concatenate(rows["n"].to_list())
        p = shares(counts, total[:, None])
        seen += len(at)
        for i, row in enumerate(left):
            sums[i] += np.abs(p[right] - p[row]).sum(axis=1)
    unseen = int(heads["v"].iat[0]) - seen  # terms that none of these sources has
    base = shares(np.zeros(len(g), np.int64), total) if unseen else total
    sums += unseen * np.abs(base[left][:, None] - base[right][None, :])
    a, b = np.nonzero(g[left][:, None] < g[right][None, :])
    return pd.DataFrame({"lang": lang, "a": g[left][a], "b": g[right][b], "value": sums[a, b]})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from each other one of its language (``pair``) and the terms that it has most in excess (``term``).

    Null text, lang and source read as the empty text. Repeated rows count as often as they stand; ties of a rank go by the item's bytes. Texts
    without terms leave a source with no counts: it takes part, all its shares being equal. A language in which no term is kept has pairs of value 0 and no
    terms; a source alone in its language has no pairs. A very long text is counted as a chunk of its own. An empty table gives an empty result;
    other columns, of any names, are ignored. Sums are exact while a source has fewer than 9e15 words.
    """
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    read = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "text"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    cells = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")

    vocab = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
    vocab = scratch.save(vocab.select("lang", "term", "lang_n"), "vocab")
    largest = vocab.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64("term"), F.lit(largest // CHUNK + 1)).cast("int")
    pos = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term"))  # about CHUNK rows each
    placed = vocab.withColumn("chunk", chunk).withColumn("pos", pos)
    kept = scratch.save(cells.drop("docs").join(placed, ["lang", "term"]), "kept")
    scratch.drop("cells")

    found = rows.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v_lang"), F.sum("lang_n").alias("all"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.lit(0).cast("long")
    sources = found.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").withColumn("g", number.cast("long")).na.fill(0, ["own", "v_lang", "all"])
    n_blocks = F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / BLOCK).cast("long") + 1
    sources = scratch.save(sources.withColumn("d", F.col("own") + SMOOTH * F.col("v_lang")).withColumn("n_blocks", n_blocks), "sources")

    def to_tiles(packed: DataFrame) -> DataFrame:
        own, other = F.floor(F.col("g") / BLOCK).cast("long"), F.col("other")
        each = packed.withColumn("other", F.explode(F.sequence(zero, F.col("n_blocks") - 1)))
        return each.select("lang", F.least(own, other).alias("block_a"), F.greatest(own, other).alias("block_b"), own.alias("block"), "seg", "g", "d", "v", "chunk", "pos", "n")

    seg = F.floor(F.col("chunk") / SEGMENT).cast("int")
    segments = placed.groupBy("lang", seg.alias("seg")).agg(F.count(F.lit(1)).alias("v"))
    none_arrays = [F.array().cast("array<int>").alias("pos"), F.array().cast("array<long>").alias("n")]
    heads = sources.join(segments, "lang", "left").na.fill(0, ["seg", "v"]).select("lang", "n_blocks", "seg", "g", "d", "v", F.lit(-1).alias("chunk"), *none_arrays)
    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "n")).alias("x"))  # at most a chunk's terms
    packed = packed.join(sources, ["lang", "source"]).select("lang", "n_blocks", seg.alias("seg"), "g", "d", zero.alias("v"), "chunk", F.col("x.pos").alias("pos"), F.col("x.n").alias("n"))
    tiles = to_tiles(heads.unionByName(packed)).groupBy("lang", "block_a", "block_b", "seg")
    halves = tiles.applyInPandas(tile, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = halves.withColumn("ends", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))))
    name = sources.select("lang", "g", "source")
    pairs = both.select("lang", "ends.g", "ends.h", "value").join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)

    excess = kept.join(sources.select("lang", "source", "d", "v_lang", "all"), ["lang", "source"])
    value = share(F.col("n"), F.col("d")) - share(F.col("lang_n"), F.col("all") + SMOOTH * F.col("v_lang"))
    terms = excess.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    return pairs.unionByName(terms.withColumn("rank", ranked).filter(F.col("rank") <= top))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    """All sources of each language against each other and against their language, on terms of at least 30 documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT d.lang, d.source, coalesce(n, 0)::HUGEINT + 5 * coalesce(v, 0) AS d
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // g.d AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM p GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM kept)
), terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
