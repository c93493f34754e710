"""Target-distribution importance resampling over hashed n-gram features.

Each task keeps a trie of the word runs it meets: a node is a run of words, its edges are words, and it holds the CRC
state of the run's bytes, so a child's bucket costs its own word's bytes only. In the first pass nodes count their
features; a task hands over its bucket totals, and Spark adds them up. In the second pass nodes carry the gain of
their bucket and a document's weight is the sum along the paths of its words. A trie that reaches NODES nodes hands
over and starts again, which changes no total. The draw ranks scores by counting: rows with equal scores are
numbered inside ranges of (score, doc_id), so no task sorts all of them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch
from wardlight.llm.terms import LETTERS_DIGITS, Coded, coded_chunks

#: Nodes of a trie, and bytes of text coded together: they bound a task's memory, not what is counted.
NODES, CHUNK = 1 << 20, 2 << 20
#: Copies of one row that are numbered together.
COPIES = 4_096


class Trie:
    """Runs of up to ``depth`` words: node ids by (parent, word), node 0 is the root. ``counts`` and ``gains`` are arrays by node."""

    def __init__(self, depth: int, buckets: int, gain_of_bucket: np.ndarray | None = None):
        self.depth, self.buckets, self.gain_of_bucket = depth, buckets, gain_of_bucket
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.spelled: list[bytes] = []
        self.child: dict[int, int] = {}
        self.crc = [0]
        self.bucket = np.zeros(1, np.int32)
        self.counts = np.zeros(1, np.int64)

    def _nodes(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of distinct keys (parent << 32 | word); new ones get the CRC state of their parent carried on."""
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            node = self.child.get(key)
            if node is None:
                node = self.child[key] = len(self.crc)
                parent, word = key >> 32, self.spelled[key & 0xFFFFFFFF]
                self.crc.append(zlib.crc32(b" " + word, self.crc[parent]) if parent else zlib.crc32(word))
            out[i] = node
        return out

    def _buckets(self) -> np.ndarray:
        """Buckets of all nodes; those of new ones are added."""
        self.bucket = np.concatenate([self.bucket, (np.array(self.crc[len(self.bucket) :], np.int64) % self.buckets).astype(np.int32)])
        return self.bucket

    def paths(self, coded: Coded):
        """For each length of a run: (nodes of all runs of that length, the position of each one's first word)."""
        words = np.empty(len(coded.words), np.int64)
        for i, w in enumerate(coded.words.to_pylist()):
            w = w.encode()
            at = self.ids.get(w)
            if at is None:
                at = self.ids[w] = len(self.spelled)
                self.spelled.append(w)
            words[i] = at
        n = len(coded.codes)
        node, at, last = np.zeros(n, np.int64), np.arange(n), np.repeat(coded.bounds[1:], coded.counts)
        for k in range(self.depth):
            fits = at + k < last[at]
            node, at = node[fits], at[fits]
            keys, inverse = np.unique(node << 32 | words[coded.codes[at + k]], return_inverse=True)
            node = self._nodes(keys)[inverse]
            yield node, at

    def count(self, coded: Coded) -> None:
        for nodes, _ in self.paths(coded):
            seen = np.bincount(nodes, minlength=len(self.crc))
            seen[: len(self.counts)] += self.counts
            self.counts = seen

    def totals(self) -> np.ndarray:
        """Counts of features by bucket."""
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, self._buckets()[1 : len(self.counts)], self.counts[1:])
        return out

    def weights(self, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Number of features and the sum of their gains, by document."""
        n, total = np.zeros((2, len(coded.counts)), np.int64)
        doc = coded.doc_of_word()
        for nodes, at in self.paths(coded):
            running = np.concatenate([[0], np.cumsum(self.gain_of_bucket[self._buckets()[nodes]])])
            ends = np.searchsorted(doc[at], np.arange(len(n) + 1))
            n += np.diff(ends)
            total += np.diff(running[ends])
        return n, total


def bucket_totals(texts: DataFrame, depth: int, buckets: int, text_col: str = "text") -> DataFrame:
    """bucket, n: features of all texts; a task emits at most ``buckets`` rows."""

    def run(batches):
        trie, total = Trie(depth, buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, coded in coded_chunks(b.column(0), LETTERS_DIGITS, CHUNK):
                trie.count(coded)
                if len(trie.crc) > NODES:
                    total += trie.totals()
                    trie.clear()
        total += trie.totals()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets, from bucket totals; at most 2 B rows reach the driver."""
    counts = []
    for totals in (raw, target):
        n = np.zeros(buckets, np.int64)
        for r in totals.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n)
    s, t = counts
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + buckets) / ((x + 1.0) * (all_t + buckets)))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def score_documents(docs: DataFrame, gains: np.ndarray, depth: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain, 0 without features) of each row."""
    buckets, shared = len(gains), docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches):
        trie = Trie(depth, buckets, shared.value)
        for b in batches:
            for first, end, coded in coded_chunks(b.column(1), LETTERS_DIGITS, CHUNK):
                n, total = trie.weights(coded)
                if len(trie.crc) > NODES:
                    trie.clear()
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), *map(pa.array, (coded.counts.astype(np.int64), n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a uniform number made from the id: the same on each run. A null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """scored (a written table with eligible, score, doc_id) with rank: the floor(percent N / 100) highest scores of the N eligible rows, ties to the smaller doc_id.

    A histogram of the scores (whole numbers in a range that gains and noise bound) tells which score the draw ends in. Rows of that score or
    above are counted by value, dealt out by ranges of (score, doc_id) and ranked by the counts before them. Null ids come
    last among equal scores; equal rows are numbered in turn, so some copies of a row may be drawn and others not.
    """
    columns = scored.columns
    n = scored.filter("eligible").count()
    take = percent * n // 100
    hist = scored.filter("eligible").groupBy("score").count()
    above = hist.withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("score"))))
    last = above.filter(F.col("upto") >= take).agg(F.max("score")).first()[0]
    drawable = F.col("eligible") & (F.col("score") >= F.lit(last)) if take else F.lit(False)
    rest = scored.filter(~drawable).withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), *[F.col(c) for c in columns if c not in ("score", "doc_id", "eligible")]]
    rows = scored.filter(drawable).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    dealt = scratch.save(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "drawable")
    before = dealt.groupBy("__part").agg(F.sum("__n").alias("__all")).withColumn("__before", F.sum("__all").over(Window.orderBy("__part")) - F.col("__all"))  # one row a partition
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("__upto", inside).join(before.drop("__all"), "__part").withColumn("__first", F.col("__before") + F.col("__upto") - F.col("__n"))
    blocks = placed.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))
    copies = blocks.withColumn("__copy", F.explode(F.sequence(F.col("__at"), F.least(F.col("__at") + COPIES, F.col("__n")) - 1)))
    rank = F.col("__first") + F.col("__copy") + 1
    return copies.select(*columns, F.when(rank <= take, rank).alias("rank")).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs: a draw without replacement towards the texts of target.

    Words are runs of letters and digits, with A-Z lower-cased; features are all runs of 1 to n words. Rows of at least
    min_words words take part in the draw. Null and empty texts have no words and weight 0 and are not drawn. Rows without id share one
    noise value. Repeated rows are scored alike and ranked in turn. A very long text is coded as a chunk of its own. An empty
    docs gives an empty result, an empty target leaves the gains to the corpus alone. Other columns, of any names, are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_totals(docs, n, buckets, text_col), bucket_totals(target, n, buckets, target_text_col), buckets)
    rows = score_documents(docs, gains, n, id_col, text_col)
    scored = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= min_words)
    return draw(scratch.save(scored, "scored"), percent, scratch).drop("eligible")


def op13_resample(spark, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn towards the benchmark's distribution of words."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC of each distinct word is folded over its bytes, its table over the eight steps of a byte.
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([b::UBIGINT] || range(8)::UBIGINT[], lambda x, k: xor(x // 2, (x % 2) * 3988292384::UBIGINT)) ORDER BY b) AS t FROM range(256) r(b)
), words AS (
  SELECT 0 AS part, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), runs AS (
  SELECT part, doc_id, w, count(*) AS n FROM words GROUP BY ALL
), buckets AS (
  SELECT w, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::UBIGINT),
    lambda c, b: xor(c // 256, t[1 + (xor(c, b) % 256)::BIGINT])), 4294967295::UBIGINT) % 10000 AS b
  FROM (SELECT DISTINCT w FROM runs), crc_table
), totals AS (
  SELECT b, sum(n) FILTER (part = 0) AS s, sum(n) FILTER (part = 1) AS t FROM runs JOIN buckets USING (w) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain
  FROM totals, (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM totals)
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS g FROM runs JOIN buckets USING (w) JOIN gains USING (b) WHERE part = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(g // n_features - (g % n_features < 0)::BIGINT, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT AS h
  FROM documents LEFT JOIN weighed USING (doc_id)
), final AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM final WHERE n_features >= 20
)
SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM final f LEFT JOIN ranked USING (doc_id)
"""
