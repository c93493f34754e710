"""LM scoring: deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the octave of the context count c(v).
The weights are learned by expectation-maximisation on deleted counts: each training token is held out of
the counts that predict it. All training tokens take part, binned by their deleted estimates.

Counts are exchanged in blocks. A chunk of documents keeps its token sequence as codes into its own sorted
vocabulary; it asks for the counts of its distinct unigrams and bigrams, in sorted order and cut into hash
buckets, as many as the tokens ask for. A bucket's task adds up the counts of all chunks and answers each in the order it asked. So the
exchange moves distinct n-grams of a chunk, not tokens, and no vocabulary is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch
from wardlight.llm.textkernel import U64, Words, mix, text_chunks

END, START = U64(0x0E4D0E4D0E4D0E4D), U64(0x57A257A257A257A2)
#: Bytes of text of one chunk, and n-grams asked for in one bucket at most on average: they bound a task's memory, not what is counted.
CHUNK_TEXT, BUCKET_GRAMS = 8 << 20, 1 << 20
#: Requests of one chunk that go to Spark together.
BATCH_ROWS = 4_096
#: Bytes of chunks or texts that a Python worker gets at once, and that Spark decodes at once: a row of chunks has megabytes, so rows must not be counted. One chunk may be longer.
BATCH_BYTES = 16 << 20
BOUNDED = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
#: Octaves of context counts, bins a power of two, and bins of an estimate: at most OCTAVES * BINS**2 cells reach the driver.
OCTAVES, FINE, BINS = 32, 4, 256

CHUNKS = "chunk string, n_tokens long, n_train long, n_train_docs long, ids array<long>, known array<boolean>, held array<boolean>, lengths array<int>, codes array<int>, vocab array<long>"
LISTS = ("ids", "known", "held", "lengths", "codes", "vocab")


def _list(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list of the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _chunks(batches):
    """Documents (doc_id, held, text) as chunks; one row each."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    pool: list[tuple] = []
    size = made = 0

    def flush():
        nonlocal pool, size, made
        tokens, lengths, held, ids, known = (np.concatenate([p[i] for p in pool]) for i in range(5))
        pool, size = [], 0
        vocab, codes = np.unique(tokens, return_inverse=True)
        made += 1
        return pa.RecordBatch.from_arrays([
            pa.array([f"{part}-{made}"]), pa.array([len(tokens)]), pa.array([int(lengths[~held].sum())]), pa.array([int((~held).sum())]),
            _list(ids, pa.int64()), _list(known, pa.bool_()), _list(held, pa.bool_()), _list(lengths.astype(np.int32), pa.int32()), _list(codes.astype(np.int32), pa.int32()), _list(_signed(vocab), pa.int64()),
        ], names=["chunk", "n_tokens", "n_train", "n_train_docs", "ids", "known", "held", "lengths", "codes", "vocab"])

    for b in batches:
        held_col, known_col = b.column("held").to_numpy(zero_copy_only=False).astype(bool), b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        id_col = b.column("doc_id").fill_null(0).to_numpy()
        for first, end, data, offsets in text_chunks(b.column("text")):
            w = Words(data, offsets, fold=True)
            n = w.counts + 1
            tokens = np.full(int(n.sum()), END)
            tokens[np.arange(len(w.hash)) + w.doc_of_word()] = w.hash
            pool.append((tokens, n.astype(np.int64), held_col[first:end], id_col[first:end], known_col[first:end]))
            size += int(offsets[-1] - offsets[0])
            if size >= CHUNK_TEXT:
                yield flush()
    if pool:
        yield flush()


class Chunk:
    """A chunk's tokens with its distinct unigrams and bigrams in the order in which counts are asked for."""

    def __init__(self, row: dict):
        self.name, self.ids, self.known = row["chunk"], np.asarray(row["ids"]), np.asarray(row["known"], bool)
        self.held, self.lengths, self.codes = np.asarray(row["held"], bool), np.asarray(row["lengths"], np.int64), np.asarray(row["codes"], np.int64)
        self.vocab = np.asarray(row["vocab"], np.int64).view(U64)
        starts = np.cumsum(self.lengths) - self.lengths
        word = self.vocab[self.codes]
        context = np.concatenate([[START], word[:-1]])
        context[starts] = START
        self.starts, self.train = starts, np.repeat(~self.held, self.lengths)
        self.pairs, self.pair_codes = np.unique(mix(context * U64(0x9E3779B97F4A7C15) ^ mix(word, 21), 22), return_inverse=True)

    def requests(self, buckets: int):
        """(kind, keys, training counts of the chunk, buckets asked, offset of each bucket's keys) for kinds 1 and 2, keys in order; buckets are ranges of keys."""
        for kind, keys, codes in ((1, self.vocab, self.codes), (2, self.pairs, self.pair_codes)):
            counts = np.bincount(codes, weights=self.train, minlength=len(keys)).astype(np.int64)
            bucket = (keys // U64((1 << 64) // buckets + 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield kind, keys, counts, bucket[first], np.append(first, len(keys))

    def counts(self, answers: pd.DataFrame, train_docs: int):
        """Counts of each token's bigram, context and word over the whole corpus."""
        found = {}
        for kind in (1, 2):
            parts = answers[answers["kind"] == kind].sort_values("bucket")
            found[kind] = np.concatenate([*parts["counts"], np.zeros(0, np.int64)])
        c_word = found[1][self.codes]
        c_context = np.concatenate([[0], c_word[:-1]])
        c_context[self.starts] = train_docs
        return found[2][self.pair_codes], c_context, c_word


def octave(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 c)."""
    return np.minimum(np.frexp(c.astype(float))[1], OCTAVES - 1)


def learn_weights(cells: pd.DataFrame, uniform: float, steps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each octave by EM; cells: b, p2, p1 (fine log2 bins, null: zero), n.

    A run ends when a step betters the mean log-likelihood by less than the tolerance. Octaves of fewer than 100 tokens
    take the weights of all tokens.
    """
    p2 = np.where(cells["p2"].isna(), 0, 2.0 ** (-cells["p2"].fillna(0) / FINE))
    p1 = np.where(cells["p1"].isna(), 0, 2.0 ** (-cells["p1"].fillna(0) / FINE))
    p, n, b = np.stack([p2, p1, np.full(len(cells), uniform)], axis=1), cells["n"].to_numpy(float), cells["b"].to_numpy(int)

    def em(rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        w, last = mask / mask.sum(), -np.inf
        for _ in range(steps):
            post = p[rows] * w
            total = post.sum(axis=1)
            likelihood = float((n[rows] * np.log(total)).sum() / n[rows].sum())
            if likelihood - last < tolerance:
                break
            last = likelihood
            w = np.maximum((post / total[:, None] * n[rows, None]).sum(axis=0) / n[rows].sum(), 1e-5 * mask)
            w /= w.sum()
        return w

    every = np.arange(len(p))
    both = em(every, np.ones(3)) if len(p) else np.full(3, 1 / 3)
    weights = np.tile(both, (OCTAVES, 1))
    for o in range(1, OCTAVES):
        rows = np.flatnonzero(b == o)
        if len(rows) and n[rows].sum() >= 100:
            weights[o] = em(rows, np.ones(3))
    weights[0] = em(every, np.array([0.0, 1.0, 1.0])) if len(p) else np.array([0.0, 0.5, 0.5])
    return weights


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Rows where held_out is true are scored but not learned from; a null counts as false. Null and empty texts
    are the end token alone. Repeated rows count as often as they stand. A very long text is a chunk of its own. With
    nothing to learn from, N and V are 0 and all tokens have probability 1. An empty table gives an empty result; other
    columns, of any names, are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    with scratch.settings(**BOUNDED):
        chunks = scratch.save(rows.mapInArrow(_chunks, CHUNKS), "chunks", row_group=BATCH_BYTES)
    zero = F.lit(0).cast("long")
    total = chunks.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("n_tokens", "n_train", "n_train_docs"))).first()
    n_train, train_docs = int(total["n_train"]), int(total["n_train_docs"])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * int(total["n_tokens"]) // BUCKET_GRAMS + 1)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk({"chunk": b.column("chunk")[i].as_py()} | {k: b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in LISTS})
                for kind, keys, counts, asked, at in c.requests(buckets):
                    for lo in range(0, len(asked), BATCH_ROWS):
                        b_of, cut = asked[lo : lo + BATCH_ROWS], at[lo : lo + BATCH_ROWS + 1]
                        k, n, offsets = keys[cut[0] : cut[-1]], counts[cut[0] : cut[-1]], pa.array(cut - cut[0], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([c.name] * len(b_of)), pa.array(b_of, pa.int32()), pa.array(np.full(len(b_of), kind), pa.int32()),
                                pa.ListArray.from_arrays(offsets, pa.array(_signed(k), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32())),
                            ],
                            names=["chunk", "bucket", "kind", "keys", "counts"],
                        )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.groupby("kind"):
            keys, at = np.unique(np.concatenate(part["keys"].to_list()), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(part["counts"].to_list())).astype(np.int64)
            distinct, first = int((sums > 0).sum()), 0
            for chunk, bucket, k in zip(part["chunk"], part["bucket"], part["keys"]):
                out.append((chunk, bucket, kind, sums[at[first : first + len(k)]], distinct if first == 0 else 0))
                first += len(k)
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "counts", "distinct"])

    asked = chunks.mapInArrow(ask, "chunk string, bucket int, kind int, keys array<long>, counts array<int>")
    with scratch.settings(**BOUNDED):
        answers = scratch.save(asked.groupBy("bucket").applyInPandas(answer, "chunk string, bucket int, kind int, counts array<long>, distinct long"), "answers", row_group=BATCH_BYTES)
    n_vocab = int(answers.filter("kind = 1").agg(F.coalesce(F.sum("distinct"), zero)).first()[0])

    def bins(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Deleted estimates of the training tokens, binned."""
        out = []
        for row in left.to_dict("records"):
            c = Chunk(row)
            c2, c1, c0 = (x[c.train] for x in c.counts(right, train_docs))
            with np.errstate(divide="ignore", invalid="ignore"):
                p2 = np.where(c2 > 1, np.minimum(np.rint(-np.log2((c2 - 1) / (c1 - 1)) * FINE), BINS - 2), BINS - 1)
                p1 = np.where(c0 > 1, np.minimum(np.rint(-np.log2((c0 - 1) / (n_train - 1)) * FINE), BINS - 2), BINS - 1)
            cell, n = np.unique(((octave(c1) * BINS + p2) * BINS + p1).astype(np.int64), return_counts=True)
            out.append(pd.DataFrame({"cell": cell, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"cell": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})

    met = chunks.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "kind", "counts").groupBy("chunk"))
    cells = scratch.save(met.applyInPandas(bins, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells").toPandas()  # at most OCTAVES * BINS**2
    part = lambda by: (cells["cell"].to_numpy(np.int64) // by) % BINS
    none = lambda x: np.where(x == BINS - 1, np.nan, x)
    weights = learn_weights(pd.DataFrame({"b": cells["cell"] // BINS**2, "p2": none(part(BINS)), "p1": none(part(1)), "n": cells["n"]}), 1 / (n_vocab + 1))

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            c = Chunk(row)
            c2, c1, c0 = c.counts(right, train_docs)
            w = weights[octave(c1)]
            p = w[:, 0] * (c2 / np.maximum(c1, 1)) + w[:, 1] * (c0 / max(n_train, 1)) + w[:, 2] / (n_vocab + 1) if n_train else np.ones(len(c0))
            base = np.log10((c0 + 1) / (n_train + n_vocab + 1))
            out.append(pd.DataFrame({
                "doc_id": pd.arrays.IntegerArray(c.ids.astype(np.int64), ~c.known), "held_out": c.held, "n_tokens": c.lengths,
                "n_known": np.add.reduceat((c0 > 0).astype(np.int64), c.starts), "train_tokens": np.int64(n_train),
                "base_score": np.add.reduceat(base, c.starts), "score": np.add.reduceat(np.log10(p), c.starts),
            }))
        return pd.concat(out)

    return met.applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_corpus(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
