"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded as the sum of the rows of its hash and of its hashed prefixes, so inflected forms
share what their stem has learned. Filters one, two and three words wide run over the whole text, each
filter is max-pooled, and a logistic layer gives the score. The first embedding dimension starts from the
lower confidence bound of a hash bucket's log-odds, the rest from small noise; all weights are then trained
together by Adam. Scores are calibrated on held-back rows; decision thresholds by language
are an extra output and never feed the score.

``train_all`` learns from every labelled row: shards of a bounded size go over their rows, and the driver averages what they changed, a few times
over. ``train`` learns from a bounded sample in one place.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wardlight.llm.scratch import Scratch, bounded_sample
from wardlight.llm.textkernel import Words, mix, text_chunks

#: Rows and bytes of text of a shard, about; times that the shards' changes are averaged, and passes over its rows a shard makes each time.
SHARD_ROWS, SHARD_BYTES, ROUNDS, PASSES = 4_000, 32 << 20, 4, 2
#: Steps of a unit in which changes are summed, so that their order does not matter; of a logit in which held-back rows are counted. Labels that are broadcast at most.
STEPS, BINS, LABELS = 1 << 40, 1_024, 1_000_000
#: Of ``train`` alone: labelled rows to learn from at most, taken by a hash of doc_id, and bytes of their texts at most.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 48 << 20
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 17, 4, 4, (1, 2, 3), (4, 5, 6)
EPOCHS, BATCH, RATE = 8, 64, 0.02


def piece_ids(words: Words) -> np.ndarray:
    """Embedding rows of each word: one for the word, one for each prefix width."""
    hashes = [mix(words.hash, 11), *(mix(h, 11 + k) for k, h in zip(PREFIXES, words.prefix))]
    return np.stack([(h & np.uint64(BUCKETS - 1)).astype(np.int32) for h in hashes], axis=1)


def pieces_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The embedding rows of each text of a column."""
    for _, _, data, offsets in text_chunks(column):
        w = Words(data, offsets, fold=True, prefixes=PREFIXES)
        ids = piece_ids(w)
        yield from (ids[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:]))


def seen_counts(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How many texts of either label hold each bucket."""
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(texts, y):
        seen[int(label), np.unique(ids)] += 1
    return seen


class ConvNet:
    """Weights and the forward pass; ``fit`` trains them from texts and 0/1 labels."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
        self.emb[:, 0] = 0
        self.conv = [rng.normal(0, 0.1, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w, c in zip(WIDTHS, self.conv):
            c[::DIM, :] += 0.5 / w
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.out_bias = np.float32(-2.0)
        self.scale, self.shift = 1.0, 0.0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self._params()]
        self.bias_moment, self.step = [0.0, 0.0], 0

    def _params(self) -> list[np.ndarray]:
        return [self.out, *self.conv, *self.bias]

    def dense(self) -> np.ndarray:
        """All that training changes but the embeddings, as one vector."""
        return np.concatenate([*(np.ravel(p).astype(np.float64) for p in [*self._params(), *(x for pair in self.moments for x in pair)]), [self.out_bias, *self.bias_moment, self.step]])

    def set_dense(self, v: np.ndarray) -> None:
        at = 0
        for p in [*self._params(), *(x for pair in self.moments for x in pair)]:
            p[...] = v[at : at + p.size].reshape(p.shape)
            at += p.size
        self.out_bias, self.bias_moment, self.step = np.float32(v[at]), [float(x) for x in v[at + 1 : at + 3]], round(float(v[at + 3]))

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max over positions of each filter for one text, and where it lies; zero if the text is too short."""
        v = self.emb[ids].sum(axis=1)
        top, where = [], []
        for w, c, b in zip(WIDTHS, self.conv, self.bias):
            if len(v) < w:
                top.append(np.zeros(FILTERS, np.float32))
                where.append(np.full(FILTERS, -1))
                continue
            z = v[: len(v) - w + 1] @ c[:DIM]
            for j in range(1, w):
                z += v[j : len(v) - w + 1 + j] @ c[j * DIM : (j + 1) * DIM]
            at = z.argmax(axis=0)
            best = z[at, np.arange(FILTERS)] + b
            top.append(np.maximum(best, 0))
            where.append(np.where(best > 0, at, -1))
        return np.concatenate(top), where

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.out + self.out_bias)

    def _start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        self._start_from(seen_counts(texts, y), (y == 0).sum(), (y == 1).sum())

    def _start_from(self, seen: np.ndarray, n0: int, n1: int) -> None:
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        bound = odds - np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
        self.emb[:, 0] = np.where((seen[1] >= 3) & (bound > 0), bound, 0)

    def fit(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        y = np.asarray(y, np.float32)
        if not len(y) or y.min() == y.max():
            self.out[:], self.out_bias = 0, np.float32(4.0 if len(y) and y.max() else -4.0)
            return
        back = np.arange(len(y)) % 4 == 3
        if not 0 < y[back].sum() < back.sum() or not 0 < y[~back].sum() < (~back).sum():
            back[:] = False
        learn = np.flatnonzero(~back)
        self._start([texts[i] for i in learn], y[learn])
        self.learn(texts, y, learn, EPOCHS)
        if back.any():
            self._calibrate(np.array([self.logit(texts[i]) for i in np.flatnonzero(back)]), y[back])

    def learn(self, texts: list[np.ndarray], y: np.ndarray, learn: np.ndarray, passes: int) -> None:
        """Passes over the rows numbered in learn; Adam goes on from where it stands."""
        params, bias_moment = self._params(), self.bias_moment
        for _ in range(passes):
            order = self.rng.permutation(learn)
            for first in range(0, len(order), BATCH):
                rows, self.step = order[first : first + BATCH], self.step + 1
                grads, g_bias, touched = [np.zeros_like(p) for p in params], 0.0, []
                for i in rows:
                    h, where = self.pooled(texts[i])
                    g = 1 / (1 + np.exp(-(h @ self.out + self.out_bias))) - y[i]
                    grads[0] += g * h
                    g_bias += g
                    for k, w in enumerate(WIDTHS):
                        for f in np.flatnonzero(where[k] >= 0):
                            at, gz = where[k][f], g * self.out[k * FILTERS + f]
                            span = texts[i][at : at + w]
                            grads[1 + k][:, f] += gz * self.emb[span].sum(axis=1).ravel()
                            grads[1 + len(WIDTHS) + k][f] += gz
                            touched.append((span, gz * self.conv[k][:, f].reshape(w, 1, DIM)))
                fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
                for p, d, (m, s) in zip(params, grads, self.moments):
                    d /= len(rows)
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    p -= RATE * fix * m / (np.sqrt(s) + 1e-8)
                bias_moment[0] += 0.1 * (g_bias / len(rows) - bias_moment[0])
                bias_moment[1] += 0.001 * ((g_bias / len(rows)) ** 2 - bias_moment[1])
                self.out_bias -= np.float32(RATE * fix * bias_moment[0] / (np.sqrt(bias_moment[1]) + 1e-8))
                for span, d in touched:
                    np.subtract.at(self.emb, span, (RATE / len(rows)) * np.broadcast_to(d, (*span.shape, DIM)))

    def _calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> None:
        """Platt scaling with smoothed targets and a weak pull towards the identity; n rows have each logit and label."""
        n = np.broadcast_to(n, y.shape)
        n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            r, w = n * (p - goal), n * np.maximum(p * (1 - p), 1e-6)
            g = np.array([(r * z).sum() + 1.0 * (a - 1), r.sum() + 0.1 * b])
            hess = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            d = np.linalg.solve(hess, g)
            a, b = max(0.05, a - d[0]), b - d[1]
        self.scale, self.shift = float(a), float(b)

    def logits(self, column: pa.Array) -> np.ndarray:
        """Of each text, before the calibration."""
        return np.array([self.logit(ids) for ids in pieces_of(column)], np.float64)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(column) + self.shift, -60, 60)))


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list, least: int = 10) -> dict:
    """The threshold of best F1 for each language with enough labelled rows of both kinds, else 0.5."""
    found = {}
    for lang in set(langs):
        at = np.array([x == lang for x in langs])
        s, t = scores[at], y[at]
        if lang is None or min(t.sum(), len(t) - t.sum()) < least:
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
        k = int(np.argmax(f1))
        below = s[order][k + 1] if k + 1 < len(s) else 0.0
        found[lang] = float((s[order][k] + below) / 2)
    return found


def chosen_sizes(sizes: list[int], bound: int) -> list[bool]:
    """Which texts are taken, in order, so that they fit the bound together: one that does not fit what is left is passed over and changes nothing for the others."""
    out, left = [], bound
    for n in sizes:
        out.append(n <= left)
        left -= n if n <= left else 0
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[ConvNet, dict]:
    """From docs (doc_id, text, lang) and labels (doc_id, toxic).

    An id has one label: 1 if any of its labels says so; null labels and ids, and labels without a document, count for nothing. At most
    sample_rows labels are drawn and broadcast. Of their rows, in the order of a hash, rows that repeat an id too, at most sample_rows are taken whose texts fit
    SAMPLE_BYTES together; a text that does not fit is passed over. Which ones is settled on sizes and hashes, and only the chosen texts leave the
    scan. Null texts read as empty. Other columns are ignored. Without labels of both kinds, or with an empty table, the net gives every
    text one score; labelled rows of which not one fits are an error.
    """
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = bounded_sample(one, "doc_id", sample_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), "lang", F.xxhash64(text).alias("same")).join(F.broadcast(drawn), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(97)), F.col("doc_id"), F.col("same")]
    sized = rows.select("doc_id", "same", F.octet_length("text").alias("size")).orderBy(*order).limit(sample_rows).collect()  # at most sample_rows small rows
    taken = {(r["doc_id"], r["same"]) for r, fits in zip(sized, chosen_sizes([r["size"] for r in sized], SAMPLE_BYTES)) if fits}
    if sized and not taken:
        raise ValueError(f"none of {len(sized)} labelled texts fits {SAMPLE_BYTES} bytes")
    picked = docs.sparkSession.createDataFrame(sorted(taken), "doc_id long, same long")
    rows = rows.join(F.broadcast(picked), ["doc_id", "same"]).drop("same").dropDuplicates(["doc_id", "text", "lang"]).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
    column = rows.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    texts = list(pieces_of(column))
    y = np.array(rows.column("toxic").to_pylist(), np.float32)
    net = ConvNet()
    net.fit(texts, y)
    langs = rows.column("lang").to_pylist()
    back = np.arange(len(y)) % 4 == 3
    z = np.array([net.logit(t) for t, b in zip(texts, back) if b])
    return net, language_thresholds(1 / (1 + np.exp(-(net.scale * z + net.shift))), y[back], [x for x, b in zip(langs, back) if b])


def _labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text, lang, toxic, same (a hash of the text) and back (held back for the calibration, a quarter) of all documents with a label."""
    one = scratch.save(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), "lang").join(F.broadcast(one) if one.count() <= LABELS else one, "doc_id")
    rows = rows.withColumn("same", F.xxhash64("text")).withColumn("back", F.pmod(F.xxhash64("doc_id", F.lit(98)), F.lit(4)) == 3)
    return scratch.save(rows, "labelled")


def _summed(shards: DataFrame, work, scratch: Scratch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k, the sums of v and how many shards gave a row, over what work(key, rows of a shard) gives: a row a bucket and a few more at most."""
    sums = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]
    got = scratch.save(shards.groupBy("shard").applyInPandas(work, "k int, v array<long>").groupBy("k").agg(*sums, F.count(F.lit(1)).alias("n")), name).toArrow()
    return got["k"].to_numpy(), np.stack([got[f"v{i}"].to_numpy() for i in range(DIM)], axis=1), got["n"].to_numpy()


def _texts_of(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces and labels of a shard's rows in a fixed order, equal rows once."""
    pdf = pdf.drop_duplicates(["doc_id", "same", "lang"]).sort_values(["doc_id", "same", "lang"], na_position="first")
    return list(pieces_of(pa.array(pdf["text"], pa.string()))), pdf["toxic"].to_numpy(np.float32)


def _step(shared, r: int, width: int):
    """What passes over a shard change in the net: a row an embedding it moved, and the ``width`` other numbers, in units of 1 / STEPS."""

    def step(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        texts, y = _texts_of(pdf)
        new = copy.deepcopy(shared.value)
        new.rng = np.random.default_rng([int(key[0]), r])
        new.learn(texts, y, np.arange(len(y)), PASSES)
        moved = new.emb.astype(np.float64) - shared.value.emb
        at = np.flatnonzero(moved.any(axis=1))
        rest = np.zeros(-(-width // DIM) * DIM)
        rest[:width] = new.dense() - shared.value.dense()
        rest = rest.reshape(-1, DIM)
        return pd.DataFrame({"k": [*at, *range(BUCKETS, BUCKETS + len(rest))], "v": list(np.rint(np.concatenate([moved[at], rest]) * STEPS).astype(np.int64))})

    return step


def train_all(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[ConvNet, DataFrame]:
    """From docs (doc_id, text, lang) and labels (doc_id, toxic): the net, and lang, threshold of each language with enough held-back rows of both kinds.

    All labelled rows are learned from. An id has one label: 1 if any of its labels says so; null labels and ids, and labels without a document, count for
    nothing. Rows are dealt to shards by a hash. The log-odds to start from are counted over all shards. Then each shard goes over its rows from the same net, and the driver,
    which holds the net alone, averages the changes: those of an embedding row over the shards that changed it. A last pass counts the logits of the rows held back, in
    steps of 1 / BINS, for calibration and thresholds. One shard, as of a small table, is plain training. Without labels of both kinds the net gives every text one score.
    """
    rows, net = _labelled(docs, labels, scratch), ConvNet()
    sizes = rows.select("doc_id", "same", "lang", "back", "toxic", F.octet_length("text").alias("size")).distinct()
    kinds = sizes.groupBy("back", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()  # four rows at most
    n = {(r["back"], r["toxic"]): r["n"] for r in kinds}
    none = docs.sparkSession.createDataFrame([], "lang string, threshold double")
    if len({r["toxic"] for r in kinds}) < 2:
        net.fit([], np.array([r["toxic"] for r in kinds]))
        return net, none
    calibrated = len(n) == 4
    shards = max(1, math.ceil(sum(n.values()) / SHARD_ROWS), math.ceil(sum(r["bytes"] for r in kinds) / SHARD_BYTES))
    dealt = (rows.filter("not back") if calibrated else rows).withColumn("shard", F.pmod(F.xxhash64("doc_id", "same", F.lit(99)), F.lit(shards)).cast("int"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, y = _texts_of(pdf)
        seen = np.column_stack([*seen_counts(texts, y), *[np.zeros(BUCKETS)] * (DIM - 2)]).astype(np.int64)
        at = np.flatnonzero(seen.any(axis=1))
        total = [int((y == 0).sum()), int((y == 1).sum()), *[0] * (DIM - 2)]
        return pd.DataFrame({"k": [*at, BUCKETS], "v": [*seen[at], total]})

    k, v, _ = _summed(dealt, count, scratch, "seen")
    seen = np.zeros((BUCKETS + 1, DIM))
    seen[k] = v
    net._start_from(seen[:BUCKETS, :2].T, seen[BUCKETS, 0], seen[BUCKETS, 1])

    width = len(net.dense())
    for r in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(net)  # BUCKETS * DIM floats

        k, v, times = _summed(dealt, _step(shared, r, width), scratch, f"round{r}")
        shared.destroy()
        change = np.zeros((BUCKETS + -(-width // DIM), DIM))
        change[k] = v / (STEPS * times[:, None])
        net.emb = (net.emb + change[:BUCKETS]).astype(np.float32)
        net.set_dense(net.dense() + change[BUCKETS:].ravel()[:width])

    if not calibrated:
        return net, none
    z = F.round(F.greatest(F.least("z", F.lit(60.0)), F.lit(-60.0)) * BINS).cast("long")
    back = score_texts(rows.filter("back"), net, out_col="z", of=ConvNet.logits).select("doc_id", "same", "lang", "toxic", z.alias("z")).distinct()
    bins = scratch.save(back.groupBy("lang", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")), "bins")
    every = bins.groupBy("z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).orderBy("z").toArrow()  # 120 * BINS + 1 at most
    z, n, hits = (every[c].to_numpy() for c in ("z", "n", "hits"))
    net._calibrate(np.tile(z / BINS, 2), np.repeat([1.0, 0.0], len(z)), np.concatenate([hits, n - hits]))
    return net, scratch.save(_thresholds(bins, net), "thresholds")


def _thresholds(bins: DataFrame, net: ConvNet, least: int = 10) -> DataFrame:
    """lang, threshold: as ``language_thresholds``, from the number and the hits of rows of each lang and binned logit."""
    down = Window.partitionBy("lang").orderBy(F.desc("z"))
    every, so_far = Window.partitionBy("lang"), down.rowsBetween(Window.unboundedPreceding, 0)
    score = lambda c: 1 / (1 + F.exp(-(F.lit(net.scale) * F.col(c) / BINS + F.lit(net.shift))))
    rows = bins.filter("lang is not null").select("lang", "z", F.lead("z").over(down).alias("below"), F.sum("n").over(so_far).alias("taken"), F.sum("hits").over(so_far).alias("caught"), F.sum("n").over(every).alias("n"), F.sum("hits").over(every).alias("toxic"))
    rows = rows.filter((F.col("toxic") >= least) & (F.col("n") - F.col("toxic") >= least)).withColumn("f1", 2 * F.col("caught") / (F.col("taken") + F.col("toxic")))
    best = rows.groupBy("lang").agg(F.max_by(F.struct("z", "below"), F.struct("f1", "z")).alias("at")).select("lang", "at.*")
    return best.select("lang", ((score("z") + F.coalesce(score("below"), F.lit(0.0))) / 2).alias("threshold"))


def score_texts(docs: DataFrame, net: ConvNet, text_col: str = "text", out_col: str = "score", of=ConvNet.scores) -> DataFrame:
    """docs plus the score of each whole text (or what ``of`` gives for it); null reads as empty. A column named out_col is replaced."""
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # BUCKETS * DIM floats

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(shared.value, b.column(text_col)), pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from all labelled rows whose crc32(doc_id) mod 5 is not 0; scores all documents.

    Null and empty texts get the score of a text without words. Without labels of both kinds all texts
    get one score. Repeated rows get equal scores. Of contradicting labels of one id the toxic one counts.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net, thresholds = train_all(docs, labels.filter(~held), Scratch(spark, "toxicity"))
    scored = score_texts(docs, net).select("doc_id", "lang", "score").join(thresholds, "lang", "left")
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= F.coalesce("threshold", F.lit(0.5))).cast("int").alias("over_lang_threshold")
    )
