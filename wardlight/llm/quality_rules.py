"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditional expressions.

Text statistics come from one vectorised pass over whole texts. Rules are conjunctions of thresholds on
ratios of these statistics: grown literal by literal for the FOIL gain on two thirds of the labelled
rows, pruned on the last third, kept while they stay precise there; covered rows leave, the next rule is
grown. The list becomes one ``when`` chain that Spark evaluates over all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardlight.llm.scratch import Scratch, bounded_sample
from wardlight.llm.textkernel import SPACE, Words, mix, text_chunks, windows

#: Labelled rows the rules are learned from at most, taken by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: A rule must be this precise on the pruning rows, and cover so many rows.
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_LITERALS = 0.9, 3, 12, 3

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "!?"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct"]
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(h: np.ndarray, at: np.ndarray, words: Words, width: int) -> np.ndarray:
    """Words in windows found twice or more in their document."""
    n, covered = len(words.hash), np.zeros(len(words.hash) + 1, np.int64)
    if len(h):
        doc = np.searchsorted(words.bounds, at, side="right") - 1
        key = mix(h ^ mix(doc.astype(np.uint64), 3))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    return _per_doc(np.cumsum(covered)[:n] > 0, words.bounds)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the document; all lines with a word."""
    dups, lines = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for d in range(len(offsets) - 1):
        parts = [x for x in raw[offsets[d] : offsets[d + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[d], dups[d] = len(parts), len(parts) - len(set(parts))
    return dups, lines


def text_counts(column: pa.Array) -> pd.DataFrame:
    """COUNTS of each text, over whole texts."""
    out = []
    for _, _, data, offsets in text_chunks(column):
        w = Words(data, offsets, fold=False)
        data, offsets = w.data, w.offsets
        h, at = windows(w.hash, w.bounds, 8)
        dups, lines = _dup_lines(data, offsets)
        doc = w.doc_of_word()
        order = np.lexsort((w.hash, doc)) if len(w.hash) else np.zeros(0, np.int64)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        upper, lower = UPPER[data], LOWER[data]
        out.append(pd.DataFrame({
            "n_words": w.counts, "word_chars": _per_doc(LEAD[data] & ~SPACE[data], offsets), "n_symbols": _per_doc(SYMBOLS[data], offsets),
            "n_dup_lines": dups, "n_repeat_words": _repeats(h, at, w, 8), "n_lines": lines,
            "n_upper": _per_doc(upper, offsets), "n_letters": _per_doc(upper | lower, offsets), "n_digits": _per_doc(DIGIT[data], offsets),
            "n_marks": _per_doc(MARK[data], offsets), "n_distinct": _per_doc(fresh, w.bounds),
        }))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: pd.Series(dtype="int64") for k in COUNTS})


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus COUNTS, which replace columns of these names; a null text has none of anything."""
    docs = docs.drop(*COUNTS)
    out = StructType([*docs.schema.fields, *(StructField(k, LongType()) for k in COUNTS)])

    def run(batches):
        for b in batches:
            counts = text_counts(b.column(text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(counts[k].to_numpy()) for k in COUNTS)], names=[*b.schema.names, *COUNTS])

    return docs.mapInArrow(run, out)


def features() -> dict[str, Column]:
    return {k: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0) for k, (a, b) in FEATURES.items()}


def _holds(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, t in rule:
        ok &= (x[:, f] >= t) if above else (x[:, f] < t)
    return ok


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 1) -> list[list[tuple[int, bool, float]]]:
    """Ordered rejecting rules; a literal is (feature, at least / below, threshold)."""
    fold = np.random.default_rng(seed).permutation(len(x)) % 3
    grow, prune, rules = fold != 2, fold == 2, []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (left & bad & grow).sum() >= MIN_COVER:
        rows, rule = left & grow, []
        while len(rule) < MAX_LITERALS:
            inside = rows & _holds(x, rule)
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if not n0 or not p0:
                break
            best = (0.0, None)
            for f in range(x.shape[1]):
                v, y = x[inside, f], bad[inside]
                order = np.argsort(v, kind="stable")
                v, y = v[order], y[order]
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                if not len(cut):
                    continue
                below_p, below_n = np.concatenate([[0], np.cumsum(y)])[cut], np.concatenate([[0], np.cumsum(~y)])[cut]
                for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= MIN_COVER, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (f, above, float((v[cut[k]] + v[cut[k] - 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
        worth = lambda r: ((m := left & prune & _holds(x, r)) & bad).sum() - (m & ~bad).sum()
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = left & _holds(x, rule)
        checked = got & prune if (got & prune).sum() >= MIN_COVER else got
        if not rule or (got & bad).sum() < MIN_COVER or (checked & bad).sum() < MIN_PRECISION * checked.sum():
            break
        rules.append(rule)
        left &= ~got
    return rules


def rejects(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """The decision list as one ordered conditional expression."""
    cols, names = features(), list(FEATURES)
    chain = None
    for rule in rules:
        test = F.lit(True)
        for f, above, t in rule:
            test = test & ((cols[names[f]] >= t) if above else (cols[names[f]] < t))
        chain = F.when(test, True) if chain is None else chain.when(test, True)
    return F.lit(False) if chain is None else chain.otherwise(False)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs plus COUNTS, base_failed and kept.

    labels: doc_id, quality (1 good, 0 bad; null is ignored; an id with contradicting labels is good). Rules are learned from at most sample_rows
    labelled rows, those of them that pass the base rules; without labels of both kinds there are no rules and only the
    base rules reject. Null or empty texts count nothing and fail the base rules. Rows that repeat an id are judged
    each by its own text. An empty table gives an empty result; other columns pass through.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    counted = scratch.save(with_counts(docs, text_col), "counted")
    marks = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__q")).groupBy("__id").agg(F.max("__q").alias("__q"))
    shares = [c.alias(k) for k, c in features().items()]
    drawn = bounded_sample(marks, "__id", sample_rows)
    rows = counted.filter(~base_failed()).select(F.col(id_col).alias("__id"), *shares).join(F.broadcast(drawn), "__id").orderBy(F.xxhash64("__id", F.lit(97)), "__id", *FEATURES).limit(sample_rows).toPandas()
    x, bad = rows[list(FEATURES)].to_numpy(float), rows["__q"].to_numpy() == 0
    rules = learn_rules(x, bad) if len(rows) and bad.any() and not bad.all() else []
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejects(rules))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and rules learned from the labels: doc_id, five counts, base_failed, kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", *COUNTS[:5], "base_failed", "kept")
