"""Language identification, word first: a known word scores by its log frequency in each language, an unseen one by its character n-grams.

Words are runs of letters and marks, lower-cased. Tasks count the words of the labelled documents; Spark adds the counts up by (lang, word), and
takes the n-grams of the padded words from those sums, so all training text counts. A language keeps its most
frequent words and, for each n, its most frequent n-grams: as many as a budget over all languages allows, cut where the histogram of
counts says, so the model that is broadcast has a fixed bound. A word that no language has kept is scored by its longest n-grams of
which some language knows at least one, over those that are known. A text's language has the best mean over its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wardlight.llm.scratch import Scratch
from wardlight.llm.terms import coded_chunks
from wardlight.llm.textkernel import text_chunks

#: Features of the model over all languages: words, and n-grams of each length. They bound what is broadcast.
MODEL_WORDS, MODEL_GRAMS, LONGEST = 200_000, 50_000, 5
#: Languages at most, beyond which learning fails loudly: a feature takes a number for each, so the model is at most 360 MB (7 MB for four languages).
MAX_LANGS = 200
#: log10 penalty of a feature that a language does not have, characters of a word (longer runs are cut into words of this length).
PENALTY, LONG = -7.0, 64
#: Bytes of text scored and counted together, unseen words remembered by a task.
TEXT, COUNT_TEXT, REMEMBERED = 2 << 20, 16 << 20, 200_000
UNKNOWN = "und"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = False


def _words(column: pa.Array, limit: int):
    """Row ranges (first, end) with their words and whether each row has a letter: all that is no letter or mark becomes a space, the rest is lower-cased."""
    for first, end, _, _ in text_chunks(column, limit):
        clean = pc.replace_substring_regex(pc.utf8_lower(column.slice(first, end - first).cast(pa.large_string())), r"[^\p{L}\p{M}]+", " ")
        (_, _, coded), *_ = coded_chunks(clean, NOT_SPACE, 1 << 62)
        if len(coded.words) and pc.max(pc.utf8_length(coded.words)).as_py() > LONG:
            (_, _, coded), *_ = coded_chunks(pc.replace_substring_regex(clean, rf"([^ ]{{{LONG}}})", r"\1 "), NOT_SPACE, 1 << 62)
        yield first, end, coded, pc.fill_null(pc.match_substring_regex(clean, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _count_words(batches):
    """Rows (lang, text) as counts of each word by language, a chunk at a time."""
    for b in batches:
        coded_lang = b.column("lang").dictionary_encode()
        lang = coded_lang.indices.to_numpy().astype(np.int64)
        for first, end, coded, _ in _words(b.column("text"), COUNT_TEXT):
            n_words = max(1, len(coded.words))
            cell, n = np.unique(np.repeat(lang[first:end], coded.counts) * n_words + coded.codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded_lang.dictionary.take(pa.array(cell // n_words)), coded.words.take(pa.array(cell % n_words)).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])


def grams(word: str, n: int) -> list[str]:
    """All runs of n characters of the word, padded by a space at both ends where n is over 1."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _sized_grams(word: Column) -> Column:
    """All n-grams of a word up to the longest, as structs of size and feature."""

    def of(n: int) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" ")) if n > 1 else word
        at = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - n + 1, F.lit(1)))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("size"), F.substring(padded, i, F.lit(n)).alias("feature")))

    return F.flatten(F.array(*map(of, range(1, LONGEST + 1))))


def _most_frequent(counts: DataFrame, each: int) -> DataFrame:
    """Of each (lang, size) the features of more than a count, the least one that at most ``each`` features exceed: no sort of all features, ties are kept or cut together.

    What is broadcast is a number for each language and length, MAX_LANGS * (LONGEST + 1) rows at most.
    """
    hist = counts.groupBy("lang", "size", "n").count()
    above = F.sum("count").over(Window.partitionBy("lang", "size").orderBy(F.desc("n")))  # at most as many rows as there are different counts
    least = hist.withColumn("above", above).filter(F.col("above") <= each).groupBy("lang", "size").agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(least), ["lang", "size"]).filter(F.col("n") >= F.col("least")).drop("least")


class Model:
    """log10 frequencies of features in each language; ``rows`` gives those of words."""

    def __init__(self, langs: list[str], prior: list[int], table: pd.DataFrame):
        """table: lang, size (0: a word, else n), feature, n."""
        order = sorted(range(len(langs)), key=lambda i: (-prior[i], langs[i]))
        self.langs = [langs[i] for i in order]  # the first of equal scores wins
        self.known: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        self.table = np.full((len(table) + 1, len(langs)), PENALTY, np.float32)  # the last row: nothing is known
        column = {x: i for i, x in enumerate(self.langs)}
        share = np.maximum(PENALTY, np.log10(table["n"] / table.groupby(["lang", "size"])["n"].transform("sum")))
        for lang, size, feature, value in zip(table["lang"], table["size"], table["feature"], share):
            at = self.known[size].setdefault(feature, sum(map(len, self.known)))
            self.table[at, column[lang]] = value

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the known n-grams of the longest length of which any is known."""
        for n in range(LONGEST, 0, -1):
            found = [at for g in grams(word, n) if (at := self.known[n].get(g)) is not None]
            if found:
                return self.table[found].mean(axis=0)
        return self.table[-1]

    def rows(self, words: list[str], remembered: dict[str, np.ndarray]) -> np.ndarray:
        out, known = np.empty((len(words), len(self.langs)), np.float32), self.known[0]
        for i, w in enumerate(words):
            at = known.get(w)
            if at is not None:
                out[i] = self.table[at]
            elif w in remembered:
                out[i] = remembered[w]
            else:
                out[i] = remembered[w] = self.unseen(w)
        return out


def learn(labelled: DataFrame, scratch: Scratch, model_words: int = MODEL_WORDS, model_grams: int = MODEL_GRAMS) -> Model:
    """A model of labelled (lang, text), all rows, neither of them null."""
    prior = labelled.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(prior) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counted = labelled.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    words = scratch.save(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    each = max(1, len(prior))
    kept = [_most_frequent(words.select("lang", F.lit(0).alias("size"), F.col("word").alias("feature"), "n"), model_words // each)]
    parts = words.select("lang", "n", F.explode(_sized_grams(F.col("word"))).alias("g")).select("lang", "g.size", "g.feature", "n").filter(F.char_length("feature") == F.col("size"))
    runs = scratch.save(parts.groupBy("lang", "size", "feature").agg(F.sum("n").alias("n")), "grams")
    kept.append(_most_frequent(runs, model_grams // each))
    columns = ["lang", "size", "feature", "n"]
    table = kept[0].select(columns).unionByName(kept[1].select(columns)).toPandas()  # at most model_words + LONGEST * model_grams rows
    return Model([r["lang"] for r in prior], [r["count"] for r in prior], table)


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """docs plus the predicted language of each whole text and a score from 0 to 1: the winner's share of the languages' likelihoods, tempered by the root of the number of words.

    Texts that are null or have no letter, and all texts of a model that learned from nothing, get ``und`` and 0. Among languages of equal score the
    one of more training documents wins, then the smaller name. Columns of these names are replaced, all others pass through.
    """
    docs = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_WORDS + LONGEST * MODEL_GRAMS rows
    langs = len(model.langs)

    def run(batches):
        model, remembered = shared.value, {}
        names = np.array([*model.langs, UNKNOWN], object)
        for b in batches:
            pred, score = [np.zeros(0, object)], [np.zeros(0)]
            for _, _, coded, letter in _words(b.column(text_col), TEXT):
                if len(remembered) > REMEMBERED:
                    remembered.clear()
                rows, n = model.rows(coded.words.to_pylist(), remembered), coded.counts
                doc = coded.doc_of_word()
                mean = np.zeros((len(n), max(langs, 1)))
                for j in range(langs):
                    mean[:, j] = np.bincount(doc, weights=rows[coded.codes, j], minlength=len(n)) / np.maximum(n, 1)
                best = mean.argmax(axis=1)
                odds = 10 ** ((mean - mean[np.arange(len(n)), best][:, None]) * np.sqrt(n)[:, None])
                some = letter & (langs > 0)
                pred.append(names[np.where(some, best, langs)])
                score.append(np.where(some, 1 / odds.sum(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score))], names=[*b.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 is not 2, and predicts the language of all. A null id counts as not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()), Scratch(spark, "language"))
    return identify(docs.select("doc_id", "text"), model, score_col="score").select("doc_id", held.alias("held_out"), "lang_pred", "score")
