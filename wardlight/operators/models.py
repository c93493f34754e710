"""Trained models in place of rules: handed over as an object, sent to each worker once, loaded once a task and applied to Arrow batches.

A model of numbers has ``predict(array of rows x features) -> array``; a model of texts has ``entities(list of texts) -> list of lists of (label,
start, end, confidence)``. Without a model the rules answer, as column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators import spans


def scored(rows: DataFrame, features: dict[str, Column], default: Column, name: str, model=None) -> DataFrame:
    """rows with ``name``: what the model makes of the features (nulls as NaN), or the default without one. A prediction of NaN is null; others are clamped to 0..1."""
    if model is None:
        return rows.withColumn(name, default)
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("double")
    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        ready = cloudpickle.loads(shared.value)  # once a task, for all of its batches
        for frame in batches:
            got = np.asarray(ready.predict(frame.to_numpy(float)), float)
            if got.shape != (len(frame),):
                raise ValueError(f"the model gave {got.shape} for {len(frame)} rows")
            yield pd.Series(np.clip(got, 0, 1))

    return rows.withColumn(name, F.nanvl(predicted(F.struct(*[c.cast("double").alias(k) for k, c in features.items()])), F.lit(None).cast("double")))


def entities(notes: DataFrame, model=None, confidence: float = 0.90) -> DataFrame:
    """document_id, label, start, end, confidence, term of the entities of each note: those of the rules (disease mentions, at ``confidence``) and those of the model; of overlapping ones the surest stays.

    A model's entities outside its text, or without length, are left out.
    """
    from wardlight.operators.notes import resolve_overlaps

    found = spans.mentions(notes).select("document_id", "start", "end", F.lit(confidence).alias("confidence"), F.col("condition").alias("label"))
    if model is not None:
        shared = notes.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ready = cloudpickle.loads(shared.value)
            for pdf in frames:
                texts = pdf["text"].fillna("").tolist()
                rows = [(doc, int(a), int(b), float(c), label) for doc, text, some in zip(pdf["document_id"], texts, ready.entities(texts), strict=True) for label, a, b, c in some if 0 <= a < b <= len(text)]
                yield pd.DataFrame(rows, columns=["document_id", "start", "end", "confidence", "label"])

        found = found.unionByName(notes.select(F.col("document_id").cast("long"), "text").mapInPandas(run, "document_id long, start int, end int, confidence double, label string"))
    kept = resolve_overlaps(found.distinct())
    terms = notes.select(F.col("document_id").cast("long"), "text").dropDuplicates(["document_id"])
    return kept.join(terms, "document_id").select("document_id", "label", "start", "end", "confidence", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("term"))
