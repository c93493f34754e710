"""Facts from clinical notes (document_id, text) by fixed patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import rules
from wardlight.operators import similar
from wardlight.operators.spans import active, labs, mentions, summary  # noqa: F401


def note_vitals(notes: DataFrame) -> DataFrame:
    """First mention of each vital sign."""
    out = notes.select("document_id", *[F.regexp_extract("text", "(?i)" + p, 1).alias(k) for k, p in rules.NOTE_VITALS.items()])
    return out.select("document_id", *[F.expr(f"try_cast(nullif({k}, '') as double)").alias(k) for k in rules.NOTE_VITALS])


def conditions(notes: DataFrame) -> DataFrame:
    """document_id, condition, icd10, mentions. Accented Latin letters are letters at a word's edge.

    One pass finds the terms of all conditions, which holds as no term of one overlaps a term of another.
    """
    terms = {k: [t.replace(r"\b", "") for t in p.split("|")] for k, (p, _) in rules.DISEASES.items()}
    every = r"(?i)\b(?:" + "|".join(t for ts in terms.values() for t in ts) + r")\b"
    plain = F.regexp_replace("text", "[À-ÖØ-öø-ɏ]", "x")
    found = notes.select("document_id", F.transform(F.regexp_extract_all(plain, F.lit(every), F.lit(0)), F.lower).alias("found"))
    count = lambda ts: F.size(F.filter("found", lambda x: x.isin([t.lower() for t in ts]))).cast("long")
    hits = F.array(*[F.struct(F.lit(k).alias("condition"), F.lit(c).alias("icd10"), count(terms[k]).alias("mentions")) for k, (_, c) in rules.DISEASES.items()])
    return found.select("document_id", F.inline(hits)).filter("mentions > 0")


def sentiment(notes: DataFrame) -> DataFrame:
    low = F.lower("text")
    count = lambda cues: sum((low.contains(c).cast("int") for c in cues), F.lit(0))
    up, down = count(rules.IMPROVING), count(rules.WORSENING)
    return notes.select("document_id", up.alias("improving"), down.alias("worsening"), F.when(down > up, "deteriorating").when(up > down, "improving").otherwise("stable").alias("sentiment"))


def note_class(notes: DataFrame, kind: str | None = None) -> DataFrame:
    head = F.lower(F.substring("text", 1, 200))
    chain = None
    for c in rules.NOTE_CLASSES:
        t = head.contains(c) if kind is None else head.contains(c) | F.lower(kind).contains(c)
        chain = F.when(t, c) if chain is None else chain.when(t, c)
    return notes.select("document_id", chain.otherwise("progress").alias("note_class"))


def icd10_suggest(notes: DataFrame, n: int = 5) -> DataFrame:
    """Up to n codes of each note by confidence, ties in rule order."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.contains(t), F.struct(F.lit(-c).alias("minus"), F.lit(i).alias("pos"), F.lit(t).alias("term"), F.lit(code).alias("icd10"))) for i, (t, code, c) in enumerate(rules.ICD10)]))
    return notes.select("document_id", F.posexplode(F.slice(F.sort_array(hits), 1, n)).alias("i", "h")).select("document_id", (F.col("i") + 1).alias("rank"), "h.term", "h.icd10", (-F.col("h.minus")).alias("confidence"))


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Greedy choice of non-overlapping spans of a document, by confidence, then start. spans: document_id, start, end, confidence, label."""
    rows = spans.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), "start", "end", "label"))).alias("s"))
    none = F.expr("cast(array() as array<struct<minus:double,start:int,end:int,label:string>>)")
    keep = F.aggregate("s", none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("document_id", F.inline(keep)).withColumn("confidence", -F.col("minus")).drop("minus")


def process(notes: DataFrame) -> DataFrame:
    """Each note with class, sentiment, content hash, entities (its disease mentions in order, with what is said of them), labs and summary."""
    one = note_class(notes).join(sentiment(notes).select("document_id", "sentiment"), "document_id").join(notes.select("document_id", F.sha2(F.substring("text", 1, 1000), 256).alias("semantic_hash")), "document_id")
    listed = lambda rows, name, *columns: rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))  # noqa: E731  those of one note
    found, values = mentions(notes), labs(notes)
    entities = listed(found, "entities", "start", "end", "condition", "term", "negated", "uncertain", "temporal")
    rows = one.join(entities, "document_id", "left").join(listed(values, "labs", "start", "lab", "value", "unit"), "document_id", "left")
    active_ones = F.filter("entities", lambda e: ~e["negated"] & (e["temporal"] == "current"))
    text = F.array_join(F.slice(F.transform(active_ones, lambda e: e["term"]), 1, 3), ", ")
    return rows.withColumn("summary", F.when(F.size(active_ones) > 0, F.concat(F.lit("Active diagnoses: "), text, F.lit("."))).otherwise("No significant entities extracted."))


def exact_dedup(notes: DataFrame) -> DataFrame:
    """First document of each text."""
    return notes.groupBy(F.md5("text").alias("digest")).agg(F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("copies"))


def cosine_pairs(vectors: DataFrame, threshold: float = 0.92, block: int = 4_096) -> DataFrame:
    """All pairs (a, b, cosine), a < b, of vectors at least as similar as the threshold (``similar.pairs``)."""
    return similar.pairs(vectors, threshold, block)


def first_seen(pairs: DataFrame) -> DataFrame:
    """vec_id, kept: for each vector that is like an earlier one, the least id among those."""
    return pairs.groupBy(F.col("b").alias("vec_id")).agg(F.min("a").alias("kept"))


def context_budget(items: DataFrame, budget: int, as_of) -> DataFrame:
    """items: patient_id, seq, at, severity, similarity, text. Highest priority first while the running token sum fits the budget."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("at")) / 3600.0
    rows = items.withColumn("tokens", F.floor(F.length("text") / 4)).withColumn("priority", F.round(0.40 * F.exp(-hours / 6) + 0.35 * F.col("severity") + 0.25 * F.col("similarity"), 9))
    w = Window.partitionBy("patient_id").orderBy(F.desc("priority"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= budget)
