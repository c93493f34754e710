"""Spans of terms in texts by one automaton, and what lies around them by an interval join.

All terms of all kinds (findings, cues, codes) are one Aho-Corasick automaton, built once a worker; a text is read once, whatever the number of
terms. Which cue governs which mention is settled by Spark: spans are put in bins of positions, meet by (document, bin) and are compared by
their distances, so a document with very many mentions is many small groups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions import rules

#: Characters of a bin of positions; reach of a cue before and after a mention.
BIN, BEFORE, AFTER = 256, 150, 100
#: Texts that are Python strings at once, and spans or values that go back to Spark together: they bound what a worker holds besides the batch it reads.
TEXTS, OUT_ROWS = 32, 4_096
SPANS = "document_id long, kind string, label string, start int, end int, term string"


def expanded(pattern: str) -> list[str] | None:
    """The texts that a simple pattern stands for: words with optional letters (``x?``) and sets of them (``[xy]?``). None if it is not simple."""
    pattern = pattern.replace(r"\b", "")
    m = re.search(r"(\[\w+\]|\w)\?", pattern)
    if m:
        choices = ["", *(m[1][1:-1] if m[1][0] == "[" else m[1])]
        return [t for c in choices for t in expanded(pattern[: m.start()] + c + pattern[m.end() :]) or []]
    return [pattern] if re.fullmatch(r"[\w \-]+", pattern) else None


class Terms:
    """kind -> label -> terms; kinds in ``longest`` give leftmost-longest spans that do not overlap, others all spans; kinds in ``inside`` match within words too."""

    def __init__(self, kinds: dict[str, dict[str, list[str]]], longest: set[str] = frozenset(), inside: set[str] = frozenset(), patterns: dict[str, dict[str, str]] | None = None):
        self.kinds, self.longest, self.inside, self.patterns = kinds, longest, inside, patterns or {}

    def build(self) -> None:
        self.found, self.loose = ahocorasick.Automaton(), [(k, label, re.compile(p, re.I)) for k, ps in self.patterns.items() for label, p in ps.items()]
        meant: dict[str, list[tuple[str, str]]] = {}
        for kind, labels in self.kinds.items():
            for label, terms in labels.items():
                for t in terms:
                    meant.setdefault(t.lower(), []).append((kind, label))
        for t, uses in meant.items():
            self.found.add_word(t, (len(t), uses))
        if meant:
            self.found.make_automaton()

    def spans(self, text: str) -> Iterator[tuple[str, str, int, int, str]]:
        """kind, label, start, end, the term as it stands in the text; by kind, then position."""
        low = text.lower()
        if len(low) != len(text):  # some capitals have small letters of two characters
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        out: dict[str, list] = {}
        for last, (size, uses) in self.found.iter(low) if len(self.found) else ():
            start, end = last - size + 1, last + 1
            whole = not word(start - 1) and not word(end)
            for kind, label in uses:
                if whole or kind in self.inside:
                    out.setdefault(kind, []).append((start, end, label))
        for kind, label, pattern in self.loose:
            out.setdefault(kind, []).extend((m.start(), m.end(), label) for m in pattern.finditer(text))
        for kind, found in out.items():
            found.sort(key=lambda x: (x[0], -x[1], x[2]))
            reached = 0
            for start, end, label in found:
                if kind not in self.longest or start >= reached:
                    reached = end
                    yield kind, label, start, end, text[start:end]


def _in_parts(batches: Iterator[pa.RecordBatch], rows_of: Callable[[int, str], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What rows_of(id, text) gives for each text (null and empty ones give nothing), some rows at a time."""
    rows: list[tuple] = []

    def handed() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for b in batches:
        for first in range(0, b.num_rows, TEXTS):
            part = b.slice(first, TEXTS)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for row in rows_of(doc, text) if text else ():
                    rows.append(row)
                    if len(rows) >= OUT_ROWS:
                        yield handed()
    if rows:
        yield handed()


def find(texts: DataFrame, terms: Terms, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """document_id, kind, label, start, end, term of each span; null texts have none. Positions count characters from 0."""

    def run(batches):
        terms.build()
        schema = pa.schema({"document_id": pa.int64(), "kind": pa.string(), "label": pa.string(), "start": pa.int32(), "end": pa.int32(), "term": pa.string()})
        yield from _in_parts(batches, lambda doc, text: ((doc, *span) for span in terms.spans(text)), schema)

    return texts.select(F.col(id_col).cast("long").alias("document_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def clinical_terms() -> Terms:
    """Diseases (leftmost-longest) and the cues of negation, doubt and time."""
    cues = {"pre": rules.PRE_NEGATION, "post": rules.POST_NEGATION, "doubt": rules.UNCERTAINTY, "past": rules.HISTORICAL, "kin": rules.FAMILY}
    kinds = {"disease": {k: [t for x in p.split("|") for t in expanded(x)] for k, (p, _) in rules.DISEASES.items()}}
    kinds |= {kind: {p: ts for p in ps if (ts := expanded(p))} for kind, ps in cues.items()}
    loose = {kind: {p: p for p in ps if not expanded(p)} for kind, ps in cues.items()}
    return Terms(kinds, longest={"disease"}, patterns=loose)


def around(mentions: DataFrame, cues: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """mentions (document_id, start, end, ..) with ``cues``, the kinds of cues near each: ``kind:before`` for those that lie wholly in the ``before`` characters ahead of it, ``kind:after`` for those in the ``after`` characters behind it.

    A mention is put in the bins that its reach touches, a cue in the bin it starts in. Rows that are equal stay as many.
    """
    keyed = mentions.withColumn("__m", F.struct("document_id", "start", "end", "label"))
    bins = F.sequence(F.floor((F.col("start") - before) / BIN), F.floor((F.col("end") + after) / BIN))
    near = mentions.select("document_id", "start", "end", "label").distinct().withColumn("bin", F.explode(bins))
    cue = cues.select("document_id", F.col("kind").alias("cue"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("bin", F.floor(F.col("s") / BIN))
    ahead, behind = (F.col("s") >= F.col("start") - before) & (F.col("e") <= F.col("start")), (F.col("s") >= F.col("end")) & (F.col("e") <= F.col("end") + after)
    met = near.join(cue, ["document_id", "bin"]).filter(ahead | behind)
    sides = met.groupBy("document_id", "start", "end", "label").agg(F.collect_set(F.concat("cue", F.when(ahead, ":before").otherwise(":after"))).alias("cues"))  # two for each kind at most
    sides = sides.select(F.struct("document_id", "start", "end", "label").alias("__m"), "cues")
    return keyed.join(sides, "__m", "left").withColumn("cues", F.coalesce("cues", F.expr("cast(array() as array<string>)"))).drop("__m")


def mentions(notes: DataFrame) -> DataFrame:
    """Each disease mention (document_id, condition, start, end, term) with negated, uncertain and temporal (current, historical, family_history).

    A mention is negated by a cue in the 150 characters before it or one of the after-cues in the 100 behind it; a family cue
    outranks a historical one. A note repeated under its id repeats its mentions. Null and empty notes have none.
    """
    found = find(notes, clinical_terms())
    seen = around(found.filter("kind = 'disease'").drop("kind"), found.filter("kind <> 'disease'"))
    has = lambda *c: F.arrays_overlap("cues", F.array(*map(F.lit, c)))
    when = F.when(has("kin:before"), "family_history").when(has("past:before"), "historical").otherwise("current")
    return seen.select("document_id", F.col("label").alias("condition"), "start", "end", "term", has("pre:before", "post:after").alias("negated"), has("doubt:before", "doubt:after").alias("uncertain"), when.alias("temporal"))


def active(found: DataFrame) -> DataFrame:
    """Mentions that speak of the patient now: not negated, not of the past, not of the family."""
    return found.filter("not negated and temporal = 'current'")


def summary(found: DataFrame, most: int = 3) -> DataFrame:
    """document_id, summary: the first ``most`` active mentions of each note as they stand in it, in its order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("document_id").orderBy("start", "end"))
    first = active(found).withColumn("n", n).filter(F.col("n") <= most).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("d"))
    return first.select("document_id", F.concat(F.lit("Active diagnoses: "), F.array_join("d.term", ", "), F.lit(".")).alias("summary"))


def labs(notes: DataFrame) -> DataFrame:
    """document_id, pos, lab, value, unit, start, end of each lab mention: the name by the automaton, number and unit by what follows it.

    Names match within words too, as the published pattern does; of several names that begin at one place the first one of the list
    that a number follows is taken, and a mention begins after the end of the one before.
    """
    names = rules.LABS[1 : rules.LABS.index(")")].split("|")
    tail = re.compile(rules.LABS[rules.LABS.index(")") + 1 :], re.A)
    terms = Terms({"lab": {n: [n] for n in names}}, inside={"lab"})
    rank = {n: i for i, n in enumerate(names)}

    def values(doc: int, text: str) -> Iterator[tuple]:
        reached = pos = 0
        for start, _, end in sorted((start, rank[label], end) for _, label, start, end, _ in terms.spans(text)):
            if start >= reached and (m := tail.match(text, end)):
                number = m[1].lstrip("<>")
                yield doc, pos, text[start:end].lower(), float(number) if number else None, m[2], start, m.end()
                reached, pos = m.end(), pos + 1

    def run(batches):
        terms.build()
        schema = pa.schema({"document_id": pa.int64(), "pos": pa.int32(), "lab": pa.string(), "value": pa.float64(), "unit": pa.string(), "start": pa.int32(), "end": pa.int32()})
        yield from _in_parts(batches, values, schema)

    return notes.select(F.col("document_id").cast("long"), "text").mapInArrow(run, "document_id long, pos int, lab string, value double, unit string, start int, end int")
