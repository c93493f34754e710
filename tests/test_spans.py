"""Spans of terms, labs, and what the cues around a mention say, against plain Python."""

import random
import re

import pytest

from wardlight.functions import rules


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["sepsis", "CAP", "congestive heart failure", "COPD exacerbation", "septic shock", "MI", "stroke", "no", "denies", "not found", "was ruled out", "possible", "history of", "mother had", "old records of a long history",
             "complaint", "nothing", "prior", "WBC: 14.2 K/uL", "pH 7.3", "Na < 5", "K 4", "pneumonia", "PE", "İstanbul", "naïve", "unremarkable", "rules out", "no complaints of", "ruled out", "Hgb<7", "K", "BUN 20mg"]
    out = [None, "", "no", "Sepsis", "no sepsis", "xsepsis sepsisx", "non-sepsis", "sepsis" + "." * 99 + "not found", "no" + " " * 147 + "sepsis", "no" + " " * 149 + "sepsis"]
    return out + [" ".join(rng.choice(parts) + rng.choice(["", ".", ",", " x" * rng.randrange(20)]) for _ in range(rng.randrange(3, 90))) for _ in range(150)]


def expected(text):
    """Mentions by the patterns themselves, cues by all their matches in the whole text."""
    text = text or ""
    spans = lambda ps: [m.span() for p in ps for m in re.finditer(p, text, re.I)]
    pre, post, doubt, past, kin = map(spans, (rules.PRE_NEGATION, rules.POST_NEGATION, rules.UNCERTAINTY, rules.HISTORICAL, rules.FAMILY))
    out = []
    for name, (p, _) in rules.DISEASES.items():
        for m in re.finditer("|".join(sorted(p.split("|"), key=len, reverse=True)), text, re.I):
            s, e = m.span()
            ahead = lambda cues: any(a >= s - 150 and b <= s for a, b in cues)
            behind = lambda cues: any(a >= e and b <= e + 100 for a, b in cues)
            out.append((name, s, e, m[0], ahead(pre) or behind(post), ahead(doubt) or behind(doubt), "family_history" if ahead(kin) else "historical" if ahead(past) else "current"))
    return out


def test_mentions(spark, texts):
    from wardlight.operators import notes

    table = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").repartition(3)
    found = notes.mentions(table)
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, *x) for i, t in enumerate(texts) for x in expected(t))
    now = {(r["document_id"], r["start"]) for r in notes.active(found).collect()}
    assert now == {(i, x[1]) for i, t in enumerate(texts) for x in expected(t) if not x[4] and x[6] == "current"}
    assert notes.mentions(table.limit(0)).collect() == []


def test_summaries_name_what_holds_now(spark):
    from wardlight.operators import notes

    rows = ["Patient denies pneumonia. No evidence of sepsis.", "Mother had stroke.", "History of CHF.", "Septic shock today, then AKI; CAP. MI too.", "Stroke was ruled out", None]
    got = {r["document_id"]: r for r in notes.process(spark.createDataFrame(list(enumerate(rows)), "document_id long, text string")).collect()}
    none = "No significant entities extracted."
    assert [got[i]["summary"] for i in range(6)] == [none, none, none, "Active diagnoses: Septic shock, AKI, CAP.", none, none]
    assert [len(got[i]["entities"] or []) for i in range(6)] == [2, 1, 1, 4, 1, 0]
    short = notes.summary(notes.mentions(spark.createDataFrame(list(enumerate(rows)), "document_id long, text string")), 2).collect()
    assert [tuple(r) for r in short] == [(3, "Active diagnoses: Septic shock, AKI.")]


def test_labs_with_spans(spark, texts):
    from wardlight.operators import notes

    got = notes.labs(spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").repartition(2)).collect()
    want = [(i, k, m[1].lower(), float(m[2].lstrip("<>")), m[3], m.start(), m.end()) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(rules.LABS, t or "", re.I | re.A))]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 100


def test_one_automaton(spark):
    from wardlight.operators import spans

    assert sorted(spans.expanded(r"\brule[sd]? out\b")) == ["rule out", "ruled out", "rules out"] and spans.expanded(r"\bold\b.*\bhistory\b") is None and spans.expanded(r"\bdenies?\b") == ["denie", "denies"]
    terms = spans.Terms({"a": {"x": ["heart failure", "acute heart failure"], "y": ["heart"]}, "b": {"z": ["art", "fail"]}}, longest={"a"}, inside={"b"})
    rows = spans.find(spark.createDataFrame([(1, "Acute HEART failure, heartless heart"), (2, None)], "document_id long, text string"), terms).collect()
    assert [tuple(r)[1:] for r in rows if r["kind"] == "a"] == [("a", "x", 0, 19, "Acute HEART failure"), ("a", "y", 31, 36, "heart")]
    assert [(r["start"], r["end"]) for r in rows if r["kind"] == "b"] == [(8, 11), (12, 16), (23, 26), (33, 36)]


def test_heavy_rows_are_spread_by_their_number(spark, monkeypatch):
    """The tasks of heavy work grow with the table, so the longest does not; the rows stay the same."""
    from wardlight.sources import fixtures as fx

    monkeypatch.setattr(fx, "TASK_ROWS", 100)
    rows = fx.spread(spark.range(2_000, numPartitions=5))
    assert rows.rdd.getNumPartitions() == 20 and rows.distinct().count() == 2_000
    assert fx.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_spans_leave_the_worker_in_parts(spark, monkeypatch):
    """A worker hands over some spans at a time, however many texts a batch has or spans a text; all spans come, in order."""
    import pyarrow as pa

    from wardlight.operators import spans

    texts = [None, "", "sepsis " * 50, *["pneumonia and sepsis"] * 100]
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    schema = pa.schema({"id": pa.int64(), "word": pa.string()})
    monkeypatch.setattr(spans, "OUT_ROWS", 16)
    parts = list(spans._in_parts([batch, batch], lambda i, t: ((i, w) for w in t.split()), schema))
    assert max(p.num_rows for p in parts) == 16
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == 2 * [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    terms = spans.Terms({"disease": {"sepsis": ["sepsis"]}})
    rows = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").coalesce(1)
    assert spans.find(rows, terms).groupBy("document_id").count().count() == 101 and spans.find(rows, terms).count() == 150
