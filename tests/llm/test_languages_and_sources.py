"""Language ID, source divergence and importance resampling against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlight.llm import divergence, language_id, resample, scratch
from wardlight.llm.terms import LETTERS_DIGITS, Coded
from wardlight.llm.textkernel import text_buffers

CLASH = "n long, term string, weight long, g long, score string, lang_pred int, bucket string, chunk string, word long, rank string, part int, eligible string, docs int"
FIELDS = f"doc_id long, text string, lang string, source string, {CLASH}"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = {"en": [f"{a}{b}" for a in ("th", "wh", "sh") for b in ("is", "at", "ere", "Ou", "ing")], "fr": [f"{a}{b}" for a in ("é", "qu", "au") for b in ("eux", "ment", "elle", "oi")], None: ["zz9", "Ж", "日本語"]}
    out = [(0, None, "en", "a"), (1, "", "en", "b"), (2, " \n 123 -- ", "fr", None), (3, "x" * 300, "fr", "lone"), (None, "this that", "en", "a"), (None, "this that", "en", "a")]
    for i in range(4, 240):
        lang = rng.choice(["en", "en", "fr", None])
        own = vocab[lang]
        tilt = rng.randrange(1, 5)
        out.append((i, " ".join(own[min(rng.randrange(len(own)), rng.randrange(tilt * 3))] if rng.random() < 0.9 else rng.choice(own).upper() + "," for _ in range(rng.randrange(5, 60))), lang, f"s{rng.randrange(tilt + 40)}"))
    out += [(240, " ".join(rng.choice(vocab["en"]) for _ in range(40_000)), "en", "a"), (50, out[50][1], out[50][2], out[50][3]), *[(241 + i, "same same same", "de", "q") for i in range(3)]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 13) for r in rows], FIELDS).repartition(3).cache()


# ---- exact words


def test_coded_words():
    texts = ["Ab,cD ab", None, "", "é1 é1 ç", "\0x\0", "tail"]
    coded = Coded(*text_buffers(pa.array(texts)), LETTERS_DIGITS)
    words = coded.words.to_pylist()
    got = [[words[c] for c in coded.codes[a:b]] for a, b in zip(coded.bounds[:-1], coded.bounds[1:])]
    assert got == [["ab", "cd", "ab"], [], [], ["é1", "é1", "ç"], ["x"], ["tail"]]


# ---- importance resampling


def features(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def expected_draw(rows, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, features(text, n)[1]))
    for text in target:
        t.update(map(bucket, features(text, n)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for i, text, *_ in rows:
        words, fs = features(text, n)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[1:4]))
    ranks = defaultdict(list)
    for r, x in enumerate(able, 1):
        ranks[x].append(r if r <= percent * len(able) // 100 else None)
    return Counter((*x, ranks[x].pop(0) if ranks[x] else None) for x in scored)


@pytest.mark.parametrize(("n", "percent", "least"), [(1, 10, 20), (3, 55, 2), (2, 100, 1), (1, 0, 20)])
def test_resample(spark, docs, rows, n, percent, least):
    target = ["This that there", None, "", "quelle Zz9 日本語 日本語"]
    got = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=97, percent=percent, min_words=least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == expected_draw(rows, target, n, 97, percent, least)


def test_resample_hands_over_full_tries_and_numbers_equal_rows(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(resample, "NODES", 5)
    monkeypatch.setattr(resample, "CHUNK", 64)
    monkeypatch.setattr(resample, "COPIES", 2)
    many = rows + [(None, "one two three four", None, None)] * 61  # a third of the rows is one row
    got = resample.resample(spark.createDataFrame([(i, t) for i, t, *_ in many], "doc_id long, text string").repartition(4), docs.limit(0), n=2, buckets=50, percent=60, min_words=3)
    assert Counter(map(tuple, got.collect())) == expected_draw(many, [], 2, 50, 60, 3)


def test_resample_empty(docs):
    assert resample.resample(docs.limit(0), docs.select("text")).collect() == []


def test_trie_spells_runs():
    trie = resample.Trie(3, 1 << 32)
    trie.count(Coded(*text_buffers(pa.array(["a b a b", "b"])), LETTERS_DIGITS))
    want = Counter(features("a b a b", 3)[1] + ["b"])
    assert {trie.crc[i]: int(trie.counts[i]) for i in range(1, len(trie.crc))} == {zlib.crc32(k.encode()): n for k, n in want.items()}


# ---- source divergence


def expected_audit(rows, least, top):
    count, docs_of, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs_of[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs_of[lang].items() if n >= least]
        all_ = sum((count[lang, s] for s in sources), Counter())

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        q, of = p(all_), {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(x, sum(abs(of[s][t] - of[x][t]) for t in kept)) for x in sources - {s}]
            terms = [(t, of[s][t] - q[t]) for t in kept if count[lang, s][t] and of[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block", "chunk", "segment"), [(30, 50, 32, 4096, 4), (2, 3, 4, 3, 2), (1, 50, 1, 1, 1), (10_000, 50, 5, 3, 1)])
def test_audit(docs, rows, monkeypatch, least, top, block, chunk, segment):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SEGMENT", segment), ("TEXT", 500)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected_audit(rows, least, top)


def test_audit_empty(docs):
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_are_exact(spark):
    rng = random.Random(2)
    cases = [(rng.randrange(10**k), rng.randrange(10**k, 9 * 10**15)) for k in range(1, 15) for _ in range(20)] + [(0, 5), (3, 8), (0, 10**10)]
    want = [1 + 10**9 * (c + 5) // t for c, t in cases]
    assert divergence.shares(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == want
    columns = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c long, t long").select("i", divergence.share(F.col("c"), F.col("t")).alias("p"))
    assert [r["p"] for r in columns.orderBy("i").collect()] == want


# ---- language identification


def words_of(text):
    runs = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [r[i : i + 64] for r in runs for i in range(0, len(r), 64)]


def expected_language(train, texts):
    """Plain dictionaries of all words and n-grams (the model's bounds are not met here)."""
    known, n_docs = [defaultdict(Counter) for _ in range(6)], Counter(lang for _, lang in train)
    for text, lang in train:
        for w in words_of(text):
            known[0][lang][w] += 1
            for n in range(1, 6):
                p = f" {w} " if n > 1 else w
                known[n][lang].update(p[i : i + n] for i in range(len(p) - n + 1))
    langs = sorted(n_docs, key=lambda x: (-n_docs[x], x))

    def row(size, f):
        return [max(-7.0, math.log10(known[size][x][f] / sum(known[size][x].values()))) if known[size][x][f] else -7.0 for x in langs]

    def word(w):
        if any(known[0][x][w] for x in langs):
            return row(0, w)
        for n in range(5, 0, -1):
            p = f" {w} " if n > 1 else w
            found = [row(n, g) for i in range(len(p) - n + 1) if any(known[n][x][g := p[i : i + n]] for x in langs)]
            if found:
                return np.mean(found, axis=0).tolist()
        return [-7.0] * len(langs)

    out = []
    for t in texts:
        ws = words_of(t)
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        mean = np.mean([word(w) for w in ws], axis=0)
        odds = 10 ** ((mean - mean.max()) * math.sqrt(len(ws)))
        out.append((langs[int(np.argmax(np.round(mean, 5)))], 1 / odds.sum()))
    return out


def test_language(spark, docs, rows):
    labelled = [(t, lang) for _, t, lang, _ in rows[:120] if t is not None and lang is not None]
    model = language_id.learn(spark.createDataFrame(labelled, "text string, lang string").repartition(3), scratch.Scratch(spark, "language-test"))
    asked = spark.createDataFrame([(i, t, None) for i, (_, t, *_) in enumerate(rows)] + [(9_000, "_9 ́ --", None), (9_001, "ﬀ Ünseen SHERES 汉字汉字", None), (9_002, "thIs" * 500, None)], "at long, text string, lang_pred int")
    got = language_id.identify(asked.repartition(2), model).orderBy("at").collect()
    texts = [r["text"] for r in got]
    want = expected_language(labelled, texts)
    assert [r["lang_pred"] for r in got] == [w[0] for w in want]
    assert [(r["text"], r["lang_score"], w[1]) for r, w in zip(got, want) if abs(r["lang_score"] - w[1]) > 1e-3] == []
    assert [r["lang_pred"] for r in got if r["text"] is None or not re.search(r"[^\W\d_]", r["text"])] == ["und"] * 4


def test_language_bounds_and_edges(spark, docs):
    s = scratch.Scratch(spark, "language-edges")
    labelled = docs.filter("lang is not null and text is not null")
    small = language_id.learn(labelled, s, model_words=9, model_grams=12)  # three languages: three words each, four n-grams of a length each
    assert len(small.known[0]) <= 9 and all(len(k) <= 12 for k in small.known[1:])
    empty = language_id.learn(labelled.limit(0), scratch.Scratch(spark, "language-none"))
    assert {tuple(r) for r in language_id.identify(docs.select("text"), empty).select("lang_pred", "lang_score").distinct().collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), small).collect() == []
    many = spark.createDataFrame([(f"l{i}", "x") for i in range(language_id.MAX_LANGS + 1)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(many, scratch.Scratch(spark, "language-many"))


def test_language_query(spark, sf_dir):
    from wardlight.llm.registry import queries

    got = {r["doc_id"]: r for r in queries()["op11_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and re.search(r"[^\W\d_]", d["text"] or "")]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.97
