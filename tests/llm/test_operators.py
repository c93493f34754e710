"""The training-data operators against brute force, on a table with nulls, empty and long texts, ties, repeats and clashing columns."""

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

from wardlight.llm import html_text, line_dedup, lm_score, mixing, near_dups, pieces, quality_rules, scratch, sharding, topk, toxicity
from wardlight.llm.textkernel import text_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "did long, key string, v long, comp long, sid int, cell int, n long, held boolean, n_words long, ids string, part int, kept boolean"
FIELDS = f"doc_id long, text string, source string, lang string, {CLASH}"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "naïve", "#x", "日本"]
    line = "This passage stands in many documents and is long enough to count"
    base = [rng.choice(vocab) for _ in range(120)]
    texts = [None, "", " \n\t", "one two", "one two", "a b c d e", "A b C d e", "e d c b a"]
    for i in range(40):
        words = base[:]
        for _ in range(i % 12):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    for i in range(30):
        texts.append("\n".join([" ".join(rng.choice(vocab) for _ in range(30)), f"  {line.upper() if i % 2 else line}\t", line[:20]]))
    texts += ["same again and again and again here"] * 10 + [" ".join(rng.choice(vocab) for _ in range(30_000))]
    out = [(i, t) for i, t in enumerate(texts)] + [(50, texts[50]), (None, "an orphan of five words")]
    return [(i, t, [None, "b", "a", "Z"][k % 4] if k % 3 else "a", "en") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], FIELDS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_line_dedup(docs, none, rows):
    texts, ids = defaultdict(list), defaultdict(set)
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            ids[strip(x)].add(-1 if i is None else i)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(strip(x)) >= 40 and len(ids[strip(x)]) >= 5 and max(ids[strip(x)]) != (-1 if i is None else i))]
        texts[i].append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(docs).collect():
        got[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["kept_text"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert line_dedup.dedup_lines(none).count() == 0


def test_jaccard_join(docs, none, rows):
    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min([x for x in least[find(i)] if x is not None], default=None)) for i, r in enumerate(rows))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs).collect())
    assert got == want
    assert near_dups.near_duplicates(none).count() == 0


def test_jaccard_join_meets_a_pair_once():
    big = np.iinfo(np.int64).max
    lists = lambda *x: np.array([list(k) + [big] * (near_dups.FIRST_KEYS - len(k)) for k in x])
    a, b = lists([1, 5, 9], [1, 5, 9], [2, 5]), lists([5, 9], [5, 9], [3, 9])
    assert near_dups._met_before(np.array([9, 5, 9]), a, b).tolist() == [True, False, False]
    full = np.arange(near_dups.FIRST_KEYS)[None]
    assert not near_dups._met_before(np.array([99]), full, lists([50]))[0]


def test_lm_score(docs, none, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*WORD.findall(lower(r[1])), None] for r in rows]
    c = Counter(t for r, ts in zip(rows, tokens) if not held(r[0]) for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r[0] is None else r[0], held(r[0]), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts in zip(rows, tokens))
    out = lm_score.score_corpus(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert sum(r["score"] for r in out if r["held_out"]) > sum(r["base_score"] for r in out if r["held_out"])
    assert lm_score.score_corpus(none, F.lit(False)).count() == 0


def test_lm_weights_are_distributions():
    import pandas as pd

    w = lm_score.learn_weights(pd.DataFrame({"b": [1, 3, 3], "p2": [None, 8.0, 16.0], "p1": [40.0, 50.0, None], "n": [5, 200, 10]}), 0.001)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0 and w[3, 0] > w[3, 1]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds out six toxic rows only, too few to measure with
    got = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2) if len(pos) and len(neg) else 1
    assert auc > 0.9 and ((got.predicted == got.toxic).mean()) > 0.85


def test_toxicity_edges(docs, none):
    net = toxicity.ConvNet()
    net.fit([], np.zeros(0))
    got = toxicity.score_texts(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_texts(none, net).count() == 0


def test_pieces(docs, none, spark):
    out = pieces.decode(pieces.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out)
    checked = pieces.encode(docs, check_col="text", carry=["doc_id", "ids", "key"]).collect()  # clashing names are replaced
    assert all(r["text"] for r in checked) and Counter((r["doc_id"], tuple(r["ids"])) for r in checked) == Counter((r["doc_id"], tuple(r["ids"])) for r in out)
    v = pieces.Vocabulary.load()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {int(i): float(s) for i, s in zip(v.key_ids, v.scores)}
    score = {sp.id_to_piece(i): s for i, s in known.items()}
    total = lambda ids: sum(known.get(int(i), 0) for i in ids)
    for word in ["▁hello", "▁Été", "▁unbelievable", "▁▁▁", "▁w12"]:
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for at in range(end):
                s = score.get(word[at:end], v.unknown if end - at == 1 else None)
                if s is not None:
                    best[end] = max(best[end], best[at] + s)
        ids, _ = v.encode_segments([word])
        if all(int(i) in known for i in ids):
            assert abs(total(ids) - best[-1]) < 1e-9
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_sharding(docs, none, rows):
    out = sharding.uniform_shards(docs, n_shards=7).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    size = {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == size
    assert sorted(map(str, out)) == sorted(map(str, sharding.uniform_shards(docs, n_shards=7).collect()))
    assert sharding.uniform_shards(none).count() == 0


def test_hypergeometric_has_the_right_mean():
    rng = random.Random(1)
    got = [sharding._hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(got) / 4000 - 6) < 0.1 and abs(np.var(got) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_html(spark):
    page = "<html><body><nav><a href=x>Home</a><a>News</a></nav><article><h1>A &amp; B</h1><p>The first  paragraph\nhas several words, and it ends here.</p><p>A second one follows with more words.</p></article><footer>Copyright</footer><script>x<y</script></body></html>"
    table = spark.createDataFrame([(1, page), (2, None), (3, ""), (1, page), (4, "<p>unclosed <b")], "page_id long, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(table).collect())
    text = "A & B\nThe first paragraph has several words, and it ends here.\nA second one follows with more words."
    assert got[:4] == [(1, text), (1, text), (2, ""), (3, "")]
    assert html_text.extract(table.limit(0)).count() == 0
    clash = html_text.extract(table.withColumn("text", F.lit(7)), out_col="text").filter("page_id = 1").first()
    same = html_text.extract(table, out_col="html").filter("page_id = 1").first()
    assert clash["text"] == text == same["html"]


# Hand-written pages of other layouts than the learned ones: (html, main text).
PROSE = ["The council met on Tuesday to discuss the new bridge, and most members spoke in favour of the plan.", "No vote was taken.", "Engineers expect work to begin next spring, although the budget still has to be approved by the county.", "\"We have waited for twenty years,\" said one resident who lives beside the river."]
PAGES = [
    (f"<body><div id=top-nav class=navbar><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Sport</a></ul></div><div class=cookie-consent><p>We use cookies to improve your visit. Read our policy.</p><button>Accept</button></div><main><h1>Bridge plan</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p><div class='ad-box ad'>Buy a boat today!</div><p>{PROSE[2]}</p></main><aside><h3>Most read</h3><ul><li><a href=4>Ten walks by the river</a></ul></aside><footer><p>&copy; 2024 The Paper</p></footer></body>", ["Bridge plan", PROSE[0], PROSE[1], PROSE[2]]),
    (f"<body><table class=layout><tr><td><a href=1>Front page</a><br><a href=2>Archive</a></td><td><div class=story><h2>River &amp; bridge</h2><p>{PROSE[0]}<p>{PROSE[3]}<p>{PROSE[1]}<blockquote><p>{PROSE[2]}</p></blockquote></div></td></tr></table><div class=footer>All rights reserved. <a href=3>Terms</a></div></body>", ["River & bridge", PROSE[0], PROSE[3], PROSE[1], PROSE[2]]),
    (f"<body><header><div>The Paper</div><p>News since 1901</p></header><article><header><h1>Council meets</h1><p>By a reporter of ours</p></header><p>{PROSE[3]}</p><p>{PROSE[2]}</p><form class=newsletter><label>Your mail</label><button>Send</button></form><p>{PROSE[1]}</p></article><section id=comments><h3>2 comments</h3><div class=comment><b>Ann</b><p>I lived there for years and never saw a single engineer, which tells you a lot about this plan.</p></div><div class=comment><b>Bob</b><p>Good news!</p></div></section></body>", ["Council meets", "By a reporter of ours", PROSE[3], PROSE[2], PROSE[1]]),
    (f"<body><div class=wrap><div class=menu><a href=1>A</a> <a href=2>B</a> <a href=3>C</a></div><div class=x1><h1>Plan</h1><div>{PROSE[2]}</div><div>{PROSE[0]}</div><div>{PROSE[3]}</div></div><div class=sidebar><h4>Related</h4><p><a href=5>Another bridge in the north was opened last year</a></p></div><div class=share><a href=6>Share</a></div></div></body>", ["Plan", PROSE[2], PROSE[0], PROSE[3]]),
]


def test_html_labels_and_the_cut():
    """Blocks of labelled pages of another seed and of hand-written pages: the cut betters the odds alone."""
    from wardlight.llm.html_samples import labelled_pages

    costs, seen = html_text.learn_costs(), Counter()
    for html, content in labelled_pages(300, 9):
        blocks = html_text.read_blocks(html)
        alone, cut = html_text.features(blocks) @ np.array(costs.weights) > 0, costs.labels(blocks)
        for b, x, y in zip(blocks, alone, cut):
            want = b.text in content
            seen["moved"] += x != y
            for name, got in (("alone", x), ("cut", y)):
                seen[name, "hit"] += got and want
                seen[name, "false"] += got and not want
                seen[name, "lost"] += want and not got
    f1 = lambda k: 2 * seen[k, "hit"] / (2 * seen[k, "hit"] + seen[k, "false"] + seen[k, "lost"])
    assert seen["moved"] > 50 and f1("cut") > f1("alone") and f1("cut") > 0.96
    hit = false = lost = 0
    for html, want in PAGES:
        got = Counter(html_text.main_text(html, costs).split("\n"))
        hit, false, lost = hit + sum((got & Counter(want)).values()), false + sum((got - Counter(want)).values()), lost + sum((Counter(want) - got).values())
    assert hit / (hit + false) >= 0.9 and hit / (hit + lost) >= 0.9, (hit, false, lost)


def test_html_cut_of_a_page_is_minimal():
    """The settled blocks and the parts together reach the least cost; long pages end."""
    rng = random.Random(8)
    for _ in range(60):
        n = 8
        odds = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(i, i + 1, rng.randrange(7)) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.randrange(4)) for _ in range(3)]
        cost = lambda x: sum(max(0, -o) if k else max(0, o) for o, k in zip(odds, x)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_text.cut_labels(odds, edges)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
    page = "<nav><a>x</a></nav><article>" + "<p>Some words, and a few more of them.</p><p>Of.</p>" * 5000 + "</article>"
    assert html_text.main_text(page, html_text.learn_costs()).count("\n") == 9_999


def test_html_of_the_test_pages(spark):
    """On pages of one article element its blocks are the text, in order, whole."""
    out = html_text.op7_html_text(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in out:
        assert r["text"] == "\n".join(b.text for b in html_text.read_blocks(r["html"]) if b.element.in_content) and r["n_chars"] == len(r["text"])


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(50):
        n = 6
        s, t = [rng.randrange(9) for _ in range(n)], [rng.randrange(9) for _ in range(n)]
        edges = [(i, j, rng.randrange(6)) for i in range(n) for j in range(i)]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_text.min_cut(s, t, edges)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vec = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)] + [(301, None), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, []), (305, [float("inf")] * 4), (None, [1.0] * 4)]
    vec += [(400 + i, [0.5] * 4) for i in range(30)]
    table = spark.createDataFrame(vec, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    x = {i: [math.floor(1024 * a) for a in v] for i, v in vec if i is not None and v and all(a is not None and math.isfinite(a) for a in v)}
    want = set()
    for q in (i for i in x if i % 100 == 0):
        best = sorted(((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q))[:10]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(table, 10, F.col("vec_id") % 100 == 0).collect()}
    assert got == want
    assert topk.exact_top_k(table.limit(0), 10, F.lit(True)).count() == 0


def test_quality_counts(docs, none, rows, spark):
    def counts(t):
        w, t = WORD.findall(t or ""), t or ""
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None)], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels).collect()
    assert Counter((r["doc_id"], *(r[k] for k in quality_rules.COUNTS[:5])) for r in out) == Counter((r[0], *counts(r[1])) for r in rows)
    failed = lambda c: c[0] < 20 or 100 * c[4] > 30 * c[0]
    assert all(r["base_failed"] == failed([r[k] for k in quality_rules.COUNTS[:5]]) and not (r["base_failed"] and r["kept"]) for r in out)
    assert quality_rules.judge(none, labels.limit(0)).count() == 0


def test_decision_list_finds_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.FEATURES)))
    bad = (x[:, 0] > 0.8) & (x[:, 3] < 0.6)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.any([quality_rules._holds(x, r) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.8 * bad.sum() and (hit & ~bad).sum() < 0.1 * hit.sum()


def test_mixing(docs, none, rows):
    out = mixing.mix_to_targets(docs).collect()
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], s) for r, s in zip(rows, size))
    per = Counter()
    for r, s in zip(rows, size):
        per[r[2]] += s
    names = sorted((x for x in per if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in per)
    targets = dict(zip(names, capped_targets([per[x] for x in names], [1, 2, 3, 1, 2, 3])))
    assert abs(sum(targets.values()) - sum(size)) < 1e-6
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    longest = {x: max(s for r, s in zip(rows, size) if r[2] == x) for x in names}
    for x in names:  # copies are whole: a document of more words than the target can't be taken in part
        assert abs(taken[(per[x], round(targets[x], 6))] - targets[x]) <= max(5, 0.02 * targets[x], longest[x] / 2 if longest[x] > targets[x] else 0)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_to_targets(docs).collect()))
    assert mixing.mix_to_targets(none).count() == 0


def capped_targets(sizes, weights, cap=3):
    """Shares by weight; what exceeds cap * size is reshared, one source at a time."""
    total, free, targets = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / unit > cap * sizes[i]]
        for i in over or free:
            targets[i] = float(cap * sizes[i]) if over else total * weights[i] / unit
        if not over:
            break
        total -= sum(targets[i] for i in over)
        free -= set(over)
    return targets


def test_targets(spark):
    from wardlight.llm.scratch import Scratch

    rng = random.Random(4)
    for sizes in ([10, 90], [5, 0, 70, 3, 2_000, 1, 1, 40], [rng.randrange(1, 10**rng.randrange(1, 7)) for _ in range(40)]):
        weights = [1 + i % 3 for i in range(len(sizes))]
        table = spark.createDataFrame([(f"{i:03}", s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "key string, size long, weight double")
        got = [r["target"] for r in mixing.with_targets(table).orderBy("key").collect()]
        assert np.allclose(got, capped_targets(sizes, weights)) and abs(sum(got) - sum(sizes)) < 1e-6 * sum(sizes)
    names = [None, *map(chr, range(97, 120)), "Z", "é", "\U0001f600", "\uffee", ""]
    ranked = mixing.ranked(spark.createDataFrame([(x,) for x in names], "source string"), Scratch(spark, "test")).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(len(names))) and [r["source"] for r in ranked] == [*sorted(x for x in names if x is not None), None]


def test_shares_in_whole_numbers(spark):
    table = [(7, 5, 3), (10**6, 2 * 10**6 + 1, 10**6 + 3), (2**40 - 1, 2**41 + 5, 2**40 + 1), (0, 9, 4)]
    got = spark.createDataFrame(table, "k long, v long, n long").select(mixing._share(F.col("k"), F.col("v"), F.col("n")).alias("x")).collect()
    assert sorted(r["x"] for r in got) == sorted(k * v // n for k, v, n in table)


def test_mixing_of_missing_ids(spark):
    table = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 > 0, F.lit("b")).alias("source"))
    out = mixing.mix_to_targets(table).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sorted((r["n"], r["source_size"], r["target"]) for r in out) == [(1_000, 3_000, 6_000.0), (2_000, 6_000, 3_000.0)] and all(r["taken"] == r["target"] for r in out)


def test_pieces_are_the_librarys(docs, spark, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(7)
    odd = ["▁▁▁ a  b   c", " x", "y \n\t z ", "ﬁ Ａ é \x00 日本語", "<s> </s> <0x0A>", "Elle parle des modèles", "aaaaaaa" * 60, "".join(rng.choice("etaoin shrdlu,.é日") for _ in range(3000)), "".join(rng.choice("abcdest") for _ in range(2000)), " " * 700 + "x"]
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    texts = [t for t in [*odd, *real, *(r["text"] for r in docs.select("text").collect())] if t]
    v = pieces.Vocabulary.load()
    for chars in (pieces.MERGE_CHARS, 2):  # rows in batches, and every row from the heap
        monkeypatch.setattr(pieces, "MERGE_CHARS", chars)
        ids, counts = pieces.Encoder(v)(*text_buffers(pieces._spaced(pa.array(texts))))
        ends = np.cumsum(counts)
        for t, end, n in zip(texts, ends, counts):
            assert ids[end - n : end].tolist() == sp.encode(t), t[:80]


def test_jaccard_join_links_rows_without_id(spark):
    span = lambda name, i, n=100: " ".join(f"{name}{k}" for k in range(i, i + n))
    rows = [(1, span("w", 0)), (None, span("w", 8)), (2, span("w", 16)), (3, span("x", 0)), (None, span("x", 1)), (None, span("y", 0)), (None, span("y", 1))]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 1): 1, (None, 1): 1, (2, 1): 1, (3, 3): 1, (None, 3): 1, (None, None): 2})


def test_top_k_past_many_rows_of_the_querys_id(spark):
    rng = np.random.default_rng(4)
    vec = [(0, [9.0, 9.0])] * 60 + [(i, rng.normal(size=2).round(1).tolist()) for i in range(1, 40)]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(spark.createDataFrame(vec, "vec_id long, embedding array<double>"), 10, F.col("vec_id") == 0).orderBy("rank").collect()]
    score = lambda x: sum(9216 * math.floor(1024 * a) for a in x)
    best = sorted((-score(x), i) for i, x in vec if i)[:10]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_jaccard_join_of_hot_keys_in_blocks(spark, monkeypatch):
    """A shared template below the threshold, near copies of it, exact copies and colliding vertex hashes, with tiny blocks and slices."""
    rng = random.Random(3)
    word = lambda: f"u{rng.randrange(10**6)}"
    template = [word() for _ in range(70)]
    texts = [" ".join(template + [word() for _ in range(35)]) for _ in range(60)]
    texts += [" ".join(template + texts[0].split()[70:100] + [word() for _ in range(5)]) for _ in range(40)]
    texts += [texts[7]] * 30 + [f"{t} {word()}" for t in texts[20:40]]
    for name, value in (("BLOCK", 8), ("SLICE", 16), ("PAIRS", 64), ("HOT", 4), ("ORDER_KEYS", 50)):
        monkeypatch.setattr(near_dups, name, value)
    monkeypatch.setattr(scratch, "HOT_ROWS", 10)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                a_, b_ = sorted((find(i), find(j)))
                up[b_] = a_
    want = {i: find(i) for i in range(len(texts))}
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert got == want and len(set(want.values())) > 50


def test_vertices_that_share_a_hash_stay_apart():
    texts = pa.array(["a b c d e f", "g h i j k l", "a b c d e f"])
    first, other, again = list(near_dups.shingle_sets(texts, 5))
    apart = [x[2] for x in near_dups.shingle_sets(texts, 5, frozenset([first[2]]))]
    assert first[2] == again[2] != other[2] and apart == [first[3], other[2], first[3]] and first[3] != first[2]


def test_connected_components(spark):
    from wardlight.llm.components import connected_components
    from wardlight.llm.scratch import Scratch

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 640)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    table, scratch = spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")
    assert {r["id"]: r["comp"] for r in connected_components(table, scratch).collect()} == {x: find(x) for x in up}
    assert connected_components(table.limit(0), scratch).count() == 0


def test_sharding_of_repeated_and_missing_ids(spark):
    """Rows without id or equal to many others spread over all shards like the rest."""
    table = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    per = Counter(r["shard"] for r in sharding.uniform_shards(table, n_shards=8).filter("doc_id is null").collect())
    assert len(per) == 8 and all(180 < n < 320 for n in per.values())  # 250 each, standard deviation 10.5 under the exact law
    hot = sharding.uniform_shards(spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text")), n_shards=4).groupBy("shard").agg(F.count("*"), F.min("slot"), F.max("slot")).collect()
    assert sorted(map(tuple, hot)) == [(s, 7_500, 0, 7_499) for s in range(4)]


def test_write_shards(spark, tmp_path):
    table = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    sharding.write_shards(table, f"file://{tmp_path}/out", rows_per_file=100, n_shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.orderBy("doc_id").select("doc_id", "text", "lang").collect() == table.orderBy("doc_id").collect()
    assert sorted(map(tuple, back.groupBy("shard").agg(F.count("*"), F.countDistinct("slot"), F.max("slot")).collect())) == [(s, 300, 300, 299) for s in range(3)]
    assert len(list((tmp_path / "out" / "shard=0").glob("*.parquet"))) == 3
    with pytest.raises(ValueError):
        sharding.write_shards(table.unionByName(table), f"file://{tmp_path}/again")


def test_convolution_against_plain_loops(docs):
    """Scores of whole texts by loops over every position, filter and word piece."""
    net = toxicity.ConvNet(seed=5)
    rng = np.random.default_rng(2)
    net.emb, net.bias = rng.normal(0, 1, net.emb.shape).astype(np.float32), [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    net.out, net.scale, net.shift = rng.normal(0, 0.1, net.out.shape).astype(np.float32), 0.7, 0.1
    rows = docs.select("doc_id", "text").filter("doc_id < 60").collect()
    texts = pa.array([r["text"] for r in rows], pa.string())
    ids_of = {}
    for first, _, data, offsets in toxicity.text_chunks(texts):
        w = toxicity.Words(data, offsets, fold=True, prefixes=toxicity.PREFIXES)
        ids = toxicity.piece_ids(w)
        ids_of |= {first + i: ids[a:b] for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:]))}
    want = []
    for i in range(len(rows)):
        z = float(net.out_bias)
        vectors = [[sum(float(net.emb[p][d]) for p in word) for d in range(toxicity.DIM)] for word in ids_of[i]]
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                sums = [sum(vectors[at + j][d] * float(net.conv[k][j * toxicity.DIM + d, f]) for j in range(width) for d in range(toxicity.DIM)) + float(net.bias[k][f]) for at in range(len(vectors) - width + 1)]
                z += max([0.0, *sums]) * float(net.out[k * toxicity.FILTERS + f])
        want.append(1 / (1 + math.exp(-(net.scale * z + net.shift))))
    assert np.allclose(net.scores(texts), want, atol=1e-4)
    assert len(want) > 50


def test_toxicity_sample_is_bounded(docs, monkeypatch):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).filter("doc_id is not null").dropDuplicates()
    first = [toxicity.train(docs.repartition(n), labels)[0].emb for n in (2, 5)]
    assert np.array_equal(*first)  # a repeated id and other partitions change nothing
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    full = docs.filter("length(text) > 3")
    with pytest.raises(ValueError, match="fits"):
        toxicity.train(full, labels.join(full.select("doc_id"), "doc_id", "left_semi"))


def test_deep_nesting_is_read_in_one_pass():
    """A hundred thousand open elements, and as many end tags without a start, are read in time that grows with the page."""
    import time

    n = 100_000
    for page, blocks in (("<div>" * n + "</section>" * n, 0), ("<div>" * n + "deep" + "</div>" * n, 1), ("<p>a</section>" * n, n), ("<ul>" + "<li><p>a" * n, n)):
        begin = time.process_time()
        found = html_text.read_blocks(page)
        assert len(found) == blocks and time.process_time() - begin < 15
    assert [(b.text, b.element.tag, b.element.depth) for b in html_text.read_blocks("<ul><li><p>a<li>b</ul></li>c")] == [("a", "p", 3), ("b", "li", 2), ("c", "#page", 0)]


def test_a_long_text_changes_no_other_score(spark, monkeypatch):
    """One text over the bound that comes first in the order of the sample is passed over; all others are learned from as without it."""
    rng = random.Random(4)
    vocab, bad = [f"w{i}" for i in range(200)], ["vile", "awful", "nasty"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(30)) + (f" {rng.choice(bad)}" * 3 if i % 3 == 0 else ""), "en") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    first = spark.createDataFrame(rows, "doc_id long, text string, lang string").orderBy(F.xxhash64("doc_id", F.lit(97))).first()["doc_id"]
    longer = [(i, t if i != first else t + " filler" * 4_000, x) for i, t, x in rows]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 25_000)
    nets = [toxicity.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(3), labels)[0] for r in ([x for x in rows if x[0] != first], longer)]
    assert np.array_equal(nets[0].emb, nets[1].emb) and np.array_equal(nets[0].out, nets[1].out)
    scores = nets[1].scores(pa.array([t for i, t, _ in rows if i != first]))
    assert (scores[[k for k, (i, *_) in enumerate([x for x in rows if x[0] != first]) if i % 3 == 0]] > 0.5).mean() > 0.9 and np.ptp(scores) > 0.5
    assert toxicity.chosen_sizes([9, 3, 1, 5, 1], 8) == [False, True, True, False, True]


def test_contradicting_labels(spark, docs):
    """A null label displaces none, and of two labels of an id the toxic, or the good, one counts, in any order."""
    ids = [r[0] for r in docs.filter("doc_id is not null").select("doc_id").distinct().collect()]
    plain = [(i, i % 2) for i in ids]
    noisy = plain + [(i, None) for i in ids] + [(i, 0) for i in ids] + [(None, 1)]
    table = lambda rows, name: spark.createDataFrame(rows, f"doc_id long, {name} int").repartition(4)
    a, b = (toxicity.train(docs, table(rows, "toxic"))[0] for rows in (plain, noisy))
    assert np.array_equal(a.emb, b.emb) and np.array_equal(a.out, b.out)
    seen = lambda rows: Counter((r["doc_id"], r["text"], r["kept"]) for r in quality_rules.judge(docs, table(rows, "quality")).collect())
    assert seen(plain) == seen(noisy)


def test_decision_list_verdict(docs, spark):
    """kept is the base rules and, in plain Python, the learned thresholds on ratios of the counts."""
    labels = docs.select("doc_id", (F.length("text") % 2).cast("int").alias("quality")).filter("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    out = quality_rules.judge(docs, labels).collect()
    rows = [r for r in out if not r["base_failed"]]
    ratio = lambda r: [r[a] / r[b] if r[b] else 0.0 for a, b in quality_rules.FEATURES.values()]
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learn = sorted((r["doc_id"], *ratio(r)) for r in rows if r["doc_id"] in marks)
    table = spark.createDataFrame(learn, ["__id", *quality_rules.FEATURES]).orderBy(F.xxhash64("__id", F.lit(97)), "__id", *quality_rules.FEATURES).collect()
    rules = quality_rules.learn_rules(np.array([list(r)[1:] for r in table]), np.array([marks[r["__id"]] == 0 for r in table]))
    rejected = lambda x: any(all((x[f] >= t) if above else (x[f] < t) for f, above, t in rule) for rule in rules)
    assert all(r["kept"] == (not r["base_failed"] and not rejected(ratio(r))) for r in out)


def test_interpolated_score_of_whole_texts(docs, rows):
    """score: bigram, unigram and uniform parts by dictionary counts, with the model's own weights."""
    seen = {}
    plain = lm_score.learn_weights
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    def spy(*a, **k):
        seen["w"] = plain(*a, **k)
        return seen["w"]

    lm_score.learn_weights = spy
    try:
        out = lm_score.score_corpus(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    finally:
        lm_score.learn_weights = plain
    tokens = [[*WORD.findall(lower(r[1])), None] for r in rows]
    train = [t for r, t in zip(rows, tokens) if not held(r[0])]
    uni, bi = Counter(w for t in train for w in t), Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    n, v = sum(uni.values()), len(uni)
    want = []
    for r, t in zip(rows, tokens):
        total = 0.0
        for a, b in zip(["<s>", *t], t):
            c = len(train) if a == "<s>" else uni[a]
            w = seen["w"][min(lm_score.OCTAVES - 1, c.bit_length())]
            total += math.log10(w[0] * (bi[a, b] / c if c else 0) + w[1] * uni[b] / n + w[2] / (v + 1))
        want.append((-1 if r[0] is None else r[0], round(total, 6)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in out)
    want.sort()
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-6, atol=1e-4)


def test_top_k_by_length_and_beyond_doubles(spark):
    """Vectors of two lengths, scores past 2**53 and clashing names; an accumulator counts the pairs scored."""
    rng = random.Random(9)
    vec = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(3 if i % 3 else 5)]) for i in range(160)] + [(200, [10.0**6, 1.0, 1.0]), (201, [10.0**6, 1.0, 1.0]), (202, [10.0**6, 1.0, 1.000977])]
    table = spark.createDataFrame(vec, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("grp", F.lit(0)).withColumn("low", F.lit(None).cast("double"))
    x = {i: [math.floor(1024 * a) for a in v] for i, v in vec}
    want = set()
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q and len(x[c]) == len(x[q]))[:10]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    scored = spark.sparkContext.accumulator(0)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(table, 10, F.col("vec_id") % 20 == 0, scored=scored).collect()}
    assert got == want and scored.value > 0


def test_top_k_prunes_clusters(spark):
    """On clustered data fewer than half of all pairs are scored, with the same result as brute force."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16)) * 4
    x = centre[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 16)) * 0.2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scored = spark.sparkContext.accumulator(0)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in topk.exact_top_k(table, 10, F.col("vec_id") % 100 == 0, scored=scored).collect()}
    y = np.floor(1024 * x).astype(np.int64)
    want = set()
    for q in range(0, 4_000, 100):
        s = y @ y[q]
        order = [c for c in np.lexsort((np.arange(4_000), -s)) if c != q][:10]
        want |= {(q, k + 1, int(c)) for k, c in enumerate(order)}
    assert got == want
    print("share of pairs scored:", scored.value / (40 * 4_000))
    assert scored.value < 0.5 * 40 * 4_000


def test_long_rows_come_few_at_a_time(spark, tmp_path):
    """Rows of a megabyte reach a Python worker, and lie in row groups, by bytes and not by thousands."""
    import glob

    import pyarrow.parquet as pq

    from wardlight.llm import lm_score
    from wardlight.llm.scratch import Scratch

    scratch = Scratch(spark, "few")
    rows = spark.range(0, 40, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(131_072)), lambda i: F.xxhash64(F.col("id"), i)).alias("v"))
    table = scratch.save(rows, "rows", row_group=lm_score.BATCH_BYTES)
    files = glob.glob(f"{scratch.root.removeprefix('file://')}/rows/*.parquet")
    assert max(pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)) <= 17

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    with scratch.settings(**lm_score.BOUNDED):
        got = scratch.save(table.coalesce(1).mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 40 and max(r["n"] for r in got) <= 17


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Rows far beyond what ``train`` would sample are learned from in four shards; other partitions and repeats change nothing."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(20)) + (f" vile{i % 4}" if i % 3 == 0 else ""), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    nets = [toxicity.train_all(d, labels, scratch.Scratch(spark, "tox")) for d in (docs.repartition(2), docs.unionByName(docs.limit(40)).repartition(5))]
    assert np.array_equal(nets[0][0].emb, nets[1][0].emb) and np.array_equal(nets[0][0].out, nets[1][0].out)
    scores = nets[0][0].scores(pa.array([t for _, t, _ in rows]))
    assert ((scores > 0.5) == np.array([i % 3 == 0 for i, *_ in rows])).mean() > 0.95
    [(lang, threshold)] = nets[0][1].collect()
    assert lang == "en" and 0 < threshold < 1
    one, none = toxicity.train_all(docs, labels.filter("toxic = 1"), scratch.Scratch(spark, "tox"))
    assert np.ptp(one.scores(pa.array(["a b", "vile1"]))) == 0 and none.count() == 0
