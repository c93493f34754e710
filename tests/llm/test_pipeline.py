"""Stages of the pipeline on a small table, each against what its operator says of the rows before it."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from wardlight.llm import line_dedup, near_dups, quality_rules


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf_dir).cache()
    kept = {r[0] for r in quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("doc_id").collect()}
    assert good.columns == docs.columns and {r[0] for r in good.select("doc_id").collect()} == kept
    lines = stages["line dedup"](spark, good, sf_dir).cache()
    want = {(r["doc_id"], r["kept_text"]) for r in line_dedup.dedup_lines(good).collect()}
    assert lines.columns == docs.columns and {(r["doc_id"], r["text"]) for r in lines.collect()} == want
    once = stages["n-gram Jaccard join"](spark, lines, sf_dir).cache()
    heads = {r["component_id"] for r in near_dups.near_duplicates(lines).collect()}
    assert once.columns == docs.columns and Counter(r["doc_id"] for r in once.collect()) == Counter(heads)
    mixed = stages["mixing sources to target weights"](spark, once, sf_dir).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    out = stages["SentencePiece encoding and decoding"](spark, mixed, sf_dir)
    assert out.count() == mixed.count() and out.filter(~F.col("round_trip")).count() == 0


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and further columns of names the stages use."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(60) for _ in range(12)]
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(base)]
    rows += [(3, base[3], "en", "b", 1), (3, base[3], "en", "b", 1), (5, text(70), "fr", "a", 1), (5, text(70), None, None, None), (None, text(50), None, None, None), (None, text(50), None, None, None), (None, base[0], "en", "a", 1)]
    rows += [(90, None, None, None, None), (91, "", "en", "a", 0), (91, "", "en", "a", 0), (92, " \n ", "en", "a", 3), (93, text(40_000), "en", "a", 1), (94, f"{base[1]} {text(2)}", "en", "a", 1)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, copies long, __x int, ids string, v long, n long, size long"
    docs = spark.createDataFrame([(*r, "k", 1, 2, "i", 3, 4, 5) for r in rows], fields).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, where = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    seen = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    good = stages["quality rules"](spark, docs, where).cache()
    assert seen(good) == Counter((i, t) for i, t, *_ in rows if t and len(t.split()) >= 20) and good.columns == docs.columns
    lines = stages["line dedup"](spark, docs, where).cache()
    assert seen(lines) == Counter((i, t or "") for i, t, *_ in rows) and lines.columns == docs.columns
    once = stages["n-gram Jaccard join"](spark, docs, where).cache()
    want = Counter((i, t) for i, t, *_ in rows) - Counter({(3, base[3]): 2, (None, base[0]): 1, (94, rows[-1][1]): 1})
    assert seen(once) == want and once.columns == docs.columns
    mixed = stages["mixing sources to target weights"](spark, docs, where).cache()
    got = seen(mixed)
    assert set(got) <= {(i, t) for i, t, *_ in rows if t and t.split()} and all(n <= 3 * Counter((i, t) for i, t, *_ in rows)[k] for k, n in got.items()) and mixed.columns == docs.columns
    per = Counter()
    for r in mixed_rows(docs):
        per[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert per == Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixed.collect())
    out = stages["SentencePiece encoding and decoding"](spark, docs, where).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out) and sum(not r["ids"] for r in out) == sum(not t for _, t, *_ in rows)
    assert corpus_pipeline.run(spark, where).count() > 0


def test_columns_of_the_user_stay(spark, tmp_path):
    """Columns with the names of what operators make or work with come out of every stage with their own values."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    names = ["kept", "n_words", "base_failed", "n_lines", "n_dropped", "kept_text", "__row", "__id", "__n", "__copies", "copies", "size", "target", "key", "__user_0", "__text", "did", "rank"]
    rows = [(i, text(60), "en", "ab"[i % 2], i, *[f"{n} of {i}" for n in names]) for i in range(30)]
    rows.append((30, rows[0][1], "en", "a", 7, *rows[0][5:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    given = {tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and len(set(got)) >= 15, name
        want = {(*r[:4], len(r[1]), *r[5:]) for r in given} if name == "line dedup" else given  # that stage counts the characters of what stays
        assert set(got) <= want, name


def mixed_rows(docs):
    from wardlight.llm.mixing import mix_to_targets

    return [r for r in mix_to_targets(docs).collect() if r["copies"]]
