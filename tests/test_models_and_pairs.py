"""Models in place of rules, and similar vectors by pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_models_swap_in(spark):
    from wardlight.operators import models

    class Half:
        def predict(self, x):
            return np.where(np.isnan(x[:, 1]), np.nan, x[:, 0] * 2)

    class Wrong:
        def predict(self, x):
            return x

    rows = spark.createDataFrame([(1, 0.2, 1.0), (2, 0.9, 1.0), (3, 0.1, None), (4, -5.0, 2.0)], "id long, a double, b double").repartition(2)
    features, default = {"a": F.col("a"), "b": F.col("b")}, F.col("a") + 1
    got = lambda model: {r["id"]: r["p"] for r in models.scored(rows, features, default, "p", model).collect()}
    assert got(None) == {1: 1.2, 2: 1.9, 3: 1.1, 4: -4.0} and got(Half()) == {1: 0.4, 2: 1.0, 3: None, 4: 0.0}
    with pytest.raises(Exception, match="the model gave"):
        got(Wrong())


def test_entity_models(spark):
    from wardlight.operators import models

    class Named:
        def entities(self, texts):
            return [[("drug", 0, 3, 0.99), ("none", 2, 2, 1.0), ("far", 5, 999, 1.0)] if t else [] for t in texts]

    notes = spark.createDataFrame([(1, "CAP and sepsis"), (2, None), (3, "ab"), (4, "sepsis")], "document_id long, text string")
    got = lambda model: sorted(tuple(r) for r in models.entities(notes, model).collect())
    rule = [(1, "pneumonia", 0, 3, 0.9, "CAP"), (1, "sepsis", 8, 14, 0.9, "sepsis"), (4, "sepsis", 0, 6, 0.9, "sepsis")]
    assert got(None) == rule
    assert got(Named()) == [(1, "drug", 0, 3, 0.99, "CAP"), rule[1], (4, "drug", 0, 3, 0.99, "sep")]


def brute(rows, threshold):
    out = set()
    some = [(i, np.array(v, float)) for i, v in rows if v and None not in v and any(v)]
    for k, (i, x) in enumerate(some):
        for j, y in some[k + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize(("block", "pivots", "threshold"), [(4_096, 256, 0.92), (7, 5, 0.92), (16, 1, 0.5), (30, 9, 0.999)])
def test_pairs_lose_nothing(spark, block, pivots, threshold):
    from wardlight.operators import similar

    rng = np.random.default_rng(block)
    centres = rng.normal(0, 1, (8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.25, 6)).tolist()) for i in range(260)] + [(300 + i, rng.normal(0, 1, 6).tolist()) for i in range(60)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None]), (403, []), (404, [1.0, 2.0]), (405, [2.0, 4.1]), (406, [3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r["a"], r["b"]) for r in similar.pairs(table, threshold, block, pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_pairs_prune_clustered_vectors(spark):
    """Of the pairs of 4,000 vectors in 40 clusters of 16 dimensions less than a fifth is multiplied; equal vectors are one."""
    from wardlight.operators import similar

    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.12, 16)).tolist()) for i in range(4_000)] + [(5_000 + i, [1.0] * 16) for i in range(50)]
    scored = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = similar.pairs(table, 0.92, 512, scored=scored).collect()
    x = np.array([v for _, v in rows[:4_000]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert len([r for r in got if r["a"] < 4_000 and r["b"] < 4_000]) == int((np.triu(x @ x.T, 1) >= 0.92).sum())
    assert sum(r["a"] == 5_000 for r in got) >= 49 and scored.value < 0.2 * 4_000 * 3_999 / 2, scored.value
    print(scored.value / (4_000 * 3_999 / 2))


def test_pivots_only_where_they_exclude_cells():
    """Vectors without clusters are compared in blocks: a vector is moved once a block, not to most of 256 cells."""
    from wardlight.operators import similar

    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    reach = 0.4
    loose = unit(rng.normal(0, 1, (1_000, 64)))
    assert len(similar.worthwhile(loose, similar.farthest_first(loose, 256), 144_000, 4_096, reach)) == 1
    close = unit(np.repeat(rng.normal(0, 1, (40, 16)), 25, axis=0) + rng.normal(0, 0.12, (1_000, 16)))
    assert len(similar.worthwhile(close, similar.farthest_first(close, 256), 4_000, 512, reach)) > 4
