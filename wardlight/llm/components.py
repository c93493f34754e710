"""Connected components by least-label propagation with pointer jumping, each step cut by a written table."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch

_runs = 0


#: Rows of a written file.
ROWS = 20_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp (smallest id of its component) of every vertex of edges (a, b).

    edges is read twice, so it should be a written table. A step gives each vertex the least label of its neighbours, then the label of its label. Both joins read
    written tables, so a vertex with very many neighbours is a skewed join that Spark can split.
    """
    global _runs
    _runs += 1
    name, files = f"cc-{_runs}", 2 * edges.count() // ROWS + 1
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v").distinct(), f"{name}-edges", files=files)
    labels = scratch.save(both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("id"), F.least("v", "m").alias("comp")), f"{name}-0", files=files)
    for step in itertools.count(1):  # labels only fall, so this ends
        near = both.join(labels.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("comp").alias("m"))
        hooked = scratch.save(labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), f"{name}-{step}h", files=files)
        up = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        jumped = scratch.save(hooked.join(up, "comp").select("id", F.col("up").alias("comp"), F.col("old")), f"{name}-{step}", files=files)
        changed = jumped.filter("comp <> old").isEmpty()
        labels = jumped.select("id", "comp")
        if changed:
            return labels
