"""All pairs of similar vectors, exactly, by distances to pivots.

On unit vectors a cosine of t is a distance of sqrt(2 - 2t), so the triangle inequality holds. Every vector belongs to the cell of its nearest pivot;
a vector meets another cell only where both bounds allow a partner there: its distance to that pivot is within the cell's radius and the reach of the
threshold, and exceeds that to its own pivot by no more than twice the reach. Inside a cell vectors are ordered by their distance to the pivot, and only
slices whose distances differ by no more than the reach are multiplied. Cells are split into blocks of a bounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.sources.shared import Workspace

#: Vectors that pivots are chosen from, and pivots of one length of vectors at most: they bound what the driver and a broadcast hold.
SAMPLE, PIVOTS = 2_048, 256
#: Room for rounding in distances, rows of a slice within a block.
SLACK, SLICE = 1e-6, 256
#: Rows that a Python worker hands over at once, products that cost as much as moving one vector to another block.
OUT_ROWS, MOVE = 8_192, 1_000


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it, while new ones lie apart."""
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(most, len(x)) and gap.max() > SLACK:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _unit(column) -> np.ndarray:
    x = np.stack(column.to_numpy())
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def worthwhile(x: np.ndarray, pivots: np.ndarray, n: int, block: int, reach: float) -> np.ndarray:
    """The first of the pivots, as many as make n vectors like the sample x cheapest to compare: where no bound excludes a cell one pivot is left, and blocks are compared.

    Any number gives the same pairs; the sample only chooses the cheapest plan.
    """
    dist, costs = _distances(x, pivots), {}
    for p in sorted({min(p, len(pivots)) for p in (1, 4, 16, 64, 256, len(pivots))}):
        some = dist[:, :p]
        own, far = some.argmin(axis=1), some.min(axis=1)
        radius = np.full(p, -np.inf)
        np.maximum.at(radius, own, far)
        guests = ((some <= radius + reach) & (some <= far[:, None] + 2 * reach) & (np.arange(p) > own[:, None])).mean(axis=0)
        homes = np.bincount(own, minlength=p) / len(x)
        blocks, rooms = np.ceil(homes * n / block), np.ceil(guests * n / block)
        moved = (homes * (blocks + rooms) + guests * blocks).sum()
        costs[p] = n * moved * MOVE + n * n * (homes * homes / 2 + homes * guests).sum()
    return pivots[: min(costs, key=costs.get)]


def pairs(vectors: DataFrame, threshold: float = 0.92, block: int = 4_096, pivots: int = PIVOTS, scored: Accumulator | None = None) -> DataFrame:
    """All pairs (a, b, cosine), a < b, of vectors (vec_id, embedding) at least as similar as the threshold; ``scored`` counts the pairs that were multiplied.

    Equal vectors are one: their least id stands for them in all pairs, and each other id is paired with it alone. Null or
    empty vectors, those with a null component and zero vectors take no part; vectors of other lengths are not compared. A length of
    which the sample of SAMPLE rows holds none is one cell, compared in blocks.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "similar")
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0))
    heads = work.save(whole.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "heads")
    members = whole.join(heads.withColumnRenamed("vec_id", "a"), "v").filter(F.col("a") < F.col("vec_id")).select("a", F.col("vec_id").alias("b"), F.lit(1.0).alias("cosine"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    some = heads.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).toPandas()
    lengths = some["v"].map(len)
    counts = {r["d"]: r["n"] for r in heads.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("d").isin([int(d) for d in lengths.unique()])).collect()}  # at most SAMPLE lengths
    units = {int(d): _unit(some["v"][lengths == d]) for d in lengths.unique()}
    chosen = {d: worthwhile(x, farthest_first(x, pivots), counts[d], block, reach) for d, x in units.items()}
    known = spark.sparkContext.broadcast(chosen)  # at most SAMPLE vectors

    def assign(frames):
        for pdf in frames:
            sizes = pdf["v"].map(len)
            own, far = np.full(len(pdf), 0), np.zeros(len(pdf))
            for d in sizes.unique():
                at = np.flatnonzero(sizes == d)
                if d in known.value:
                    dist = _distances(_unit(pdf["v"].iloc[at]), known.value[d])
                    own[at], far[at] = dist.argmin(axis=1), dist.min(axis=1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "d": sizes, "cell": own, "far": far, "v": pdf["v"]})

    homes = work.save(heads.mapInPandas(assign, "vec_id long, d int, cell int, far double, v array<double>"), "homes")
    cells = work.save(homes.groupBy("d", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")), "cells")
    radii = {(r["d"], r["cell"]): r["radius"] for r in cells.filter(F.col("d").isin(list(chosen))).collect()}  # one a pivot
    bounds = spark.sparkContext.broadcast({d: np.array([radii.get((d, i), -math.inf) for i in range(len(p))]) for d, p in chosen.items()})

    def replicate(frames):
        for pdf in frames:
            for d, part in pdf.groupby("d"):
                if d not in known.value:
                    continue
                dist, own = _distances(_unit(part["v"]), known.value[d]), part["cell"].to_numpy()
                near = (dist <= bounds.value[d] + reach) & (dist <= part["far"].to_numpy()[:, None] + 2 * reach) & (np.arange(dist.shape[1]) > own[:, None])
                rows, cells = np.nonzero(near)
                for first in range(0, len(rows), OUT_ROWS):
                    row, cell = rows[first : first + OUT_ROWS], cells[first : first + OUT_ROWS]
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "d": d, "cell": cell, "far": dist[row, cell], "v": part["v"].to_numpy()[row]})

    guests = homes.mapInPandas(replicate, "vec_id long, d int, cell int, far double, v array<double>")
    blocks = cells.select("d", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    home = homes.join(blocks, ["d", "cell"]).withColumn("own", dealt).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    home = home.select("d", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.lit(-1).alias("guest"), F.col("own").alias("side"), "vec_id", "far", "v")
    hosts = homes.join(blocks, ["d", "cell"]).withColumn("lo", dealt)
    rooms = guests.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rooms"))
    hosts = hosts.join(rooms, ["d", "cell"]).withColumn("guest", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)))
    hosts = hosts.select("d", "cell", "lo", F.lit(-1).alias("hi"), "guest", F.lit(0).alias("side"), "vec_id", "far", "v")
    visits = guests.join(rooms, ["d", "cell"]).withColumn("guest", F.pmod(F.xxhash64("vec_id"), F.col("rooms")).cast("int")).join(blocks, ["d", "cell"]).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = visits.select("d", "cell", "lo", F.lit(-1).alias("hi"), "guest", F.lit(1).alias("side"), "vec_id", "far", "v")

    def compare(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks lo and hi of a cell, or block lo and its guests: some pairs at a time."""
        _, _, lo, hi, guest = key
        pdf = pd.concat(list(frames)).sort_values("far")  # two blocks at most
        side, ids, far, x = pdf["side"].to_numpy(), pdf["vec_id"].to_numpy(), pdf["far"].to_numpy(), _unit(pdf["v"])
        one = guest < 0 and lo == hi
        left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(side == (0 if guest >= 0 else lo)), np.flatnonzero(side == (1 if guest >= 0 else hi)))
        n = 0
        for first in range(0, len(left), SLICE):
            rows = left[first : first + SLICE]
            a, b = np.searchsorted(far[right], [far[rows[0]] - reach, far[rows[-1]] + reach])
            for begin in range(max(a, first) if one else a, b, SLICE):
                columns = right[begin : min(b, begin + SLICE)]
                s = x[rows] @ x[columns].T
                n += s.size
                i, j = np.nonzero(s >= threshold - 1e-12)
                ok = rows[i] < columns[j] if one else np.ones(len(i), bool)
                if ok.any():
                    a_ids, b_ids = ids[rows[i[ok]]], ids[columns[j[ok]]]
                    yield pd.DataFrame({"a": np.minimum(a_ids, b_ids), "b": np.maximum(a_ids, b_ids), "cosine": s[i[ok], j[ok]]})
        if scored is not None:
            scored.add(n)

    met = home.unionByName(hosts).unionByName(visits).groupBy("d", "cell", "lo", "hi", "guest")
    return met.applyInPandas(compare, "a long, b long, cosine double").unionByName(members)
