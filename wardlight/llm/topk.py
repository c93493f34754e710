"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots cut data into Voronoi groups, more of them the more rows there are. A group is summarised by its size, radius and
largest norm, so for a query q and a group with pivot p and radius r no score exceeds q.p + |q| r, |q| times the norm, nor
what the half-space between p and the query's own pivot allows. Counting group sizes by their lower bounds, and scoring a
bounded set of reference rows, gives each query a floor that its k-th best score cannot be under; a query is sent only to
cells with a group whose bound reaches the floor. A cell is some groups that lie near each other, or a block of one
large group, of about CELL_ROWS rows. A task holds one cell at a time while its queries stream past; it visits
the cell's groups while the floor rises, and skips those whose bound stays below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.scratch import Scratch

#: Bounds on what is broadcast: pivots (the square root of the rows up to this) and reference rows, by a hash of the vectors.
PIVOTS, REFERENCES = 1_024, 2_048
#: Rows of a cell: a 256th of all, within these bounds. Queries met at a time.
CELL_ROWS, QUERY_ROWS = (512, 8_192), 256


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as long; null where the vector is null or empty or a component is null or not finite."""
    ok = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ok, F.transform(vector, lambda x: F.floor(factor * x.cast("double")).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def _drawn(rows: DataFrame, n: int, share: float, distinct: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most n rows by a hash, the same on each run; about share of all rows are looked at."""
    mixed = F.xxhash64("v") if distinct else F.xxhash64("vec_id", "v")
    part = rows.select("vec_id", "v").filter(mixed <= F.lit(int(min(2**63 - 1, -(2**63) + share * 2**64))))
    part = part.groupBy("v").agg(F.min("vec_id").alias("vec_id")) if distinct else part
    got = part.orderBy(mixed, "vec_id").limit(n).select("vec_id", "v").toArrow()
    return got.column("vec_id").to_numpy(), _matrix(got.column("v")).astype(float)


@dataclass
class Voronoi:
    """Groups by number: pivots, sizes, radii, largest norms, and the cells they lie in (first, how many)."""

    pivots: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    cell: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, summary) -> "Voronoi":
        n, cell_rows = len(pivots), min(CELL_ROWS[1], max(CELL_ROWS[0], int(summary["n"].sum()) // 256))
        sizes, radius, norm = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        at = summary["grp"].to_numpy()
        sizes[at], radius[at], norm[at] = summary["n"], summary["radius"] * (1 + 1e-9) + 1e-6, summary["norm"] * (1 + 1e-9) + 1e-6
        blocks = np.maximum(1, -(-sizes // cell_rows))
        cell, last, filled, at = np.zeros(n, np.int64), -1, cell_rows, 0
        left = np.ones(n, bool)
        for _ in range(n):  # a walk from pivot to nearest pivot, cut into cells; at most PIVOTS steps
            left[at] = False
            if filled + sizes[at] > cell_rows:
                last, filled = last + 1, 0
            cell[at], filled = last, filled + sizes[at]
            if blocks[at] > 1:
                last, filled = last + int(blocks[at]) - 1, cell_rows
            if left.any():
                at = int(np.where(left, ((pivots - pivots[at]) ** 2).sum(1), np.inf).argmin())
        return cls(pivots, sizes, radius, norm, cell, blocks)

    def bounds(self, q: np.ndarray, groups: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """For each query and group: what no score exceeds, and what all scores reach."""
        size = np.sqrt((q * q).sum(1))[:, None]
        mid, slack = q @ self.pivots.T, size * self.radius
        d2 = size**2 - 2 * mid + (self.pivots**2).sum(1)
        own = d2.argmin(1)
        apart = np.sqrt(np.maximum(((self.pivots**2).sum(1)[:, None] - 2 * self.pivots @ self.pivots.T + (self.pivots**2).sum(1)), 0))[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, np.maximum(0, d2 - d2[np.arange(len(q)), own][:, None]) / (2 * apart), 0) * (1 - 1e-9)
        high = np.minimum(np.minimum(mid + slack, size * self.norm), (size**2 + self.norm**2 - plane**2) / 2 + 1)
        return high[:, groups], (mid - slack)[:, groups]

    def error(self, q: np.ndarray) -> np.ndarray:
        """How far a score computed in floating point may be off; scores are whole, so less than one where products stay small."""
        return 1 + 2**-50 * q.shape[1] * np.sqrt((q * q).sum(1)) * self.norm.max()


def _exact(q: np.ndarray, x: np.ndarray) -> int:
    """The inner product in whole numbers, held within 64 bits."""
    return max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q.tolist(), x.tolist()))))


def _best(q: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, off: float, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best of the rows scored s."""
    if len(s) > k:
        s_k = np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero(s >= (s_k if small else s_k - 2 * off))
        x, ids, s = x[near], ids[near], s[near]
    score = s.astype(np.int64) if small else np.array([_exact(q, y) for y in x], np.int64)
    order = np.lexsort((ids, ~score))[:k]  # ~ reverses the order of whole numbers without overflow
    return ids[order], score[order]


def exact_top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None, scored=None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k best other ids, ties to the smaller id.

    Rows whose vector is null, empty or holds null or non-finite components, and rows without id, take no part. A query
    meets the rows whose vectors have its length. Rows that repeat an id are candidates of their own; as queries they count
    once, by the vector that comes first. Components and scores beyond 64 bits stop at its ends, and the order among such scores is open. An empty table gives
    an empty result; other columns are ignored. scored: an accumulator that adds up the pairs scored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("is_query"))
    rows = scratch.save(rows.filter("v is not null and vec_id is not null").withColumn("d", F.size("v")), "rows")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    lengths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2"), F.max("is_query").alias("asked")).filter("asked").orderBy("d").collect()
    found = [_of_length(scratch, rows.filter(F.col("d") == r["d"]), r["d"], r["n"], r["norm2"] < 2.0**53, k, scored) for r in lengths]  # one a vector length
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in found:
        out = out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(scratch: Scratch, rows: DataFrame, length: int, n: int, small: bool, k: int, scored) -> DataFrame:
    """query_id, vec_id, score: the best of each cell for the queries sent to it. small: sums of products are exact in doubles."""
    context = rows.sparkSession.sparkContext
    repeats = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # a query leaves out all rows of its id
    n_pivots = min(PIVOTS, max(8, int(n**0.5)))
    _, pivots = _drawn(rows, n_pivots, 1.0 if n < 100_000 else 4 * n_pivots / n, distinct=True)
    if not len(pivots):  # few distinct vectors, all hashed high
        _, pivots = _drawn(rows, n_pivots, 1.0, distinct=True)
    ref_ids, refs = _drawn(rows, REFERENCES, 1.0 if n < 100_000 else 2 * REFERENCES / n, distinct=False)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v")).astype(float)
                at = ((pivots * pivots).sum(1) - 2 * x @ pivots.T).argmin(1)
                dist, norm = np.sqrt(((x - pivots[at]) ** 2).sum(1)), np.sqrt((x * x).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at.astype(np.int32)), pa.array(dist), pa.array(norm)], names=["vec_id", "v", "is_query", "grp", "dist", "norm"])

    grouped = rows.select("vec_id", "v", "is_query").mapInArrow(assign, "vec_id long, v array<long>, is_query boolean, grp int, dist double, norm double")
    grouped = scratch.save(grouped, f"grouped-{length}")
    summary = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).toPandas()  # at most PIVOTS rows
    shared = context.broadcast((Voronoi.of(pivots, summary), refs, ref_ids))

    def route(batches):
        """Each query with its floor, once for each cell it needs."""
        map_, refs, ref_ids = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, QUERY_ROWS):
                b = batch.slice(first, QUERY_ROWS)
                q, ids, low = _matrix(b.column("v")).astype(float), b.column("vec_id").to_numpy(), np.full(b.num_rows, -np.inf)
                high, least = map_.bounds(q)
                order = np.argsort(-least, axis=1)
                enough = np.cumsum(map_.sizes[order], axis=1) >= k + repeats
                has, at = enough.any(1), enough.argmax(1)
                low[has] = np.take_along_axis(least, order, 1)[np.arange(len(q)), at][has]
                s = q @ refs.T
                s[ids[:, None] == ref_ids] = -np.inf
                if s.shape[1] > k:
                    low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                low -= map_.error(q)
                qi, gi = np.nonzero((high >= low[:, None]) & (map_.sizes > 0))
                times = map_.blocks[gi]
                qi, cell = np.repeat(qi, times), np.repeat(map_.cell[gi] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                sent = np.unique(np.stack([cell, qi], axis=1), axis=0)
                qi = pa.array(sent[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(sent[:, 0]), b.column("vec_id").take(qi), b.column("v").take(qi), pa.array(low[sent[:, 1]]), pa.nulls(len(qi), pa.int32())], names=["cell", "id", "v", "low", "grp"])

    def place(batches):
        """Each row in its cell."""
        map_ = shared.value[0]
        for b in batches:
            grp, spread = b.column("grp").to_numpy(), b.column("spread").to_numpy()
            cell = map_.cell[grp] + spread % map_.blocks[grp]
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("vec_id"), b.column("v"), pa.nulls(b.num_rows, pa.float64()), b.column("grp")], names=["cell", "id", "v", "low", "grp"])

    def solve(batches):
        """Rows of one cell come before its queries."""
        map_ = shared.value[0]
        cell, parts, groups = None, [], []
        for batch in batches:
            cells, data = batch.column("cell").to_numpy(), batch.column("grp").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (data[1:] != data[:-1])) + 1).tolist(), batch.num_rows]
            for first, end in zip(cuts[:-1], cuts[1:]):
                if first == end:
                    continue
                b = batch.slice(first, end - first)
                if cell != cells[first]:
                    cell, parts, groups = cells[first], [], []
                if data[first]:
                    parts.append((b.column("grp").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("v"))))
                    continue
                if parts and not groups:
                    grp, ids, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    groups = [(g, ids[at][o], x[at][o]) for g in np.unique(grp) if len(at := np.flatnonzero(grp == g)) and len(o := np.argsort(ids[at], kind="stable"))]
                for at in range(0, b.num_rows, QUERY_ROWS) if groups else ():
                    yield meet(map_, groups, b.slice(at, QUERY_ROWS))

    def meet(map_, groups, b):
        raw, qid, low = _matrix(b.column("v")), b.column("id").to_numpy(), b.column("low").to_numpy(zero_copy_only=False).copy()
        q, off = raw.astype(float), map_.error(raw.astype(float))
        high, _ = map_.bounds(q, np.array([g for g, _, _ in groups]))
        kept: list[list] = [[] for _ in qid]
        top = np.full((len(qid), k), -np.inf)
        for g in np.argsort(-high.mean(axis=0)):
            _, ids, x = groups[g]
            rows = np.flatnonzero(high[:, g] >= low)
            if not len(rows):
                continue
            if scored is not None:
                scored.add(len(rows) * len(ids))
            s = q[rows] @ x.T.astype(float)
            s[qid[rows][:, None] == ids] = -np.inf
            for r, line in zip(rows, s):
                at = np.flatnonzero(line >= max(low[r], -1e300))
                if len(at):
                    kept[r].append((g, at, line[at]))
            best = np.concatenate([top[rows], s], axis=1)
            top[rows] = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
            low[rows] = np.maximum(low[rows], top[rows].min(axis=1) - 2 * off[rows])
        out = []
        for r, parts in enumerate(kept):
            if parts:
                x, ids, s = np.concatenate([groups[g][2][at] for g, at, _ in parts]), np.concatenate([groups[g][1][at] for g, at, _ in parts]), np.concatenate([p[2] for p in parts])
                ids, score = _best(raw[r], qid[r], x, ids, s, k, off[r], small)
                out.append((np.full(len(ids), qid[r]), ids, score))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    form = "cell long, id long, v array<long>, low double, grp int"
    queries = grouped.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    data = grouped.select("vec_id", "v", "grp", F.xxhash64("vec_id", "dist").bitwiseAND(0x7FFFFFFF).alias("spread")).mapInArrow(place, form)
    both = data.unionByName(queries.mapInArrow(route, form)).repartition("cell").sortWithinPartitions("cell", F.col("grp").isNull())
    return both.mapInArrow(solve, "query_id long, vec_id long, score long")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best of each embedding whose id is divisible by 100: query_id, rank, vec_id, score."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10, F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
