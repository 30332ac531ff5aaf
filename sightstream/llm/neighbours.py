"""Operator 4: nearest neighbours of a stated query set among all vectors, by a block matrix join.

Queries and candidates are packed into blocks; each candidate block meets each query block once, as a tile. A tile is a key
of its own on both sides of the join, so that no task has to take all candidates of a query block. In a tile, vectors are
bytes with a scale of their own, distances come from one product of integer matrices (exact in float32 while
dimension * 127 * 127 < 2 ** 24), and the length of what rounding took from each vector bounds the error. A pair survives
if its least possible distance is not above the k-th smallest of the query's greatest possible ones. Survivors are
computed again from the original vectors in double precision, so the result is exact. Heaps merge tiles within a task,
and a ranked window merges the tasks' k rows a query.

Blocks travel with the original components, in the type that they came in, and bytes are made in the tile: a group of
vectors too near each other for the bounds to part them survives as a whole, and only where the originals are at hand is a
tile's answer k rows a query whatever survives. Fetching survivors' originals by a join would have no such bound.

Nulls and ties: vectors null, empty, zero, or holding null or non-finite components take no part, nor do rows with a
null vec_id. Ties go to the smaller vec_id. Vectors of different dimension are never compared. Every row is a candidate
of its own and every query row a query of its own, also where rows share a vec_id: only the query's own row is left out.
Finite components of any size count: a tile is scaled by a power of two before anything is squared, so is a distance
whose squares would overflow or vanish. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.llm.common import stored

K = 10
EVERY = 100

#: Vectors in a block of queries or of candidates, on average.
BLOCK = 4096

#: Queries of a tile that are compared at once, and queries whose heaps a task holds.
ROWS = 256
HEAPS = 50_000

#: Tiles are dealt out to twice as many partitions, but to so many at most.
PARTITIONS = 32_768

#: Components outside of these sizes, and not zero, are scaled before they are squared.
TINY, HUGE = 1e-140, 1e150


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """row (a number for each), vec_id, embedding, query: the rows that take part, as a table, so that numbers stay what they are."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.coalesce(is_query, F.lit(False)).alias("query")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return stored(v.where(finite & F.exists("embedding", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id()), "vectors")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, squared length of the scaled bytes, length of what rounding took) of each row."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, (back * back).sum(1), np.sqrt(((x - back) ** 2).sum(1))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, of rows of a to rows of b, components added in order."""
    most = np.maximum(np.abs(a).max(1), np.abs(b).max(1))
    least = np.minimum(np.where(a == 0, np.inf, np.abs(a)).min(1), np.where(b == 0, np.inf, np.abs(b)).min(1))
    odd = (most > HUGE) | (least < TINY)
    exponent = np.frexp(np.where(odd, most, 1.0))[1]
    if odd.any():
        e = np.where(odd, exponent, 0)[:, None]
        a, b = np.ldexp(a, -e), np.ldexp(b, -e)
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        out += d * d
    with np.errstate(over="ignore"):
        return np.where(odd, np.ldexp(np.sqrt(out), exponent), np.sqrt(out))


def tile(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query row its k nearest of the tile: (distance, vec_id)."""
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    e = int(np.frexp(max(np.abs(q).max(), np.abs(c).max()))[1])
    c8, cs, cn, ce = quantise(np.ldexp(c, -e))
    q8, qs, qn, qe = quantise(np.ldexp(q, -e))
    ct = c8.astype(exact).T
    for lo in range(0, len(q), ROWS):
        own = slice(lo, lo + ROWS)
        dot = (q8[own].astype(exact) @ ct).astype(np.float64)
        d = np.sqrt(np.maximum(qn[own, None] + cn - 2 * qs[own, None] * cs * dot, 0))
        # the last term is for squares that vanish: all components are 1 at most here
        err = (qe[own, None] + ce) * (1 + 1e-9) + 1e-6 * np.sqrt(qn[own, None] + cn) + 1e-150
        self = qrow[own, None] == crow
        high = np.where(self, np.inf, d + err)
        if high.shape[1] > k:
            most = np.partition(high, k - 1, axis=1)[:, k - 1 : k]
        else:
            most = np.full((len(high), 1), np.inf)
        i, j = np.nonzero((d - err <= most) & ~self)
        score = np.concatenate([distance(q[lo + i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((cid[j], score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.searchsorted(i, np.arange(len(high) + 1))
        for r in range(len(high)):
            s, t = starts[r], min(starts[r + 1], starts[r] + k)
            if t > s:
                yield int(qrow[lo + r]), list(zip(score[s:t].tolist(), cid[j[s:t]].tolist(), strict=True))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: exact k nearest of each row of vectors that is_query holds for, but itself."""
    rows = usable(vectors, is_query)
    all_rows, all_queries = rows.agg(F.count("*"), F.count_if("query")).first()
    n_c, n_q = (-(-max(n, 1) // block) for n in (all_rows, all_queries))

    def packed(v: DataFrame, n: int, name: str) -> DataFrame:
        of = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)
        return v.groupBy(F.size("embedding").alias("dim"), of).agg(F.collect_list(F.struct("row", "vec_id", "embedding")).alias(f"{name}s"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df: df.repartition(min(2 * n_q * n_c, PARTITIONS), "dim", "q", "c")
    left, right = packed(rows, n_c, "c").withColumn("q", every(n_q)), packed(rows.where("query"), n_q, "q").withColumn("c", every(n_c))
    tiles = dealt(left).join(dealt(right), ["dim", "q", "c"]).select("dim", "qs", "cs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, i, s) for q, found in best.items() for s, i in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_row", "vec_id", "score"])

        for b in batches:
            for at in range(b.num_rows):
                dim = b.column(0)[at].as_py()
                sides = []
                for side in (b.column(1)[at].values, b.column(2)[at].values):
                    sides.append((side.field(0).to_numpy(), side.field(1).to_numpy(), side.field(2).flatten().to_numpy().reshape(-1, dim).astype(np.float64)))
                (qrow, _, q), (crow, cid, c) = sides
                for row, found in tile(qrow, q, crow, cid, c, k):
                    best[row] = heapq.nsmallest(k, best[row] + found) if row in best else found
                    if len(best) > HEAPS:
                        yield out()
        yield out()

    ranked = Window.partitionBy("query_row").orderBy("score", "vec_id")
    found = tiles.mapInArrow(run, "query_row long, vec_id long, score double").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    ids = rows.where("query").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")


def op4(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % EVERY == 0)


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM usable
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(sum((q.x - c.x) * (q.x - c.x) ORDER BY q.i)) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
