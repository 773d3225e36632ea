"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks of candidates and blocks of queries; each pair of blocks is a tile. A tile holds its vectors as
8-bit integers with one scale each, so one matrix product gives all approximate inner products, and the rounding bounds how far
each can be off. A query keeps the candidates whose upper bound reaches its k-th largest lower bound; these are recomputed in
double precision on the original vectors, so the result is exact. The best k of each tile are merged through bounded heaps.

Of identical vectors in a tile only the k + 1 smallest ids are searched, the most that a result could hold.

Defined cases: vectors that are null, zero, or hold a null or a component that is not finite take no part; vectors of other
lengths than the query's are no candidates; a query never finds its own row, but repeated rows of one id are candidates of other
queries once each; a null id takes no part; fewer than k candidates give as many rows; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, ship, table

#: Rows of a block of candidates and of a block of queries, about.
CANDIDATES, QUERIES = 8192, 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers from -127 to 127, the scale of each row, and the length of each row's rounding error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query in one tile: query ids, candidate ids, scores."""
    order = np.lexsort((c_ids, *c.T[::-1]))
    c_ids, c = c_ids[order], c[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    few = np.arange(len(c)) - first <= k
    c_ids, c = c_ids[few], c[few]
    qq, qs, qe = quantise(q)
    cq, cs, ce = quantise(c)
    q_len, c_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), 256):
        rows = slice(at, min(at + 256, len(q)))
        # Products of 8-bit integers add up exactly in single precision below 2 ** 24.
        kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        about = (qq[rows].astype(kind) @ cq.astype(kind).T) * qs[rows, None] * cs
        # |x.y - x'.y'| <= |x| |y - y'| + |x - x'| |y'|, and |y'| <= |y| + |y - y'|; a little more for rounding here.
        slack = (q_len[rows, None] * ce + qe[rows, None] * (c_len + ce)) * 1.000001 + 1e-6 * q_len[rows, None] * c_len
        low = about - slack
        own = q_ids[rows, None] == c_ids
        low[own] = -np.inf
        cut = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        a, b = np.nonzero((about + slack >= cut[:, None]) & ~own)
        score = np.concatenate([dots(q[rows][a[i : i + 200_000]], c[b[i : i + 200_000]]) for i in range(0, len(a), 200_000)] or [np.zeros(0)])
        best = np.lexsort((c_ids[b], -score, a))
        a, b, score = a[best], b[best], score[best]
        begin = np.searchsorted(a, np.arange(len(low)))
        top = np.arange(len(a)) - begin[a] < k
        out.append((q_ids[rows][a[top]], c_ids[b[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, per_query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each row that ``queries`` (a column over
    the id) selects; nearest first, ties to the smaller id."""
    ship(vectors.sparkSession)
    v = F.col("v")
    sound = F.size(v) > 0, ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    for test in sound:
        rows = rows.where(test)
    rows = rows.withColumn("dim", F.size(v)).withColumn("asks", F.coalesce(queries(F.col("id")), F.lit(False)))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-asked // per_query_block))
    block = lambda of, count: F.pmod(F.xxhash64(F.lit(of), "id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = rows.select("id", "v", "dim", block("c", c_blocks).alias("cb")).withColumn("qb", every(q_blocks))
    left = rows.where("asks").select("id", "v", "dim", block("q", q_blocks).alias("qb")).withColumn("cb", every(c_blocks))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        flat = t.column("v").combine_chunks()
        flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
        # Rows of one id and one vector count once.
        x = flat.reshape(len(ids), -1)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        return ids[new], x[new]

    def run(asking: pa.Table, found: pa.Table) -> pa.Table:
        if not len(asking) or not len(found):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, c_ids, score = tile(*matrix(asking), *matrix(found), k)
        return pa.table({"query_id": q_ids, "vec_id": c_ids, "score": score})

    keys = ["dim", "cb", "qb"]
    tops = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, c, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0]:
                    heapq.heapreplace(heap, (s, -c))
        for q, heap in heaps.items():
            heap.sort(reverse=True)
            m = len(heap)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([q] * m, pa.int64()), "rank": pa.array(range(1, m + 1), pa.int32()), "vec_id": pa.array([-c for _, c in heap], pa.int64()), "score": pa.array([s for s, _ in heap], pa.float64())})

    return durable(tops).repartition("query_id").mapInArrow(lean(merge), "query_id long, rank int, vec_id long, score double")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, x: a + x) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
