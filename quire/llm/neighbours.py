"""Nearest neighbours by a block matrix join: int8 product tiles, error bounds, exact recomputation, heaps.

Queries are dealt into blocks and candidates into groups of bounded size; every
(block, group) pair is one task's work: tiles of int8 code products (multiplied as
float32, where such sums are whole numbers and so exact) with a bound on their quantisation
error. Only pairs whose upper bound reaches the k-th best lower bound are
recomputed in double precision from the original vectors; a heap for each query
merges tiles, and a window merges groups. Nothing within the bounds is lost, so
the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries and candidates of one task's block and group, and of a tile in it.
QUERY_BLOCK, GROUP, TILE = 8192, 16384, 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and scale of each row: x is about code * scale, off by at most scale / 2 in each component. The scale is no smaller than a normal number."""
    scale = np.maximum(np.abs(x).max(1) / 127.0, np.finfo(float).tiny)
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added component by component."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows that may count: of equal vectors only the ``most`` smallest ids can be among the nearest, rows of the query's own id, whichever that is, not counted."""
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    w, i = which[order].astype(np.int64), ids[order]
    start = np.r_[0, np.flatnonzero(w[1:] != w[:-1]) + 1]
    rank = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
    # rows of one id, and the most rows that one smaller id has among the equal vectors
    first = np.r_[0, np.flatnonzero((w[1:] != w[:-1]) | (i[1:] != i[:-1])) + 1]
    size, of = np.diff(np.r_[first, len(w)]), w[first] * (len(w) + 1)
    upto = np.maximum.accumulate(of + size)
    before = np.maximum(np.r_[0, upto[:-1]] - of, 0)
    return np.sort(order[rank - np.repeat(before, size) < most])


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, score) of the k nearest candidates of each query, its own id aside."""
    keep = first_copies(ids, x, k)
    ids, x = ids[keep], x[keep]
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    tc, ts = quantised(x)
    out = []
    for begin in range(0, len(q_ids), TILE):
        some = slice(begin, begin + TILE)
        for i, heap in zip(q_ids[some].tolist(), _tiles(q_ids[some], q[some], ids, x, tc, ts, k)):
            out += [(i, -v, s) for s, v in heap]
    return out


def _tiles(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, tc: np.ndarray, ts: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """A heap of (score, -id) for each query of a tile row. Bounds that overflow bound nothing; a score that is no number (infinities of both signs) takes no part."""
    qc, qs = quantised(q)
    kind = np.float32 if q.shape[1] <= 1000 else np.float64  # sums up to 127 * 127 * 1000 are exact in float32
    qc, q1 = qc.astype(kind), np.abs(q).sum(1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for at in range(0, len(ids), TILE):
        tid, codes, scale = ids[at : at + TILE], tc[at : at + TILE].astype(kind), ts[at : at + TILE]
        with np.errstate(over="ignore", invalid="ignore"):
            near = (qc @ codes.T).astype(np.float64) * (qs[:, None] * scale)
            slack = (0.5 * scale * q1[:, None] + 0.5 * qs[:, None] * (scale * np.abs(codes).sum(1))) * (1 + 1e-9) + 1e-300
            low = np.where(tid == q_ids[:, None], -np.inf, np.nan_to_num(near - slack, nan=-np.inf, posinf=np.finfo(float).max, neginf=-np.inf))
            if len(tid) > k:
                floor = np.maximum(floor, np.partition(low, len(tid) - k, axis=1)[:, len(tid) - k])
            high = near + slack
            qi, ti = np.nonzero((np.isnan(high) | (high >= floor[:, None])) & (tid != q_ids[:, None]))
        for part in range(0, len(qi), 1 << 17):
            a, b = qi[part : part + (1 << 17)], ti[part : part + (1 << 17)]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = exact(q[a], x[at + b])
            for i, v, s in zip(a.tolist(), tid[b].tolist(), scores.tolist()):
                if s != s:
                    continue
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by ``every`` its k nearest others by inner product.

    Ties go to the smaller id; fewer candidates give fewer rows. Null and zero vectors and those
    with null or non-finite components take no part; vectors of different lengths do not meet; a product that overflows is
    infinite and ranks so, one that is no number (infinities of both signs) is left out. Of a repeated key each row counts as a candidate; rows
    of a repeated query key ask together (their k nearest pairs), and rows of the query's own key are no candidates. An empty table gives an empty one; other columns are left out.
    """
    e = F.col(vector)
    good = e.isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(e, lambda c: c != 0)
    v = vectors.select(F.col(key).cast("long").alias("id"), e.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v"))
    is_query = F.col("id") % every == 0
    n, nq = v.agg(F.count("*"), F.count_if(is_query)).first()
    groups, blocks = -(-n // GROUP) or 1, -(-nq // QUERY_BLOCK) or 1
    cand = v.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = v.where(is_query).withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            rows = block_top(right.column("id").to_numpy(), _matrix(right.column("v")), left.column("id").to_numpy(), _matrix(left.column("v")), k)
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    pairs = cand.groupBy("g", "qb", "dim").cogroup(asked.groupBy("g", "qb", "dim")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
