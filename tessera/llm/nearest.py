"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Vectors are stored in blocks (one row holds a few thousand vectors as matrices). A vector v is kept as scale * codes + e
with int8 codes; for a query q and a vector v the product of the codes is off by at most |e_q| |v| + |q'| |e_v| (q' the decoded query).
Per tile of a query block and a candidate block, one matrix product of codes gives all lower and upper bounds; only pairs
whose upper bound reaches the k-th best so far are computed again in double precision on the original vectors, and go to
the queries' heaps of k. The bound is proven, so the result is exact (recall 1).

A tile group meets one query block with a bounded number of candidate blocks; what it gives are k rows a query, which a window of rank k brings together.
Of equal vectors, only those of the k + 1 smallest ids can be in a result, and of one id's no more than k rows, so the rest of a group of copies
leaves before the tiles.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a null id takes no part; vectors of different length are not
compared; ties go to the smaller id; with fewer than k candidates all are returned; repeated ids are candidates each,
and a query never meets a row with its own id; equal query rows are one query, and a query id with several vectors has the best k of all of them together; empty tables give an empty result;
further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Code bytes of a candidate block, about, and vectors of a query block.
BLOCK_BYTES = 1 << 18
QUERY_ROWS = 1024
#: Candidate blocks that a tile group holds at most.
GROUP_BLOCKS = 16
_BLOCK = "dim int, n int, ids binary, codes binary, scale binary, error binary, norm binary, vectors binary"


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, scale, norm of the error, norm of each row."""
    top = np.abs(x).max(axis=1)
    scale = np.maximum(top / 127.0, np.finfo(np.float64).tiny)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error, np.sqrt((x * x).sum(axis=1))


def _blocks(rows: DataFrame, by_bytes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}

        def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            codes, scale, error, norm = quantise(x)
            data = [[dim], [len(ids)], [ids.tobytes()], [codes.tobytes()], [scale.tobytes()], [error.tobytes()], [norm.tobytes()], [x.tobytes()]]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(data, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        def full(dim: int) -> int:
            return max(64, BLOCK_BYTES // dim) if by_bytes else QUERY_ROWS

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            first = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows_ = np.flatnonzero(sizes == dim)
                x = flat[first[rows_][:, None] + np.arange(dim)].astype(np.float64)
                own_ids, own_x, n = held.get(dim, ([], [], 0))
                own_ids, own_x, n = [*own_ids, ids[rows_]], [*own_x, x], n + len(rows_)
                if n >= full(dim):
                    all_ids, all_x = np.concatenate(own_ids), np.concatenate(own_x)
                    step = full(dim)
                    whole = n - n % step
                    for a in range(0, whole, step):
                        yield block(dim, all_ids[a : a + step], all_x[a : a + step])
                    own_ids, own_x, n = [all_ids[whole:]], [all_x[whole:]], n - whole
                held[dim] = (own_ids, own_x, n)
        for dim, (own_ids, own_x, n) in held.items():
            if n:
                yield block(dim, np.concatenate(own_ids), np.concatenate(own_x))

    return rows.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())


class _Block:
    def __init__(self, row: dict) -> None:
        n, d = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        # integers below 2**24 are exact in float32; longer vectors are multiplied in float64
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, d).astype(np.float32 if d <= 1024 else np.float64)
        self.scale, self.error, self.norm = (np.frombuffer(row[c], np.float64) for c in ("scale", "error", "norm"))
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(n, d)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _tile(q: _Block, c: _Block, heaps: list[list[tuple[float, int]]], k: int) -> None:
    """Let the pairs of two blocks into the heaps of the queries."""
    middle = (q.codes @ c.codes.T) * (q.scale[:, None] * c.scale[None, :])
    decoded = q.norm + q.error  # at least the decoded query's norm
    off = q.error[:, None] * c.norm[None, :] + decoded[:, None] * c.error[None, :] + 1e-12 * q.norm[:, None] * c.norm[None, :]
    low = middle - off
    low[q.ids[:, None] == c.ids[None, :]] = -np.inf
    least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    if low.shape[1] >= k:
        least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    live = middle + off >= least[:, None]
    live &= q.ids[:, None] != c.ids[None, :]
    at_q, at_c = np.nonzero(live)
    for a in range(0, len(at_q), 1 << 16):
        qs, cs = at_q[a : a + (1 << 16)], at_c[a : a + (1 << 16)]
        scores = _exact(q.x[qs], c.x[cs])
        for i, s, v in zip(qs.tolist(), scores.tolist(), c.ids[cs].tolist()):
            heap = heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))


def nearest(queries: DataFrame, candidates: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, its own id left out."""
    spark = candidates.sparkSession
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    pool = _usable(candidates, id_col, vector_col).groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("rows"))
    pool = pool.withColumn("copy", rank).filter(F.col("copy") <= k + 1)
    pool = pool.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("id", "v")
    left = materialise(_blocks(_usable(queries, id_col, vector_col).distinct(), by_bytes=False), "nearest-queries")
    right = materialise(_blocks(pool, by_bytes=True), "nearest-candidates")
    n_left, n_right = left.count(), right.count()
    wanted = 4 * max(spark.sparkContext.defaultParallelism, 1)
    per_group = max(1, min(GROUP_BLOCKS, n_left * n_right // wanted))
    groups = max(1, -(-n_right // per_group))
    # each block meets each block of the other side once: queries go to all groups, a group's candidates to all query blocks
    left = left.withColumn("tile_q", F.pmod(F.xxhash64("block"), F.lit(max(n_left, 1))).cast("int"))
    left = left.withColumn("tile_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = right.withColumn("tile_g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    right = right.withColumn("tile_q", F.explode(F.sequence(F.lit(0), F.lit(max(n_left, 1) - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        for row in a.to_dict("records"):
            q = _Block(row)
            heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
            for other in b[b["dim"] == row["dim"]].sort_values("block").to_dict("records"):
                _tile(q, _Block(other), heaps, k)
            for i, heap in zip(q.ids.tolist(), heaps):
                out[0].extend([i] * len(heap))
                out[1].extend(-v for _, v in heap)
                out[2].extend(s for s, _ in heap)
        return pd.DataFrame({"query_id": out[0], "vec_id": out[1], "score": out[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["tile_q", "tile_g"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
