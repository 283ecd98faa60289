"""k-means by balls, exact in integers.

Vectors become whole numbers (``floor(scale * x)``) and are kept in blocks, one row for a few thousand vectors. The first assignment compares with all
centroids. In every later round a cluster is a ball: its centroid and a radius that no member exceeds, namely the last assignment's largest distance and
the length of the centroid's move. Neighbour centroids are those within twice the radius. A member nearer to its own centroid than half the way to the
nearest neighbour is in the stable core and stays; the others lie in annuli between the half ways to the first, second, ... neighbour, and a member is
compared with so many neighbours only. What a bound leaves open, a tie too, is compared, so the result is that of comparing with all.

What leaves the tasks are k rows of sums each (count, componentwise sum, largest distance), added up by Spark; the driver holds k centroids and their distances.

Defined results: vectors that are null, of another length than ``dim``, or hold null or non-finite components take no part; a null id can not begin a centroid while others can; rows with
equal ids and equal vectors are vectors each (as first centroids too: equal centroids leave all to the smaller number, the others stay empty and where they are); equal ids
with different vectors are ordered by these; distance ties go to the smaller number; with fewer than k vectors there are so many clusters; an empty table gives
an empty result; a component of 2^26 or more after scaling is an error, because its squared distances would not fit; further columns are not returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release

#: Vectors of a block, and the first absolute value that a component may not have.
BLOCK_ROWS, LIMIT = 4096, 1 << 26
_STATE = "n int, ids binary, nulls binary, vectors binary, own binary, away binary"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_SUMS = "cluster int, n long, sums array<long>, widest long"


def _blocks(dim: int):
    """Blocks of vectors; own and away (cluster and squared distance) still empty."""

    def block(ids: np.ndarray, nulls: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        data = [len(ids), ids.tobytes(), nulls.tobytes(), x.tobytes(), b"", b""]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(data)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), nulls, x.astype(np.int32)))
            count += batch.num_rows
            while count >= BLOCK_ROWS:
                whole = [np.concatenate(c) for c in zip(*held)]
                yield block(*[c[:BLOCK_ROWS] for c in whole])
                held, count = [tuple(c[BLOCK_ROWS:] for c in whole)], count - BLOCK_ROWS
        if count:
            yield block(*[np.concatenate(c) for c in zip(*held)])

    return run


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """Centroids with what a task needs to know of their neighbourhoods."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None = None) -> None:
        self.centroids, self.first = centroids, radii is None
        gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        self.neighbours = []
        for i in range(len(centroids)):
            near = [j for j in range(len(centroids)) if j != i and (radii is None or gaps[i, j] <= 4 * radii[i] ** 2)]
            near = np.array(sorted(near, key=lambda j: (gaps[i, j], j)), np.int64)
            self.neighbours.append((near, gaps[i, near] if len(near) else np.zeros(0, np.int64)))

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of every row, and the number of distances that were computed; own: the clusters so far."""
        away = np.empty(len(x), np.int64)
        made = 0
        if self.first:
            own = np.zeros(len(x), np.int32)
            for j, c in enumerate(self.centroids):
                d = distances(x, c)
                better = d < away if j else np.ones(len(x), bool)
                own[better], away[better] = j, d[better]
            return own, away, len(x) * len(self.centroids)
        new = own.copy()
        for i, (near, gaps) in enumerate(self.neighbours):
            rows = np.flatnonzero(own == i)
            d = distances(x[rows], self.centroids[i])
            made += len(rows)
            best, where = d.copy(), np.full(len(rows), i, np.int32)
            # neighbours at least twice as far from the centroid as a member is can not be nearer to it
            annulus = np.searchsorted(gaps, 4 * d, "right")
            for t, j in enumerate(near.tolist()):
                at = np.flatnonzero(annulus > t)
                if not len(at):
                    break
                other = distances(x[rows[at]], self.centroids[j])
                made += len(at)
                better = (other < best[at]) | ((other == best[at]) & (j < where[at]))
                best[at[better]], where[at[better]] = other[better], j
            away[rows], new[rows] = best, where
        return new, away, made


def _vectors(batch: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    return np.frombuffer(batch.column(3)[i].as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)


def _assigned(balls: Balls, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _vectors(batch, i, dim)
                own, away, _ = balls.assign(x, np.frombuffer(batch.column(4)[i].as_buffer(), np.int32))
                kept = [batch.column(c).slice(i, 1) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([own.tobytes()], pa.binary()), pa.array([away.tobytes()], pa.binary())], names=_NAMES)

    return run


def _summed(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, widest = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums = np.zeros((k, dim), np.int64)  # a task has far fewer than 2^37 vectors
        for batch in batches:
            for i in range(batch.num_rows):
                x = _vectors(batch, i, dim)
                own, away = np.frombuffer(batch.column(4)[i].as_buffer(), np.int32), np.frombuffer(batch.column(5)[i].as_buffer(), np.int64)
                n += np.bincount(own, minlength=k)
                for j in np.unique(own).tolist():
                    rows = own == j
                    sums[j] += x[rows].sum(axis=0)
                    widest[j] = max(widest[j], away[rows].max())
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists, pa.array(widest[some])], names=["cluster", "n", "sums", "widest"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own, away = np.frombuffer(batch.column(4)[i].as_buffer(), np.int32), np.frombuffer(batch.column(5)[i].as_buffer(), np.int64)
            ids = pa.array(np.frombuffer(batch.column(1)[i].as_buffer(), np.int64), mask=np.frombuffer(batch.column(2)[i].as_buffer(), bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(away)], names=["id", "cluster", "distance"])


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: float) -> DataFrame:
    """(id, v): the usable vectors as whole numbers."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.size("v") == dim)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    floor = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    large = F.exists("v", lambda x: F.abs(x * F.lit(float(scale))) >= LIMIT)
    return rows.select("id", F.when(large, F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling")).cast("array<long>")).otherwise(floor).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in chosen], np.int64)


def moved(centroids: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Centroids of the sums' clusters (the others stay), and a radius of each ball around its new centroid."""
    parts = sums.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("widest").alias("widest"), *[F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(centroids.shape[1])]
    )
    new, radii = centroids.copy(), [0] * len(centroids)
    for r in parts.collect():  # k rows
        i = r["cluster"]
        new[i] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(centroids.shape[1])]
        shift = sum((int(a) - int(b)) ** 2 for a, b in zip(new[i], centroids[i]))
        radii[i] = math.isqrt(int(r["widest"])) + 1 + math.isqrt(shift) + 1
    return new, radii


def ball_kmeans(
    vectors: DataFrame, k: int, *, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every usable vector, final centroids as whole numbers). distance: squared, of whole numbers.

    The first centroids are the k vectors with the smallest sha256 of seed and id.
    """
    rows = whole_vectors(vectors, id_col, vector_col, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = materialise(rows.mapInArrow(_blocks(dim), _STATE), "balls-blocks")
    radii = None
    for r in range(rounds + 1):
        before, state = state, materialise(state.mapInArrow(_assigned(Balls(centroids, radii), dim), _STATE), "balls-state")
        release(before)
        if r < rounds:
            centroids, radii = moved(centroids, state.mapInArrow(_summed(len(centroids), dim), _SUMS))
    return state.mapInArrow(_rows, "id long, cluster int, distance long"), centroids


def described(assigned: DataFrame, centroids: np.ndarray, spark: SparkSession) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of distances) and centroid_sha256 (of the components joined by commas)."""
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    known = [(i, inertia.get(i, 0), sum(inertia.values()), name) for i, name in enumerate(names)]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
