"""Exact dense top-k over vectors that are kept as bytes: bounds from the codes, then the few vectors that can matter.

``vectors.quantise`` stores a vector as one byte a component, a quarter of float32. The stored vector is off by half a step a component at most, so its direction by an angle of
asin(sqrt(dim) / 2 / |codes|) at most, whatever its scale. A query's cosine with the codes thus has a lower and an upper bound for the vector itself. The k-th largest lower bound is a score that k
points reach; of the points whose upper bound reaches it, and of no others, the vectors are fetched by id and compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .cells import SLACK
from .index import top_n

#: Points of a chunk, about, and queries of a tile.
CHUNK_POINTS, TILE_QUERIES = 65_536, 1024


def bounds(query: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest cosine of each query (rows) with the vectors that the codes (rows) stand for; a zero vector has cosine 0 with all."""
    q, c = query.astype(np.float64), codes.astype(np.float64)
    own, size = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    both = own[:, None] * size[None, :]
    near = np.divide(q @ c.T, both, out=np.zeros_like(both), where=both > 0)
    off = np.arcsin(np.minimum(1.0, np.divide(np.sqrt(c.shape[1]) * 0.5 + 1e-6, size, out=np.ones_like(size), where=size > 0)))
    angle = np.arccos(np.clip(near, -1, 1))
    low, high = np.cos(np.minimum(np.pi, angle + off)) - 1e-9, np.cos(np.maximum(0.0, angle - off)) + 1e-9
    return np.where(both > 0, low, 0.0), np.where(both > 0, high, 0.0)


def _possible(k: int, filtered: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(row, doc_id, low, high) of a tile: what can be among the k nearest of its points."""

    def matrix(column: pa.ChunkedArray, at: np.ndarray, dim: int) -> np.ndarray:
        return column.take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def run(asked: pa.Table, points: pa.Table) -> pa.Table:
        rows, places, lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        dims, laws = points.column("dim").to_numpy(), np.array(points.column("law").to_pylist(), object)
        groups: dict[tuple[int, str | None], list[int]] = {}
        for i, (dim, law) in enumerate(zip(asked.column("dim").to_pylist(), asked.column("law").to_pylist())):
            groups.setdefault((dim, law if filtered else None), []).append(i)
        for (dim, law), own in groups.items():
            at = np.flatnonzero((dims == dim) & ((laws == law) if law is not None else True))
            if not len(at):
                continue
            codes = matrix(points.column("codes"), at, dim)
            for a in range(0, len(own), 64):
                some = np.array(own[a : a + 64])
                for i, low, high in zip(some.tolist(), *bounds(matrix(asked.column("vector"), some, dim), codes)):
                    least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -2.0
                    kept = np.flatnonzero(high >= least - SLACK)
                    rows.append(np.full(len(kept), i))
                    places.append(at[kept])
                    lows.append(low[kept])
                    highs.append(high[kept])
        own = pa.array(np.concatenate(rows).astype(np.int64))
        found = points.column("doc_id").take(pa.array(np.concatenate(places).astype(np.int64)))
        return pa.table([asked.column("row").take(own), found, pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs))], names=["row", "doc_id", "low", "high"])

    return run


def search(queries: DataFrame, stored: DataFrame, points: DataFrame, k: int, *, filtered: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank) as ``cells.search`` gives them. stored: doc_id, quantised, law; points: doc_id, vector, read for those that can matter only.

    Points without an id are no hits; ids are those of one point each.
    """
    spark = stored.sparkSession
    id_kind = stored.schema["doc_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.col("law").cast("string").alias("law")).filter(F.size("vector") > 0)
    asked = written(asked.withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id()), "asked")
    coded = stored.select("doc_id", F.col("quantised.codes").alias("codes"), F.col("law").cast("string").alias("law")).filter(F.col("doc_id").isNotNull() & (F.size("codes") > 0))
    coded = coded.withColumn("dim", F.size("codes"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = coded.count()
    tiles, chunks = max(1, -(-asked.count() // TILE_QUERIES)), max(1, -(-count // CHUNK_POINTS), min(width, count // 1024))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("a", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")).withColumn("b", every(chunks))
    right = coded.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).withColumn("a", every(tiles))
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
    possible = written(met.applyInArrow(_possible(k, filtered), f"row long, doc_id {id_kind}, low double, high double"), "possible")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("low").desc()))
    kth = possible.select("row", "low").withColumn("place", place).filter(F.col("place") == k).select("row", F.col("low").alias("least"))
    few = possible.join(kth, "row", "left").filter(F.col("least").isNull() | (F.col("high") >= F.col("least") - SLACK)).select("row", "doc_id")
    few = written(few, "possible-few")
    wanted = points.select("doc_id", F.col("vector").cast("array<double>").alias("x")).join(few.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    both = few.join(wanted, "doc_id").join(asked.select("row", "query_id", "vector"), "row")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("vector", "vector")) * F.sqrt(dot("x", "x"))
    score = F.when(size > 0, dot("vector", "x") / size).otherwise(F.lit(0.0))
    return top_n(both.select("query_id", "doc_id", F.round(score, 4).alias("score")), k)
