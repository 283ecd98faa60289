"""Exact dense top-k over points that are clustered once into cells (an inverted file with angle bounds).

Every point goes to the nearest of a few sampled directions of its law; the points of a cell, ordered by their angle to it, are cut into blocks, so a block is a ring between two
angles around a direction, and a cell that holds most points is many blocks in many tasks. A query at angle a from the direction can have no larger cosine with a
point of the ring than cos(max(0, a - outer, inner - a)).

A search has two steps (one where there are only a few blocks). First every query visits the best blocks by bound, as many as hold k points; its k-th score there is its threshold. Then it
visits each block whose bound reaches the threshold. Queries are a stated set: they meet the blocks' heads (directions and angles, no points) in tiles, and a block is read by one task with the
queries that visit it. Nothing is collected but a bounded sample of directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .index import top_n

#: Directions at most; points for which there is one, and points of a block; heads and queries of a tile.
MOST_CELLS, CELL_POINTS, BLOCK_POINTS, TILE_HEADS, TILE_QUERIES = 1024, 512, 512, 4096, 4096
#: With so few blocks, to find thresholds takes longer than to visit all of them.
FEW_BLOCKS = 64
#: Scores are rounded to four places; what is lower by more than this cannot round to the same.
SLACK = 2e-4
_HEAD = ["block", "dim", "law", "n", "direction", "inner", "outer"]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((x * x).sum(axis=1))
    return np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0), size


def _assign(directions: dict[tuple[int, str | None], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, vector, law, dim -> also cell (its direction's number, -1 for a zero vector) and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, laws = batch.column(3).to_numpy(), batch.column(2).to_pylist()
            cell, angle = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            groups: dict[tuple[int, str | None], list[int]] = {}
            for i, key in enumerate(zip(dims.tolist(), laws)):
                groups.setdefault(key, []).append(i)
            for (dim, law), rows in groups.items():
                unit, size = _units(_matrix(batch.column(1).take(pa.array(rows)), dim))
                near = unit @ directions.get((dim, law), directions[dim, None]).T
                at, some = np.array(rows), size > 0
                cell[at[some]] = near.argmax(axis=1)[some]
                angle[at[some]] = np.arccos(np.clip(near.max(axis=1), -1, 1))[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["doc_id", "vector", "law", "dim", "cell", "angle"])

    return run


def _blocks(directions: dict[tuple[int, str | None], np.ndarray], size: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rings of at most ``size`` points out of rows that are sorted by dim, law, cell and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None

        def ring(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            law, dim, cell = (t.column(c)[0].as_py() for c in ("law", "dim", "cell"))
            angle = t.column("angle").to_numpy()
            direction = directions.get((dim, law), directions[dim, None])[cell] if cell >= 0 else np.zeros(dim)
            ids = t.column("doc_id").combine_chunks().cast(id_type)
            vectors = _matrix(t.column("vector"), dim)
            # angles are known to about 1e-8 near zero; the bounds are opened by more
            inner, outer = (max(0.0, float(angle[0]) - 1e-6), float(angle[-1]) + 1e-6) if cell >= 0 else (0.0, -1.0)
            row = [[number], [dim], [law], [len(ids)], [direction.tolist()], [inner], [outer], pa.ListArray.from_arrays([0, len(ids)], ids), [vectors.tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), None, pa.binary()]
            return pa.RecordBatch.from_arrays([x if k is None else pa.array(x, k) for x, k in zip(row, kinds)], names=[*_HEAD, "ids", "vectors"])

        def key(t: pa.Table, i: int) -> tuple:
            return tuple(t.column(c)[i].as_py() for c in ("dim", "law", "cell"))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            laws = held.column("law").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            dims, cells = held.column("dim").to_numpy(), held.column("cell").to_numpy()
            change = np.flatnonzero((dims[1:] != dims[:-1]) | (laws[1:] != laws[:-1]) | (cells[1:] != cells[:-1])) + 1
            edges = [0, *change.tolist(), len(dims)]
            for a, b in zip(edges[:-1], edges[1:]):
                last = b == len(dims)
                while b - a >= size or (b > a and not last):
                    yield ring(held.slice(a, min(size, b - a)))
                    a += min(size, b - a)
            held = held.slice(a)
        if held is not None and held.num_rows:
            yield ring(held)

    return run


def built(points: DataFrame) -> DataFrame:
    """Blocks (block, dim, law, n, direction, inner, outer, ids, vectors) of points (doc_id, vector, law), written once."""
    spark = points.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = points.select("doc_id", F.col("vector").cast("array<double>").alias("vector"), F.col("law").cast("string").alias("law")).filter(F.size("vector") > 0)
    own = own.withColumn("dim", F.size("vector"))
    kinds = own.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("law").alias("laws")).collect()  # a row for each length of vectors
    directions: dict[tuple[int, str | None], np.ndarray] = {}
    for r in kinds:
        most = min(MOST_CELLS, max(1, r["n"] // (CELL_POINTS * max(1, r["laws"]))))
        sample = own.filter((F.col("dim") == r["dim"]) & F.exists("vector", lambda x: x != 0))
        rows = sample.select("vector").orderBy(F.xxhash64("doc_id"), F.xxhash64("vector")).limit(most).collect()  # MOST_CELLS at most
        x = np.array([v["vector"] for v in rows], np.float64).reshape(-1, r["dim"])
        directions[r["dim"], None] = _units(x)[0] if len(x) else np.eye(1, r["dim"])
    id_kind = points.schema["doc_id"].dataType.simpleString()
    cells = own.mapInArrow(_assign(directions), f"doc_id {id_kind}, vector array<double>, law string, dim int, cell int, angle double")
    cells = written(cells, "cells")  # read twice: by the ranges' sample and by the sort
    order = ["dim", "law", "cell", "angle", "doc_id"]
    rings = cells.repartitionByRange(width, *order).sortWithinPartitions(*order)
    schema = f"block long, dim int, law string, n int, direction array<double>, inner double, outer double, ids array<{id_kind}>, vectors binary"
    from pyspark.sql.pandas.types import to_arrow_type

    return written(rings.mapInArrow(_blocks(directions, BLOCK_POINTS, to_arrow_type(points.schema["doc_id"].dataType)), schema), "rings")


def _bounds(unit: np.ndarray, direction: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip(unit @ direction.T, -1, 1))
    bound = np.cos(np.maximum(0.0, np.maximum(angle - outer[None, :], inner[None, :] - angle)))
    return np.where(outer[None, :] < 0, 0.0, bound)


def _visits(k: int, filtered: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query_id, block, bound, n) of a tile: of a query without a threshold the best blocks that hold k points, of others all that reach it."""

    def run(asked: pa.Table, heads: pa.Table) -> pa.Table:
        rows, blocks, bounds, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int32)]
        dims, laws = heads.column("dim").to_numpy(), np.array(heads.column("law").to_pylist(), object)
        block, n = heads.column("block").to_numpy(), heads.column("n").to_numpy()
        inner, outer = heads.column("inner").to_numpy(), heads.column("outer").to_numpy()
        asked_dims, asked_laws = asked.column("dim").to_numpy(), asked.column("law").to_pylist()
        least = asked.column("least").to_numpy()
        groups: dict[tuple[int, str | None], list[int]] = {}
        for i, (dim, law) in enumerate(zip(asked_dims.tolist(), asked_laws)):
            groups.setdefault((dim, law if filtered else None), []).append(i)
        for (dim, law), own in groups.items():
            at = np.flatnonzero((dims == dim) & ((laws == law) if law is not None else True))
            if not len(at):
                continue
            unit, size = _units(_matrix(asked.column("vector").take(pa.array(own)), dim))
            direction = _matrix(heads.column("direction").take(pa.array(at)), dim)
            bound = np.where(size[:, None] > 0, _bounds(unit, direction, inner[at], outer[at]), 0.0)
            for i, b in zip(own, bound):
                if np.isnan(least[i]):
                    order = np.argsort(-b, kind="stable")
                    near = order[: int(np.searchsorted(np.cumsum(n[at][order]), k)) + 1]
                else:
                    near = np.flatnonzero(b >= least[i] - SLACK)
                rows.append(np.full(len(near), i))
                blocks.append(block[at][near])
                bounds.append(b[near])
                counts.append(n[at][near])
        own = pa.array(np.concatenate(rows).astype(np.int64))
        columns = [asked.column("query_id").take(own), *(pa.array(np.concatenate(x)) for x in (blocks, bounds, counts))]
        return pa.table(columns, names=["query_id", "block", "bound", "n"])

    return run


def _scores(k: int, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query_id, doc_id, score) of a block: of each query that visits it the k nearest points that reach its threshold."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        ids = blocks.column("ids").combine_chunks().flatten() if blocks.num_rows else pa.array([], id_type)
        if blocks.num_rows and asked.num_rows:
            dim = blocks.column("dim")[0].as_py()
            x = np.frombuffer(blocks.column("vectors")[0].as_buffer(), np.float64).reshape(-1, dim)
            q = _matrix(asked.column("vector"), dim)
            size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
            near = np.round(np.divide(q @ x.T, size, out=np.zeros_like(size), where=size > 0), 4)
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            least = np.nan_to_num(asked.column("least").to_numpy(), nan=-2.0)
            for i, row in enumerate(near):
                at = np.flatnonzero(row >= least[i] - SLACK)
                if len(at) > k:
                    at = at[np.lexsort((rank[at], -row[at]))[:k]]
                rows.append(np.full(len(at), i))
                docs.append(at)
                scores.append(row[at])
        own = pa.array(np.concatenate(rows).astype(np.int64))
        found = ids.take(pa.array(np.concatenate(docs).astype(np.int64)))
        return pa.table([asked.column("query_id").take(own), found, pa.array(np.concatenate(scores))], names=["query_id", "doc_id", "score"])

    return run


def search(queries: DataFrame, blocks: DataFrame, k: int, *, filtered: bool = True, visited: Accumulator | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k points with the largest cosine to each query (query_id, vector, law), rounded to four places, ties to the smaller id.

    blocks: of ``built`` (written; read more than once). filtered: a query with a law meets only the points of that law, one without all of them. Vectors of other lengths than a query's do not
    meet it; zero vectors have cosine 0 with all; null vectors take no part. visited: gets the number of (query, block) pairs of the second step.
    """
    spark = blocks.sparkSession
    id_field = blocks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    query_kind, id_kind = queries.schema["query_id"].dataType.simpleString(), id_field.simpleString()
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.col("law").cast("string").alias("law")).filter(F.size("vector") > 0)
    asked = written(asked.withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id()), "asked")
    count = blocks.count()
    tiles = max(1, -(-asked.count() // TILE_QUERIES)), max(1, -(-count // TILE_HEADS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    heads = blocks.select(*_HEAD).withColumn("b", tile("block", tiles[1])).withColumn("a", every(tiles[0]))

    def visits(thresholds: DataFrame) -> DataFrame:
        left = thresholds.withColumn("a", tile("row", tiles[0])).withColumn("b", every(tiles[1])).withColumn("query_id", F.col("row"))
        met = left.groupBy("a", "b").cogroup(heads.groupBy("a", "b"))
        return met.applyInArrow(_visits(k, filtered), "query_id long, block long, bound double, n int").withColumnRenamed("query_id", "row")

    def scored(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
        """Points of the visited blocks; a block meets its queries a tile at a time."""
        right = blocks.select("block", "dim", "ids", "vectors").withColumn("a", every(tiles[0]))
        left = pairs.select("row", "block").join(thresholds.select(F.col("row"), "vector", "least"), "row").withColumn("a", tile("row", tiles[0])).withColumnRenamed("row", "query_id")
        used = left.select("block", "a").distinct()
        met = left.groupBy("block", "a").cogroup(right.join(used, ["block", "a"], "left_semi").groupBy("block", "a"))
        return met.applyInArrow(_scores(k, to_arrow_type(id_field)), f"query_id long, doc_id {id_kind}, score double").withColumnRenamed("query_id", "row")

    if count <= FEW_BLOCKS:
        limits = asked.withColumn("least", F.lit(-2.0))
    else:
        open_ = asked.withColumn("least", F.lit(float("nan")))
        first = visits(open_)
        before = Window.partitionBy("row").orderBy(F.col("bound").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < k)
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc()))
        kth = scored(first, open_).withColumn("place", place).filter(F.col("place") == k).select("row", F.col("score").alias("least"))
        limits = written(asked.join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), "limits")
    pairs = written(visits(limits), "visits")
    if visited is not None:
        visited.add(pairs.count())
    found = scored(pairs, limits).join(asked.select("row", "query_id"), "row")
    return top_n(found.select(F.col("query_id").cast(query_kind).alias("query_id"), "doc_id", "score"), k)
