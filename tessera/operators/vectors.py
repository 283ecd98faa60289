"""Dense retrieval over a vector table, and incremental embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, point_id
from . import cells, coded


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, first component to last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector of length 1 (a zero vector stays)."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def dense_top(queries: DataFrame, points: DataFrame, k: int, *, filtered: bool = True, blocks: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank). queries: query_id, vector, law; points: doc_id, vector, law; blocks: of the points (``cells.built``), if they are there already.

    filtered: a query with a law meets only the points of that law, one without all of them.
    """
    return cells.search(queries, cells.built(points) if blocks is None else blocks, k, filtered=filtered)


def with_few(queries: DataFrame, hits: DataFrame, below: int) -> DataFrame:
    """Queries with fewer than ``below`` hits (none included)."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    return queries.join(counts, "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < below).drop("_n")


def fallback(filtered: DataFrame, unfiltered: DataFrame, below: int) -> DataFrame:
    """For queries with fewer than ``below`` filtered hits, the unfiltered ones that are not there yet are added."""
    few = with_few(unfiltered.select("query_id").distinct(), filtered, below)
    more = unfiltered.join(few, "query_id", "left_semi").join(filtered.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return filtered.select("query_id", "doc_id", "score").unionByName(more.select("query_id", "doc_id", "score"))


def rewrite_union(hits: DataFrame, more: DataFrame, k: int, below: int = 3) -> DataFrame:
    """Hits of the rewritten question after those of the question itself, where these are fewer than ``below``; each once, the first k.

    hits, more: query_id, doc_id, score, rank; more holds only queries that were rewritten.
    """
    few = with_few(more.select("query_id").distinct(), hits, below)
    extra = more.join(few, "query_id", "left_semi").join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    columns = ["query_id", "doc_id", "score", "rank"]
    both = hits.select(*columns, F.lit(0).alias("_part")).unionByName(extra.select(*columns, F.lit(1).alias("_part")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_part", "rank", "doc_id"))
    return both.withColumn("rank", rank).filter((F.col("_part") == 0) | (F.col("rank") <= k)).drop("_part")


def not_embedded(chunks: DataFrame, stored: DataFrame, *, by_content: bool = True) -> DataFrame:
    """Chunks to embed. by_content: unless (chunk_id, content hash) is stored; else unless the id is."""
    chunks = chunks.withColumn("point_id", point_id(F.col("chunk_id")))
    if not by_content:
        return chunks.join(stored.select("point_id"), "point_id", "left_anti")
    chunks = chunks.withColumn("content_hash", content_hash(F.col("text")))
    return chunks.join(stored.select("point_id", "content_hash"), ["point_id", "content_hash"], "left_anti")


def quantised(a: Column) -> Column:
    """Unit vector as bytes."""
    return F.transform(a, lambda x: F.round(x * 127).cast("tinyint"))


def quantise(a: Column) -> Column:
    """struct(codes, scale): the largest component is 127 (or -127), so a vector is about scale times its codes."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(F.transform(a, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("codes"), scale.alias("scale"))


def restored(q: Column) -> Column:
    """The vector that a quantised one stands for."""
    return F.transform(q["codes"], lambda x: x.cast("double") * q["scale"])


def quantised_top(queries: DataFrame, points: DataFrame, k: int, *, filtered: bool = True, whole: DataFrame | None = None) -> DataFrame:
    """dense_top over points stored as quantised vectors (doc_id, quantised, law): a quarter of float32's bytes.

    whole: doc_id, vector; with it the rows are those of dense_top, by bounds from the codes and the vectors of what can matter (``coded``). Without, scores differ by the rounding of the codes.
    """
    if whole is not None:
        return coded.search(queries, points, whole, k, filtered=filtered)
    return dense_top(queries, points.select("doc_id", restored(F.col("quantised")).alias("vector"), "law"), k, filtered=filtered)
