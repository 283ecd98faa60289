"""Inverted index and BM25+ over many documents and many queries at once.

Postings are an ordinary table (doc_id, term, tf, dl). Queries meet them by an equi-join on the term, so a query costs
its postings and never a pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..config import Bm25Config
from ..functions.batches import pieces
from ..functions.cutting import cut, token_characters
from ..functions.text import search_tokens
from ..storage import exists, if_small, written

#: Rows of query terms that are sent to every task; more of them meet the postings by shuffle.
MAX_TERMS = 1_000_000
#: Terms that are looked up where the documents are cut into tokens; with more of them, tokens meet the terms by a join.
LOOKED_UP = 100_000


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, dl)"""
    return docs.select(F.col(id_col).alias("doc_id"), search_tokens(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, dl); terms: keep only these (a column term), before anything is counted or shuffled."""
    rows = tokens.select("doc_id", "dl", F.explode("tokens").alias("term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        rows = rows.join(if_small(wanted, MAX_TERMS)(wanted), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _counted(batch: pa.RecordBatch, terms: pa.Array) -> pa.RecordBatch:
    """(doc_id, dl, term, tf) of (doc_id, dl, tokens): a row without a term for each document, and one for each of the terms that it holds."""
    tokens, n = batch.column(2), batch.num_rows
    codes = pc.index_in(tokens.flatten(), value_set=terms).fill_null(-1).to_numpy()
    rows = np.repeat(np.arange(n, dtype=np.int64), tokens.value_lengths().fill_null(0).to_numpy())
    met, tf = np.unique(rows[codes >= 0] * len(terms) + codes[codes >= 0], return_counts=True)
    own = pa.array(np.append(np.arange(n), met // max(1, len(terms))), pa.int64())
    term = pa.concat_arrays([pa.nulls(n, pa.string()), terms.take(pa.array(met % max(1, len(terms)), pa.int64()))])
    columns = [batch.column(0).take(own), batch.column(1).take(own), term, pa.array(np.append(np.zeros(n, np.int64), tf), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "dl", "term", "tf"])


def wanted_postings(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings of the wanted terms, statistics of all documents), both written: documents are cut into tokens once, and only wanted ones leave the task."""
    spark, tokens = docs.sparkSession, tokenised(docs, id_col, text_col)
    terms = wanted.select("term").distinct()
    if terms.limit(LOOKED_UP + 1).count() > LOOKED_UP:
        return written(postings(tokens, wanted), "postings"), written(corpus_stats(tokens), "statistics")
    shared = spark.sparkContext.broadcast(pa.array([r["term"] for r in terms.collect()], pa.string()))  # counted above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                yield _counted(piece, shared.value)

    kind = StructType([StructField("doc_id", tokens.schema["doc_id"].dataType), StructField("dl", IntegerType()), StructField("term", StringType()), StructField("tf", LongType())])
    held = written(tokens.select("doc_id", "dl", "tokens").mapInArrow(run, kind), "postings")
    own = held.filter("term IS NULL").select("doc_id", "dl")
    posts = held.filter("term IS NOT NULL").select("doc_id", "term", "tf", "dl")
    if own.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # rows of one id are one document
        posts = written(posts.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")), "postings")
    return posts, written(corpus_stats(own), "statistics")


def _numbered(batch: pa.RecordBatch, terms: pa.Array, held: np.ndarray) -> pa.RecordBatch:
    """(doc_id, dl, numbers, tfs) of (doc_id, lower-case text): a row for each document, with the numbers of the terms that it holds."""
    runs, dl = cut(batch.column(1), held)
    codes = pc.index_in(runs.values, value_set=terms).fill_null(-1).to_numpy()
    rows = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(runs.offsets.to_numpy()))
    kept = codes >= 0
    met, tf = np.unique(rows[kept] * max(1, len(terms)) + codes[kept], return_counts=True)
    row, number = np.divmod(met, max(1, len(terms)))
    ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (number, tf)]
    return pa.RecordBatch.from_arrays([batch.column(0), dl, *lists], names=["doc_id", "dl", "numbers", "tfs"])


def counted_documents(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, terms): a row for each document (doc_id, dl, numbers, tfs) with the terms that it holds by number, written; and (number, term). terms: term, each once, ``LOOKED_UP`` at most."""
    spark = docs.sparkSession
    names = pa.array(sorted(r["term"] for r in terms.collect()), pa.large_string())  # counted by the caller
    shared = spark.sparkContext.broadcast((names, token_characters(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                yield _numbered(piece, *shared.value)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    many = ArrayType(IntegerType())
    kind = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("dl", IntegerType()), StructField("numbers", many), StructField("tfs", many)])
    numbered = spark.createDataFrame([(i, t) for i, t in enumerate(names.to_pylist())], "number int, term string")
    return written(rows.mapInArrow(run, kind), "counted"), numbered


def document_postings(counted: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, term, tf, dl) of ``counted_documents``; rows of one id are one document."""
    one = counted.select("doc_id", "dl", F.explode(F.arrays_zip("numbers", "tfs")).alias("p")).select("doc_id", "dl", "p.numbers", "p.tfs")
    rows = one.join(if_small(terms, LOOKED_UP)(terms), one["numbers"] == terms["number"])
    return rows.groupBy("doc_id", "term").agg(F.sum("tfs").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return tokens.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)"""
    counts = posts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # stats: one row


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf): tokens of a query count as often as they occur."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.explode(search_tokens(F.col(text_col))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, *, config: Bm25Config = Bm25Config(), doc_id: str = "doc_id", query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with the query."""
    tokens = tokenised(docs, doc_id, text_col)
    wanted = query_terms(queries, query_id, text_col)
    # read twice below (statistics and scores): written once
    posts = written(postings(tokens, wanted), "postings")
    return score_postings(posts, corpus_stats(tokens), wanted, config)


def score_postings(posts: DataFrame, stats: DataFrame, wanted: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """Scores of (query, document) pairs. Postings are dealt by document once; terms come to them, so a pair's parts meet without another shuffle."""
    terms = wanted.join(term_stats(posts, stats).select("term", "idf"), "term")
    width = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hint = if_small(wanted, MAX_TERMS)
    rows = posts.repartition(width, "doc_id").join(hint(terms), "term").crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    tf = F.col("tf")
    norm = config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * (tf * (config.k1 + 1) / (tf + norm) + config.delta)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).filter(F.col("score") > 0)


def top_n(scores: DataFrame, n: int, *, by: str = "score", query: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The n best rows of each query, with rank; ties by id. The limit is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(by).desc(), F.col(tie)))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= n)


def penalise_other_law(hits: DataFrame, factor: float) -> DataFrame:
    """Scores of hits under another law than the query's, times factor; order and ranks stay."""
    other = F.col("query_law").isNotNull() & ~F.col("law").eqNullSafe(F.col("query_law"))
    return hits.withColumn("score", F.round(F.when(other, F.col("score") * factor).otherwise(F.col("score")), 4))


def saved_index(docs: DataFrame, path: str, *, reindex: bool = False, doc_id: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) kept below ``path``: read if they are there whole, else (or with reindex) built and written.

    Postings are sorted by term within their files, so that a query's terms skip most of what they don't need.
    """
    spark = docs.sparkSession
    if reindex or not all(exists(spark, f"{path}/{part}/_SUCCESS") for part in ("postings", "statistics")):
        tokens = tokenised(docs, doc_id, text_col)
        postings(tokens).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        corpus_stats(tokens).write.mode("overwrite").parquet(f"{path}/statistics")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics")


def search_saved(posts: DataFrame, stats: DataFrame, queries: DataFrame, *, config: Bm25Config = Bm25Config(), query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """bm25_scores over a saved index."""
    wanted = query_terms(queries, query_id, text_col)
    terms = wanted.select("term").distinct()
    return score_postings(written(posts.join(if_small(terms, MAX_TERMS)(terms), "term", "left_semi"), "postings"), stats, wanted, config)
