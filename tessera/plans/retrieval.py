"""Retrieval and answering for many queries at once.

One plan for all queries, keyed by query_id: sparse and dense hits, fusion, boosts, injection, diversity, then context,
answer and checks. Models come in as columns or stand-ins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Bm25Config, RetrievalConfig
from ..operators import answers, cells, fusion, index, models, topk, vectors
from ..storage import written


@dataclass
class Corpus:
    """docs: doc_id, text, law, article_no; points: doc_id, vector, law."""

    docs: DataFrame
    points: DataFrame


def retrieve(queries: DataFrame, corpus: Corpus, *, k: int | None = None, config: RetrievalConfig = RetrievalConfig(), bm25: Bm25Config = Bm25Config()) -> DataFrame:
    """Ranked hits. queries: query_id, text, expanded (for sparse search), vector, query_law, query_article."""
    meta = corpus.docs.select("doc_id", "law", "article_no")
    asked = queries.select("query_id", "query_law", "query_article")
    expanded = queries.select("query_id", F.coalesce("expanded", "text").alias("text"))
    # nine places: what sums in another order differ by is no rank
    sparse = topk.bm25_top(corpus.docs, expanded, config.top_k_sparse, places=9, config=bm25).drop("rank").join(meta, "doc_id").join(asked, "query_id")
    sparse = index.penalise_other_law(sparse, config.other_law_penalty)
    q = queries.select("query_id", "vector", F.col("query_law").alias("law"))
    # read twice (what is there, and who has few): written once; only queries with few hits of their law meet all points
    blocks = cells.built(corpus.points)
    filtered = written(vectors.dense_top(q, corpus.points, config.top_k_dense, blocks=blocks), "dense")
    few = vectors.with_few(q.filter(F.col("law").isNotNull()), filtered, config.dense_fallback_below)
    dense = filtered
    if few.limit(1).count():
        dense = vectors.fallback(filtered, vectors.dense_top(few, corpus.points, config.top_k_dense, filtered=False, blocks=blocks), config.dense_fallback_below)
    alphas = queries.select("query_id", fusion.alpha(F.col("text"), F.col("query_article"), config).alias("alpha"))
    hits = fusion.fuse(dense, sparse, alphas).join(meta, "doc_id").join(asked, "query_id")
    # injection reads the hits four times (a few hundred rows a query), so they are computed once
    hits = written(fusion.ranked(fusion.boost(hits, config)), "hits")
    hits = fusion.inject(hits, asked, meta, config)
    return fusion.diversify(hits, k or config.final_k, config)


def answer(queries: DataFrame, hits: DataFrame, docs: DataFrame, history: DataFrame | None = None, *, reply: Column | None = None, warning: str = "Check the cited articles.") -> DataFrame:
    """(query_id, answer, sources, intent, rewritten, mentions, check). intent and rewritten are those columns of the queries, null without them or where
    the rewritten question is the question; how long a reply took is a matter of the job, not of a row. reply: a column over (text, context), by default the extractive stand-in.

    history: (query_id, context) of the session, put before the sources.
    """
    # texts of the hits, read once for context and sources
    full = written(hits.join(docs.select("doc_id", "text"), "doc_id"), "hit-texts")
    given = lambda name: F.col(name) if name in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", "text", given("intent").alias("intent"), F.nullif(given("rewritten"), F.col("text")).alias("rewritten"))
    rows = asked.join(answers.context_block(full), "query_id", "left").join(answers.sources(full), "query_id", "left")
    articles = full.groupBy("query_id").agg(F.array_sort(F.collect_set("article_no")).alias("articles"))
    rows = rows.join(articles, "query_id", "left").withColumn("articles", F.coalesce("articles", F.array().cast("array<string>")))
    if history is not None:
        rows = rows.join(history.withColumnRenamed("context", "history"), "query_id", "left")
        rows = rows.withColumn("context", F.concat_ws("\n\n", "history", "context"))
    rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
    made = reply if reply is not None else models.extractive_answer(F.col("text"), F.col("context"))
    rows = rows.withColumn("answer", made).withColumn("mentions", answers.article_mentions(F.col("answer")))
    rows = rows.withColumn("check", answers.faithfulness(F.col("mentions"), F.col("articles")))
    return rows.withColumn("answer", answers.with_warning(F.col("answer"), F.col("check"), warning)).select("query_id", "answer", "sources", "intent", "rewritten", "mentions", "check")
