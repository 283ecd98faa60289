"""Fusion of dense and sparse hits, boosts, injection of exact matches, and diversity caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.text import first_number, word_count


def min_max(value: Column, by: str = "query_id") -> Column:
    """Scaled to 0..1 within a query; 1 where all values are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), F.lit(1.0)))


def alpha(text: Column, article: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    n = word_count(text)
    return (
        F.when(article.isNotNull(), config.alpha_exact).when(n < config.short_words, config.alpha_short).when(n > config.long_words, config.alpha_semantic).otherwise(config.alpha_default)
    )


def retrieval_intent(text: Column, article: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    n = word_count(text)
    return F.when(article.isNotNull(), "exact_article").when(n < config.short_words, "short_keyword").when(n > config.long_words, "semantic_story").otherwise("standard_semantic")


def fuse(dense: DataFrame, sparse: DataFrame, alphas: DataFrame) -> DataFrame:
    """(query_id, doc_id, dense_score, sparse_score, score). A side where a document is missing counts 0."""
    d = dense.select("query_id", "doc_id", F.round("score", 4).alias("dense_score")).withColumn("d", min_max(F.col("dense_score")))
    s = sparse.select("query_id", "doc_id", F.round("score", 4).alias("sparse_score")).withColumn("s", min_max(F.col("sparse_score")))
    both = d.join(s, ["query_id", "doc_id"], "full_outer").join(alphas.select("query_id", "alpha"), "query_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.round(F.col("alpha") * zero(F.col("d")) + (1 - F.col("alpha")) * zero(F.col("s")), 6)
    return both.select("query_id", "doc_id", zero(F.col("dense_score")).alias("dense_score"), zero(F.col("sparse_score")).alias("sparse_score"), score.alias("score"))


def boost(hits: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Scores of hits with the query's article, then of those with its law, are raised; hits below the least score go.

    hits: score, article_no, law, query_article, query_law.
    """
    same_article = F.col("query_article").isNotNull() & (first_number(F.col("article_no")) == F.col("query_article"))
    same_law = F.col("query_law").isNotNull() & (F.col("law") == F.col("query_law"))
    hits = hits.withColumn("score", F.when(same_article, F.round(F.col("score") * config.boost_article, 6)).otherwise(F.col("score")))
    hits = hits.withColumn("score", F.when(same_law, F.round(F.col("score") * config.boost_law, 6)).otherwise(F.col("score")))
    return hits.filter(F.col("score") >= config.min_score)


def ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")))


def inject(hits: DataFrame, queries: DataFrame, corpus: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """If no hit of a query has its article, up to three corpus rows that have it (and its law, if it has one) go on top.

    hits: query_id, doc_id, dense_score, sparse_score, score, article_no, law, rank; queries: query_id, query_article, query_law;
    corpus: doc_id, article_no, law, in order of doc_id.
    """
    asked = queries.filter(F.col("query_article").isNotNull()).select("query_id", "query_article", "query_law")
    served = hits.select("query_id", "article_no").join(asked, "query_id").filter(first_number(F.col("article_no")) == F.col("query_article")).select("query_id").distinct()
    open_queries = asked.join(served, "query_id", "left_anti")
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    found = corpus.withColumn("number", first_number(F.col("article_no"))).join(open_queries, F.col("number") == F.col("query_article"))
    found = found.filter(F.col("query_law").isNull() | (F.col("law") == F.col("query_law")))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).filter(F.col("place") <= config.shortcut_max)
    found = found.join(top, "query_id", "left")
    new = found.select(
        "query_id", "doc_id", F.lit(0.0).alias("dense_score"), F.lit(0.0).alias("sparse_score"),
        F.round(F.coalesce("top", F.lit(1.0)) * config.shortcut_lift, 6).alias("score"), "article_no", "law", (-F.col("place")).alias("rank"), F.lit(True).alias("injected"),
    )
    old = hits.select("query_id", "doc_id", "dense_score", "sparse_score", "score", "article_no", "law", "rank", F.lit(False).alias("injected"))
    old = old.join(new.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    every = old.unionByName(new)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))


def diversify(hits: DataFrame, k: int, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """At most two hits of a law and article, in rank order; then the first k, ranked anew."""
    place = F.row_number().over(Window.partitionBy("query_id", "law", first_number(F.col("article_no"))).orderBy("rank"))
    kept = hits.withColumn("place", place).filter(F.col("place") <= config.max_same_article).drop("place")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= (k or config.final_k))


def rerank(pairs: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """The k best of each query by a model's score (sigmoid, six places)."""
    from ..functions.text import sigmoid

    scored = pairs.withColumn("rerank_score", sigmoid(score))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
