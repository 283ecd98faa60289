"""Retrieval metrics over a table of ranked results and a table of expected articles.

results: query_id, rank, article_no; expected: query_id, law, expected (array). Everything is one aggregation per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGETS = {"recall": 0.75, "mrr": 0.60, "ndcg": 0.70}


def per_query(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, law, recall, precision, mrr, ndcg, hit, found, missed) for every expected query, results or not."""
    top = results.filter(F.col("rank") <= k).select("query_id", "rank", "article_no")
    rows = expected.join(top, "query_id", "left")
    hit = F.coalesce(F.array_contains("expected", F.col("article_no")), F.lit(False))
    gain = F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    agg = rows.groupBy("query_id").agg(
        F.first("law").alias("law"),
        F.first("expected").alias("expected"),
        F.count("rank").alias("n"),
        F.collect_set(F.when(hit, F.col("article_no"))).alias("found"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.sum(gain).alias("dcg"),
    )
    wanted, got = F.size("expected"), F.size("found")
    ideal = F.aggregate(F.when(wanted > 0, F.sequence(F.lit(1), F.least(wanted, F.lit(k)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return agg.select(
        "query_id",
        "law",
        F.when(wanted > 0, got / wanted).otherwise(0.0).alias("recall"),
        F.when(F.col("n") > 0, got / F.lit(k)).otherwise(0.0).alias("precision"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        F.when(wanted > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.col("first_hit").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
        F.array_sort("found").alias("found"),
        F.array_sort(F.array_except("expected", "found")).alias("missed"),
    )


METRICS = ("recall", "precision", "mrr", "ndcg", "hit")


def macro(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means of all metrics to four places, over all queries or by group."""
    means = [F.round(F.avg(m), 4).alias(m) for m in METRICS]
    return metrics.groupBy(*([by] if by else [])).agg(F.count("*").alias("queries"), *means)


def against_targets(summary: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(metric, value, target, difference, passed)"""
    rows = summary.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target")) for m, t in targets.items()])).alias("r"))
    return rows.select("r.*").withColumn("difference", F.round(F.col("value") - F.col("target"), 4)).withColumn("passed", F.col("value") >= F.col("target"))


def root_causes(metrics: DataFrame, detected: Column | None = None) -> DataFrame:
    """(query_id, cause, about_rank): queries with no hit, part of the articles, a late hit, or no law detected."""
    causes = [
        (F.col("hit") == 0, "no hit"),
        ((F.col("recall") > 0) & (F.col("recall") < 0.75), "partial"),
        ((F.col("mrr") > 0) & (F.col("mrr") < 0.5), "late"),
    ]
    if detected is not None:
        causes.append((detected.isNull(), "law not detected"))
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in causes]), lambda x: x.isNotNull())
    return metrics.select("query_id", F.explode(named).alias("cause"), F.when(F.col("mrr") > 0, F.round(1 / F.col("mrr"))).cast("int").alias("about_rank"))
