"""Entity and intent detection in queries from caller-supplied lexicons, all queries at once.

Lexicons are DataFrames of any size; a query meets a phrase where it contains it, found by an automaton over all phrases (``phrases``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import article_number, has_reference  # noqa: F401
from ..functions.text import strip, word_count, words
from .phrases import find_phrases


def contained(queries: DataFrame, lexicon: DataFrame, phrase: str = "phrase", *, lower: bool = True) -> DataFrame:
    """Rows of queries x lexicon whose lower-case text contains the phrase (lower=False: the text as it is)."""
    found = find_phrases(queries, lexicon.select(phrase), lower=lower, into="_found")
    return found.join(lexicon, F.col("_found") == F.col(phrase)).drop("_found")


def by_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, class) of the first alias in lexicon order. aliases: ord, phrase, class."""
    hits = contained(queries, aliases)
    return hits.groupBy("query_id").agg(F.min_by("class", "ord").alias("class"))


def by_keywords(queries: DataFrame, keywords: DataFrame, least: float = 4, margin: float = 1.8) -> DataFrame:
    """(query_id, class, points) where the best class has enough points and a clear lead. keywords: class, phrase, weight."""
    points = contained(queries, keywords).groupBy("query_id", "class").agg(F.sum("weight").alias("points"))
    w = Window.partitionBy("query_id").orderBy(F.col("points").desc(), "class")
    best = points.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("points").over(w)).filter("rank = 1")
    clear = F.col("second").isNull() | (F.col("second") <= 0) | (F.col("points") / F.col("second") >= margin)
    return best.filter((F.col("points") >= least) & clear).select("query_id", "class", "points")


def detect_class(queries: DataFrame, aliases: DataFrame, keywords: DataFrame) -> DataFrame:
    """queries with their class (law): by alias, else by weighted keywords, else null."""
    a = by_alias(queries, aliases).withColumnRenamed("class", "by_alias")
    k = by_keywords(queries, keywords).select("query_id", F.col("class").alias("by_keyword"))
    return queries.join(a, "query_id", "left").join(k, "query_id", "left").withColumn("class", F.coalesce("by_alias", "by_keyword")).drop("by_alias", "by_keyword")


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries with the expansions of every key they contain appended in lexicon order. synonyms: ord, key, expansion."""
    hits = contained(queries, synonyms, "key").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "expansion"))).alias("more"))
    joined = F.concat_ws(" ", F.col("text"), F.transform("more", lambda m: m["expansion"]))
    return queries.join(hits, "query_id", "left").withColumn("expanded", joined).drop("more")


def intent(queries: DataFrame, lexicon: DataFrame, default: str, default_k: int) -> DataFrame:
    """queries with intent and k: most keywords win, the earlier intent wins ties. lexicon: ord, intent, phrase, k."""
    counted = contained(queries, lexicon).groupBy("query_id", "ord", "intent", "k").agg(F.count("*").alias("n"))
    best = counted.groupBy("query_id").agg(F.max_by(F.struct("intent", "k"), F.struct("n", -F.col("ord"))).alias("best"))
    out = queries.join(best, "query_id", "left")
    return out.withColumn("intent", F.coalesce("best.intent", F.lit(default))).withColumn("k", F.coalesce("best.k", F.lit(default_k))).drop("best")


def first_kind(text: Column, kinds: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """First kind one of whose phrases the text contains."""
    c = F.lower(text)
    out = F.lit(default)
    for name, phrases in reversed(kinds):
        any_of = F.lit(False)
        for p in phrases:
            any_of = any_of | F.contains(c, F.lit(p))
        out = F.when(any_of, name).otherwise(out)
    return out


def on_topic(text: Column, stop_words: Sequence[str], signals: Sequence[str], least_words: int = 3) -> Column:
    """No stop word among the words; and a signal somewhere in the text, or enough words."""
    tokens = words(F.lower(text))
    stopped = F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in stop_words]))
    signal = F.exists(F.array(*[F.lit(s) for s in signals]), lambda s: F.contains(F.lower(text), s))
    return ~stopped & (signal | (word_count(text) >= least_words))


def asked(queries: DataFrame) -> DataFrame:
    """Queries that are not blank."""
    return queries.filter(F.coalesce(strip(F.col("text")), F.lit("")) != "")


def is_greeting(text: Column, greetings: Sequence[str]) -> Column:
    return strip(F.lower(text)).isin(list(greetings))


def may_rewrite(text: Column, least: int = 4, most: int = 30) -> Column:
    """A query is sent to a rewriting model unless it names an article or is too short or too long."""
    return ~has_reference(text) & word_count(text).between(least, most)


def rewritten(text: Column, proposal: Column, most_chars: int = 300) -> Column:
    """The model's proposal where it is usable, else the text."""
    good = strip(proposal)
    return F.when(may_rewrite(text) & (good != "") & (F.length(good) <= most_chars), good).otherwise(text)
