"""Context assembly, session memory and faithfulness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import article_mentions  # noqa: F401
from ..functions.text import snippet


def session_tail(messages: DataFrame, keep: int = 8, *, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The last ``keep`` messages of every session."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.col(order).desc()))
    return messages.withColumn("from_end", place).filter(F.col("from_end") <= keep)


def session_context(messages: DataFrame, last: int = 4, chars: int = 300, *, session: str = "session_id", order: str = "seq") -> DataFrame:
    """(session, context): the last messages, each cut, one per line as ``role: text``."""
    tail = session_tail(messages, last, session=session, order=order)
    line = F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, chars))
    rows = tail.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    return rows.select(session, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("context"))


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources, blank lines between. hits: query_id, rank, law, article_no, text."""
    head = F.format_string("[%d] %s m.%s: ", F.col("rank"), F.coalesce("law", F.lit("-")), F.coalesce("article_no", F.lit("-")))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(head, F.col("text")).alias("line")))).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources): array of law, article and a snippet, in rank order."""
    one = F.struct("rank", F.struct("law", "article_no", snippet(F.col("text")).alias("summary")).alias("source"))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return rows.select("query_id", F.transform("rows", lambda r: r["source"]).alias("sources"))


def faithfulness(mentions: Column, articles: Column) -> Column:
    """struct(faithful, warning): unfaithful if articles are mentioned and none of them is among the sources.

    warning: "unnamed" if nothing is mentioned though there are sources, "unsupported" if nothing mentioned is among them.
    """
    known = F.filter(articles, lambda a: a.isNotNull() & (a != ""))
    valid = F.exists(mentions, lambda m: F.exists(known, lambda a: F.contains(m, a)))
    silent = F.size(mentions) == 0
    return F.struct(
        (silent | valid).alias("faithful"),
        F.when(silent & (F.size(articles) > 0), "unnamed").when(~silent & ~valid, "unsupported").otherwise("").alias("warning"),
    )


def with_warning(answer: Column, check: Column, text: str) -> Column:
    return F.when(check["faithful"], answer).otherwise(F.concat(answer, F.lit("\n\n"), F.lit(text)))


def append_messages(log: DataFrame, new: DataFrame, *, session: str = "session_id") -> DataFrame:
    """The log with new messages numbered on from each session's last. new: session_id, role, content, turn."""
    last = log.groupBy(session).agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy(session).orderBy("turn"))
    numbered = new.join(last, session, "left").withColumn("seq", (F.coalesce("last", F.lit(-1)) + place).cast("long"))
    return log.unionByName(numbered.select(*log.columns), allowMissingColumns=True)
