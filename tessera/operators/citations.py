"""Citation map: which decisions cite an article, and in which section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import cited_articles
from ..functions.text import drop_paragraph, section_tag

#: Codes of laws and their numbers.
LAW_CODES = {"6098": "TBK", "6102": "TTK", "6502": "TKHK"}


def citations(decisions: DataFrame, law_codes: dict[str, str] = LAW_CODES) -> DataFrame:
    """(key, decision_id, pos, section): every article that a decision cites, once. decisions: decision_id, text, pos (corpus order)."""
    rows = decisions.filter((F.trim("decision_id") != "") & (F.col("text") != ""))
    found = cited_articles(F.col("text"), sorted(set(law_codes.values())), sorted(law_codes))
    codes = F.create_map(*[F.lit(x) for pair in law_codes.items() for x in pair])
    rows = rows.select(F.trim("decision_id").alias("decision_id"), "pos", section_tag(F.col("text")).alias("section"), F.explode(found).alias("c"))
    law = F.coalesce(F.try_element_at(codes, F.col("c.law")), F.upper("c.law"))
    rows = rows.withColumn("key", F.concat_ws("_", law, drop_paragraph(F.col("c.article"))))
    return rows.groupBy("key", "decision_id").agg(F.min("pos").alias("pos"), F.min_by("section", "pos").alias("section"))


def citation_map(cited: DataFrame, most: int = 20) -> DataFrame:
    """(key, citations): the first ``most`` decisions of each key in corpus order. The cap applies before rows are gathered."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos", "decision_id"))
    few = cited.withColumn("place", place).filter(F.col("place") <= most)
    rows = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "decision_id", "section"))).alias("rows"))
    return rows.select("key", F.transform("rows", lambda r: F.struct(r["decision_id"].alias("decision_id"), r["section"].alias("section"))).alias("citations"))


def attach(chunks: DataFrame, cited: DataFrame) -> DataFrame:
    """chunks with their citations, an empty array where there are none."""
    none = F.array().cast(cited.schema["citations"].dataType)
    keyed = chunks.withColumn("key", F.concat_ws("_", "law", "article_no"))
    return keyed.join(cited, "key", "left").withColumn("citations", F.coalesce("citations", none)).drop("key")


def total_citations(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.sum(F.size("citations")).alias("citations"))


def coverage(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(law, article_no, chunks, first_text) for every expected article; chunks is 0 where it is missing."""
    found = chunks.groupBy("law", "article_no").agg(F.count("*").alias("chunks"), F.min_by("text", "chunk_index").alias("first_text"))
    return expected.join(found, ["law", "article_no"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def missing(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    return expected.join(chunks.select("law", "article_no"), ["law", "article_no"], "left_anti")
