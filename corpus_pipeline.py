"""A training corpus from ``documents``: five stages, each one of the numbered operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``; the last returns
the packed pieces of ``op2``. Between stages the result is written to the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialise, release
from tessera.llm.jaccard import similar_components
from tessera.llm.linededup import drop_shared_lines
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_sequences
from tessera.llm.quality import classify, graded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is at least 0.6 (a tie is kept).

    Null and empty texts score as the model's thresholds say; very long texts are scored whole; repeated rows share their fate; without
    ratings all stay; an empty table stays empty; other columns may have any name.
    """
    labels = graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = free_name(docs, "_quality")
    scored = classify(docs, labels, levels=3, keep_at=0.6, into=into)
    return scored.filter(F.col(into)["keep"]).drop(into)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that five documents share (the largest doc_id keeps them).

    A null text stays null; a text may become empty; very long texts are split whole; repeated rows with one id count as one document and lose the
    same lines; a null id is one document, smaller than all others; an empty table stays empty; other columns may have any name; n_chars, where there is one, follows the text.
    """
    out = drop_shared_lines(docs, min_chars=40, min_docs=5, info=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of similar texts: that with the smallest doc_id, a null doc_id last.

    Every row is judged by its text alone: rows with equal or null ids and different texts all stay, copies do not. Texts without words are similar to
    nothing and stay; very long texts are compared whole; of rows with equal ids the first written stays; an empty table stays empty;
    other columns may have any name.
    """
    row = free_name(docs, "_row")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = similar_components(keyed, id_col=row, percent=75)
    ids = keyed.select(F.col(row).alias("_r"), F.col("doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_r"))
    first = groups.join(ids, F.col("doc_id") == F.col("_r")).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = materialise(first.select(F.col("first._r").alias("_r")), "pipeline-kept")
    return keyed.join(kept.hint("merge"), F.col(row) == F.col("_r"), "left_semi").drop(row)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and get the whole copies of their source alone; a null source is a source of its own; very long texts count whole; rows with equal id, text and source
    share their fate; equal ranks (ties) go together; an empty table stays empty; other columns may have any name.
    """
    into, copy = free_name(docs, "_mix"), free_name(docs, "_copy")
    mixed = mix_sources(docs, weights=(5.0, 2.0, 1.0), max_repeat=3, into=into)
    copies = mixed.filter(F.col(into)["copies"] > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(into)["copies"])))
    return copies.drop(into, copy)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 1024 tokens and their places in sequences.

    A null or empty text is its end token; very long texts are cut; repeated rows are packed each; pieces of equal length go in any order; an empty table gives
    no piece; other columns are not returned.
    """
    packed = pack_sequences(docs, tokenizer_path("byte_bpe_50k.json"), limit=1024, end_id=2, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", sequence_packing),
]

#: The fitted model, the tokenizer and the packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
