"""Chunks of bounded token length.

Packing is a fold over an ordered array, so it runs on Arrow batches of arrays (``mapInArrow``), a piece of a batch at a time; splitting before and numbering
after are column expressions. Token counts are those of ``approx_tokens`` (words times 1.3, rounded down), summed per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.batches import pieces
from ..functions.text import approx_tokens, decision_sections, paragraphs, sentences, slug, strip
from ..storage import written


def tokens_of(text: str) -> int:
    return len(text.split()) * 13 // 10


def _tail(pieces: list[str], budget: int) -> list[str]:
    """Longest run of last pieces within the budget."""
    total, at = 0, len(pieces)
    while at and total + tokens_of(pieces[at - 1]) <= budget:
        at -= 1
        total += tokens_of(pieces[at])
    return pieces[at:]


class _Packer:
    """Greedy windows: a piece that would overflow a long enough window closes it; its last pieces are carried over."""

    def __init__(self, config: ChunkConfig, joined: bool) -> None:
        self.config, self.joined = config, joined
        self.carry = int(config.max_tokens * config.overlap_ratio)
        self.done: list[str] = []
        self.open: list[str] = []
        self.size = 0

    def flush(self) -> None:
        self.done.append(" ".join(self.open))
        kept = _tail(self.open, self.carry)
        # sentences are carried as one piece, words as they are
        self.open = ([" ".join(kept)] if kept else []) if self.joined else kept
        self.size = tokens_of(" ".join(self.open))

    def add(self, piece: str) -> None:
        n = tokens_of(piece)
        if self.size + n > self.config.max_tokens and self.size >= self.config.min_tokens:
            self.flush()
        self.open.append(piece)
        self.size += n


def windows(parts: list[str], config: ChunkConfig) -> list[str]:
    """Windows over sentences; a sentence over the maximum is packed by words, and its rest opens the next window."""
    pack = _Packer(config, joined=True)
    for part in parts:
        if tokens_of(part) <= config.max_tokens:
            pack.add(part)
            continue
        if pack.open:
            pack.flush()
        inner = _Packer(config, joined=False)
        for word in part.split():
            inner.add(word)
        pack.done += inner.done
        if inner.open:
            pack.open = [" ".join(inner.open)]
            pack.size = tokens_of(pack.open[0])
    if pack.open:
        last = " ".join(pack.open)
        if tokens_of(last) >= config.min_last_tokens:
            pack.done.append(last)
        elif pack.done:
            pack.done[-1] += " " + last
    return [w for w in pack.done if w.strip()]


def grouped(parts: list[str], config: ChunkConfig) -> list[str]:
    """Neighbouring parts together up to the maximum; longer parts alone; a short rest joins the group before it."""
    groups: list[list[str]] = []
    size = 0
    fresh = True
    for part in parts:
        n = tokens_of(part)
        if n > config.max_tokens:
            groups.append([part])
            fresh = True
        elif fresh or size + n > config.max_tokens:
            groups.append([part])
            size, fresh = n, False
        else:
            groups[-1].append(part)
            size += n
    if not fresh and size < config.min_chunk_tokens and len(groups) > 1:
        rest = groups.pop()
        groups[-1] += rest
    return [" ".join(g) for g in groups]


def merged_short(parts: list[str], config: ChunkConfig) -> list[str]:
    """Left fold: a part joins the one before it if both fit together or if it is short."""
    out: list[str] = []
    for part in parts:
        n = tokens_of(part)
        if out and (tokens_of(out[-1]) + n <= config.max_tokens or n < config.min_chunk_tokens):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _sentences(text: str) -> list[str]:
    import re

    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]


def _fold(df: DataFrame, parts: Column, fold: Callable[[list[str]], list[str]]) -> DataFrame:
    """df with chunk_index and text, a row for every string that the fold makes of an array column."""
    df = df.drop("chunk_index", "text").withColumn("_parts", parts) if "_parts" not in df.columns else df
    kept = [c for c in df.columns if c != "_parts"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_parts"], "_chunks array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, batch.num_columns - 1):
                chunks = [fold(p.as_py()) if p.is_valid else [] for p in b.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(chunks, pa.list_(pa.string()))], names=[*kept, "_chunks"])

    out = df.select(*kept, "_parts").mapInArrow(run, schema)
    return out.select(*kept, F.posexplode("_chunks").alias("chunk_index", "text"))


def chunk_windows(docs: DataFrame, text_col: str = "text", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Windows of plain documents: the other columns, chunk_index, text."""
    parts = docs.withColumn("_parts", sentences(F.coalesce(F.col(text_col), F.lit("")))).drop(text_col)
    return _fold(parts, F.col("_parts"), lambda p: windows(p, config))


def chunk_statutes(articles: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Statute articles (law, law_no, article_no, text): clauses grouped, long groups windowed."""
    parts = articles.filter(strip(F.col("text")) != "").withColumn("_parts", paragraphs(F.col("text")))
    # rows that share law and article follow each other whole, in the order of the corpus
    parts = parts.withColumn("_row", F.monotonically_increasing_id()).drop("text")

    def fold(p: list[str]) -> list[str]:
        out: list[str] = []
        for g in grouped(p, config):
            out += windows(_sentences(g), config) if tokens_of(g) > config.max_tokens else [g]
        return out

    return numbered(_fold(parts, F.col("_parts"), fold).withColumn("source", F.lit("mevzuat")).withColumn("decision_id", F.lit(None).cast("string")), ["law", "article_no"], index=["_row", "chunk_index"]).drop("_row")


def chunk_decisions(decisions: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Court decisions (decision_id, query, text): by section, long sections windowed, short ones merged."""
    parts = decisions.filter(strip(F.col("text")) != "").withColumn("_parts", decision_sections(F.col("text")))
    parts = parts.select("decision_id", F.col("query").alias("law"), F.lit(None).cast("string").alias("law_no"), F.lit(None).cast("string").alias("article_no"), "_parts")

    def fold(p: list[str]) -> list[str]:
        if len(p) <= 1:
            return windows(_sentences(" ".join(p)), config)
        out: list[str] = []
        for section in p:
            out += [section] if tokens_of(section) <= config.max_tokens else windows(_sentences(section), config)
        return merged_short(out, config)

    return numbered(_fold(parts, F.col("_parts"), fold).withColumn("source", F.lit("yargitay")), ["law", "decision_id"])


def chunk_gazette(issues: DataFrame, config: ChunkConfig = ChunkConfig(), law_codes: dict[str, str] | None = None) -> DataFrame:
    """Gazette issues: every changed article whole or windowed, numbered within its page (a row) in the order of the page's articles.

    law_codes maps law numbers to codes, so that later joins match.
    """
    first = F.try_element_at("kanunlar", F.lit(1))
    code = first
    if law_codes:
        table = F.create_map(*[F.lit(x) for pair in law_codes.items() for x in pair])
        code = F.coalesce(F.try_element_at(table, first), first)
    rows = issues.withColumn("_page", F.monotonically_increasing_id())  # before a page's articles are rows
    rows = rows.select("rg_sayi", code.alias("law"), first.alias("law_no"), "_page", F.posexplode("degisen_maddeler").alias("_place", "m"))
    rows = rows.select("rg_sayi", "law", "law_no", "_page", "_place", F.col("m.madde_no").alias("article_no"), F.array(strip(F.col("m.icerik"))).alias("_parts")).filter(F.col("_parts")[0] != "")
    fold = lambda p: p if tokens_of(p[0]) <= config.max_tokens else windows(_sentences(p[0]), config)
    out = _fold(rows, F.col("_parts"), fold).withColumn("source", F.lit("resmigazete")).withColumn("decision_id", F.lit(None).cast("string"))
    return numbered(out, ["_page"], index=["_place", "chunk_index"]).drop("_page", "_place")


def numbered(chunks: DataFrame, document: list[str], index: list[str] | None = None) -> DataFrame:
    """chunk_index from 0, chunk_total, token_len and slug id per document."""
    w = Window.partitionBy(*document)
    out = chunks.withColumn("chunk_index", (F.row_number().over(w.orderBy(*(index or ["chunk_index"]))) - 1).cast("int"))
    out = out.withColumn("chunk_total", F.count("*").over(w).cast("int")).withColumn("token_len", approx_tokens(F.col("text")))
    base = F.concat_ws("_", F.coalesce("law", "source"), F.coalesce("article_no", "decision_id", F.lit("x")), F.col("chunk_index").cast("string"))
    return out.withColumn("chunk_id", slug(base))


def all_chunks(*parts: DataFrame) -> DataFrame:
    """Union of the sources' chunks, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def positional_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Ids ``<source>_00000``, numbered along ``order`` within each source.

    Numbers come from counts per sorted range, so no window holds a source: rows are range-partitioned, each partition counts its
    rows by source, and a partition's first numbers are the sums of those before it.
    """
    spark = chunks.sparkSession
    ranged = chunks.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", *order)
    # written once: a second evaluation could cut the ranges elsewhere
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "positional-ids")
    counts = ranged.groupBy("source", "_part").agg(F.count("*").alias("n"))  # a row for each partition and source
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("source", "_part").orderBy(*order))
    out = ranged.withColumn("_place", place).join(starts, ["source", "_part"])
    number = (F.col("_start") + F.col("_place") - 1).cast("long")
    return out.withColumn("chunk_id", F.format_string("%s_%05d", F.col("source"), number)).drop("_part", "_start", "_place")


def chunk_stats(chunks: DataFrame, low: int = 100, band: tuple[int, int] = (180, 250)) -> DataFrame:
    """Per source: chunks, mean, least and most tokens, chunks below ``low`` and within ``band``."""
    n = F.col("token_len")
    return chunks.groupBy("source").agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(n), 1).alias("mean_tokens"),
        F.min(n).alias("least_tokens"),
        F.max(n).alias("most_tokens"),
        F.count_if(n < low).alias("short_chunks"),
        F.count_if(n.between(*band)).alias("band_chunks"),
    )
