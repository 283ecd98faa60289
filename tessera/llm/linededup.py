"""Removal of lines that many documents share, by a range-partitioned sort of line hashes.

To find shared lines, only 128-bit hashes of line keys, ids and positions are shuffled, no text: the occurrences are written once (so that
the sampling of ranges does not make them again), range-partitioned and sorted by (hash, document downwards, position): the first document of a run keeps its lines, and when the run reaches
``min_docs`` documents the lines of all others are dropped, in one streaming pass with a few documents of look-ahead. Because
document and position are part of the range key, a line that a third of all documents hold spreads over many partitions;
the runs that touch a partition's border are put together afterwards from one summary row per partition and border.

The result (``keep_bitmaps``) is one compressed bitmap of kept lines per document that loses any. ``drop_shared_lines`` applies them: there,
rows meet their bitmaps by a sorted shuffle, texts included, since the bitmaps grow with the documents.

Defined results: a null or empty text has one empty line; a null id counts as one document, smaller than all others; rows with equal id and
text get the same bitmap; rows with equal id and different text are one document (for counting and for keeping) with a
bitmap each; lines that occur twice in a document count once and share their fate; very long texts are split whole; an empty table gives no bitmap; further columns are left alone (an input column named like an output, in any case of letters, is replaced).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import BLANKS, but, materialise, release, shuffle_width

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = "kind int, h1 long, h2 long, doc long, no_doc boolean, mark long, n_lines int, pos int, part int, docs long, last_doc long, last_no_doc boolean"


def text_lines(text: str):
    """Column of all lines of a text column."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, no_doc, mark, n_lines, pos) of every line whose key is long enough; mark tells rows of one id apart."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), text_lines(text_col).alias("lines"))
    lines = lines.select(
        F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), F.col("doc").isNull().alias("no_doc"), "mark", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")
    )
    lines = lines.filter(F.length("line") >= min_chars)
    key = F.translate(F.btrim(F.col("line"), F.lit(BLANKS)), _UPPER, _LOWER)
    lines = lines.withColumn("key", key).filter(F.length("key") >= min_chars)
    lines = lines.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(7), "key"))
    return lines.select("h1", "h2", "doc", "no_doc", "mark", "n_lines", "pos")


def _stream(min_docs: int):
    """Over a sorted partition: kind 0 dropped occurrence, 1 undecided occurrence of a border run, 2 summary of a border run.

    A run is a border run if it is the first or the last of its partition. The open run holds the rows of its first
    document and, until min_docs documents are seen, those of the others; after that, others are dropped as they come, since
    the largest document of the whole run is the first one here or a larger one in an earlier partition.
    """
    names = ["h1", "h2", "doc", "no_doc", "mark", "n_lines", "pos"]

    class Run:
        def __init__(self, rows: dict[str, np.ndarray], first: bool) -> None:
            self.first = first
            self.doc, self.no_doc = int(rows["doc"][0]), bool(rows["no_doc"][0])
            self.hash = int(rows["h1"][0]), int(rows["h2"][0])
            self.docs, self.last = 0, None
            self.own = self.others = {c: x[:0] for c, x in rows.items()}

        def take(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
            """Add rows; gives those that are decided (dropped) now."""
            doc, no_doc = rows["doc"], rows["no_doc"]
            self.docs += int(((doc[1:] != doc[:-1]) | (no_doc[1:] != no_doc[:-1])).sum()) + (self.last != (int(doc[0]), bool(no_doc[0])))
            self.last = int(doc[-1]), bool(no_doc[-1])
            other = (doc != self.doc) | (no_doc != self.no_doc)
            self.own = {c: np.concatenate([self.own[c], rows[c][~other]]) for c in names}
            self.others = {c: np.concatenate([self.others[c], rows[c][other]]) for c in names}
            if self.docs < min_docs:
                return None
            decided, self.others = self.others, {c: x[:0] for c, x in self.others.items()}
            return decided

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def emit(kind: int, cols: dict[str, np.ndarray], docs: int = 0, last: tuple[int, bool] = (0, False)) -> Iterator[pa.RecordBatch]:
            if n := len(cols["h1"]):
                data = [np.full(n, kind, np.int32), *[cols[c] for c in names], np.full(n, part, np.int32), np.full(n, docs, np.int64)]
                data += [np.full(n, last[0], np.int64), np.full(n, last[1], bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=[c.split()[0] for c in _OUT.split(", ")])

        def close(r: Run, last: bool) -> Iterator[pa.RecordBatch]:
            if r.first or last:
                yield from emit(1, r.own)
                yield from emit(1, r.others)
                one = {"h1": r.hash[0], "h2": r.hash[1], "doc": r.doc, "no_doc": r.no_doc, "mark": 0, "n_lines": 0, "pos": 0}
                kinds = {"no_doc": bool, "n_lines": np.int32, "pos": np.int32}
                yield from emit(2, {c: np.array([v], kinds.get(c, np.int64)) for c, v in one.items()}, r.docs, r.last)

        is_open: Run | None = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cols = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            change = np.empty(n, bool)
            change[0] = True
            change[1:] = (cols["h1"][1:] != cols["h1"][:-1]) | (cols["h2"][1:] != cols["h2"][:-1])
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], n)
            # shorter runs inside a batch cannot reach min_docs documents
            wanted = ends - starts >= min_docs
            wanted[0] = wanted[-1] = True
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                rows = {c: cols[c][a:b] for c in names}
                if is_open is None or is_open.hash != (int(rows["h1"][0]), int(rows["h2"][0])):
                    if is_open is not None:
                        yield from close(is_open, last=False)
                    is_open = Run(rows, first=is_open is None)
                if (decided := is_open.take(rows)) is not None:
                    yield from emit(0, decided)
        if is_open is not None:
            yield from close(is_open, last=True)

    return run


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, no_doc, mark, n_lines, n_dropped, bitmap) of every document row that loses a line.

    bitmap: zlib of packed bits, one per line, 1 for a kept line; mark: xxhash64 of the text.
    """
    spark = docs.sparkSession
    order = ["h1", "h2", F.col("no_doc").asc(), F.col("doc").desc(), F.col("mark"), F.col("pos")]
    occ = materialise(_occurrences(docs, id_col, text_col, min_chars), "lines-occurrences")
    width = shuffle_width(spark)
    ranged = occ.repartitionByRange(width, *order).sortWithinPartitions(*order)
    found = materialise(ranged.mapInArrow(_stream(min_docs), _OUT), "lines-found")
    release(occ)
    sums = found.filter("kind = 2")
    # one or two summaries a partition: runs of one hash in neighbouring partitions may share a document
    along = Window.partitionBy("h1", "h2").orderBy("part")
    again = (F.lag("last_doc").over(along) == F.col("doc")) & (F.lag("last_no_doc").over(along) == F.col("no_doc"))
    sums = sums.withColumn("docs", F.col("docs") - F.when(again, 1).otherwise(0))
    edges = sums.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max(F.struct(~F.col("no_doc"), F.col("doc"))).alias("top"))
    edges = edges.filter(F.col("all_docs") >= min_docs).select(
        F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("top.doc").alias("top_doc"), (~F.col("top.col1")).alias("top_no_doc")
    )
    # at most two rows for each range partition
    border = found.filter("kind = 1").join(F.broadcast(edges), (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")))
    border = border.filter((F.col("doc") != F.col("top_doc")) | (F.col("no_doc") != F.col("top_no_doc")))
    inner = found.filter("kind = 0")
    columns = ["doc", "no_doc", "mark", "n_lines", "pos"]
    dropped = inner.select(*columns).unionByName(border.select(*columns))
    per_doc = dropped.groupBy("doc", "no_doc", "mark", "n_lines").agg(F.collect_set("pos").alias("gone"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps, counts = [], []
            for n, gone in zip(b["n_lines"], b["gone"]):
                keep = np.ones(n, np.uint8)
                keep[np.asarray(gone, np.int64)] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
                counts.append(len(gone))
            yield pd.DataFrame({"doc": b["doc"], "no_doc": b["no_doc"], "mark": b["mark"], "n_lines": b["n_lines"], "n_dropped": counts, "bitmap": maps})

    out = per_doc.mapInPandas(pack, "doc long, no_doc boolean, mark long, n_lines int, n_dropped int, bitmap binary")
    out._held = [found]  # to be released when the bitmaps are written
    return out


def bits(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


@F.pandas_udf(StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str | None, m: bytes | None) -> str | None:
        if m is None:
            return None
        lines = (t or "").split("\n")
        return "\n".join(x for x, k in zip(lines, bits(m, len(lines))) if k)

    return pd.Series([one(t, m) for t, m in zip(text, bitmap)], dtype=object)


def drop_shared_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, info: str | None = "lines"
) -> DataFrame:
    """docs with the kept lines as text, and a struct column ``info`` (n_lines, n_dropped, bitmap) unless it is None."""
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    held = maps._held
    maps = materialise(maps.select(*[F.col(c).alias(f"_m_{c}") for c in maps.columns]), "lines-bitmaps")
    release(*held)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.col(id_col).isNull().alias("_n"), F.xxhash64(text_col).alias("_k")
    )
    on = (F.col("_d") == F.col("_m_doc")) & (F.col("_n") == F.col("_m_no_doc")) & (F.col("_k") == F.col("_m_mark"))
    # always by sorted shuffle: the bitmaps grow with the documents, so a broadcast would not last
    out = keyed.join(maps.hint("merge"), on, "left")
    text = F.col("_row")[text_col]
    # texts that keep all lines are not sent to Python
    kept = _kept(F.when(F.col("_m_bitmap").isNotNull(), text), F.col("_m_bitmap"))
    out = out.withColumn("_kept", F.when(F.col("_m_bitmap").isNull(), text).otherwise(kept))
    columns = [(F.col("_kept") if c == text_col else F.col("_row")[c]).alias(c) for c in (docs.columns if info is None else but(docs, info))]
    if info is not None:
        n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))
        columns.append(F.struct(n_lines.alias("n_lines"), F.coalesce("_m_n_dropped", F.lit(0)).alias("n_dropped"), F.col("_m_bitmap").alias("bitmap")).alias(info))
    return out.select(*columns)
