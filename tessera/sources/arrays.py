"""Records of JSON files that are one array each, however large: ranges of a file are read by many tasks.

Spark's text source cuts a file into pieces at ``},`` wherever that stands, so its byte ranges can be read apart, whether there are line ends or not. Which of these cuts (and of
all other commas) part two records of the outer array depends on what comes before: on whether a string is open, and on the depth of brackets. Each range counts its quotes, and its
brackets for both cases; sums over one row for each range give the state at its start. A second pass then cuts every range at commas of depth one; what is left at its borders is put
together from neighbouring ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.batches import PIECE_BYTES, pieces
from ..storage import written

#: Where pieces end.
CUT = b"},"
_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strings that opened or closed up to and with each byte, bracket steps of each byte if no string is open)."""
    quotes = data == _QUOTE
    slashes = np.flatnonzero(data == _BACKSLASH)
    if len(slashes):
        # a quote behind an odd run of backslashes is part of a string
        at = np.flatnonzero(quotes)
        other = np.flatnonzero(np.append(True, np.diff(slashes) != 1))
        starts, ends = slashes[other], slashes[np.append(other[1:], len(slashes)) - 1]
        run = np.searchsorted(ends, at - 1)
        behind = (run < len(ends)) & (ends[np.minimum(run, len(ends) - 1)] == at - 1)
        odd = behind & ((at - starts[np.minimum(run, len(ends) - 1)]) % 2 == 1)
        quotes[at[odd]] = False
    steps = np.zeros(len(data), np.int8)
    steps[(data == ord("[")) | (data == ord("{"))] = 1
    steps[(data == ord("]")) | (data == ord("}"))] = -1
    return np.cumsum(quotes), steps


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, bytes]]:
    """(file, block, rows, bytes) of some rows of one range at a time, in order, or of a part of one long row; columns: value, file, block, and more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes = files.indices.to_numpy()
        edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            for rows in pieces(batch.slice(a, b - a), 0):
                for raw in _parts(_bytes(rows.column(0))):
                    yield files.dictionary[codes[a]].as_py(), int(blocks[a]), rows, raw


def _bytes(column: pa.Array) -> bytes:
    return b"".join(v.as_buffer().to_pybytes() + CUT for v in column)


def _parts(raw: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """raw in parts of some bytes, none of which begins behind a backslash."""
    first = 0
    while first < len(raw):
        end = first + 2 * limit
        while end < len(raw) and raw[end - 1] == _BACKSLASH:
            end += 1
        yield raw[first:end]
        first = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, quotes, closed, open): bracket steps outside strings if none, or one, is open at the start of a part of a range."""
    for file, block, _, raw in _ranges(batches):
        strings, steps = marks(np.frombuffer(raw, np.uint8))
        inside = strings % 2 == 1
        row = [file, block, int(strings[-1]), int(steps[~inside].sum()), int(steps[inside].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([v], pa.int64()) for v in row[1:])], names=["file", "block", "quotes", "closed", "open"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, seq, kind, value): whole records (0), what is before the first cut of a range (1), behind the last (2), or a range without a cut (3).

    Of a range that comes in several parts, what is open at the end of one goes on in the next.
    """
    now: tuple[str, int] | None = None
    rest: list[bytes] = []
    in_string, depth, seq, any_cut = False, 0, 0, False

    def rows(kinds: list[int], values: list[bytes]) -> pa.RecordBatch:
        nonlocal seq
        n = len(kinds)
        columns = [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.binary())]
        seq += n
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "seq", "kind", "value"])

    for file, block, part, raw in _ranges(batches):
        if now != (file, block):
            if now is not None:
                yield rows([2 if any_cut else 3], [b"".join(rest)])
            now, rest, seq, any_cut = (file, block), [], 0, False
            in_string, depth = bool(part.column(3)[0].as_py()), int(part.column(4)[0].as_py())
        data = np.frombuffer(raw, np.uint8)
        strings, steps = marks(data)
        outside = (strings + in_string) % 2 == 0
        level = depth + np.cumsum(np.where(outside, steps, 0))
        # the outer array's own brackets are cuts too: before its first record, and behind its last
        cuts = np.flatnonzero(outside & (((data == _COMMA) & (level == 1)) | ((steps == 1) & (level == 1)) | ((steps == -1) & (level == 0))))
        if len(cuts):
            found = [raw[a:b] for a, b in zip([0, *(cuts[:-1] + 1).tolist()], cuts.tolist())]
            found[0] = b"".join([*rest, found[0]])
            yield rows([0 if any_cut else 1, *[0] * (len(found) - 1)], found)
            rest, any_cut = [raw[cuts[-1] + 1 :]], True
        else:
            rest.append(raw)
        in_string, depth = bool((strings[-1] + in_string) % 2), int(level[-1])
    if now is not None:
        yield rows([2 if any_cut else 3], [b"".join(rest)])


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): the records of files that are one JSON array each, as JSON; (block, seq) is their order in a file.

    An empty array has no records; blanks around records go. A record may be longer than a range. Files that are no arrays give no defined result.
    """
    raw = spark.read.option("lineSep", CUT.decode()).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    counts = raw.mapInArrow(_count, "file string, block long, quotes long, closed long, open long")
    # batches of a range come in order, and keep it by their place in the task
    counts = written(counts.withColumn("place", F.monotonically_increasing_id()), "array-ranges")
    order = Window.partitionBy("file").orderBy("block", "place")  # a row for each batch of a range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    counts = counts.withColumn("steps", F.when(F.col("in_string") == 0, F.col("closed")).otherwise(F.col("open")))
    starts = counts.withColumn("depth", F.coalesce(F.sum("steps").over(before), F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("place")))
    starts = starts.filter("nth = 1").select(F.col("file").alias("_file"), F.col("block").alias("_block"), "in_string", "depth")
    # a row for each range of some 128 MB; the join keeps the order of rows
    known = raw.join(F.broadcast(starts), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select("value", "file", "block", "in_string", "depth")
    cut = written(known.mapInArrow(_cut, "file string, block long, seq long, kind int, value binary"), "array-cuts")
    # what is open at the end of a range goes on at the start of the next: one or two rows for each range
    edges = cut.filter("kind > 0").withColumn("group", F.sum((F.col("kind") == 2).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq")))
    joined = edges.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    joined = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["seq"].alias("seq"), F.aggregate("parts", F.lit("").cast("binary"), lambda s, p: F.concat(s, p["value"])).alias("value"))
    # group 0 is what is before the outer bracket; behind the last one stands the cut that the last piece did not have
    joined = joined.filter("group > 0")
    every = cut.filter("kind = 0").select("file", "block", "seq", "value").unionByName(joined.select("file", "block", "seq", "value"))
    text = every.withColumn("value", F.btrim(F.col("value").cast("string"), F.lit(" \t\r\n")))
    return text.filter((F.col("value") != "") & (F.col("value") != CUT.decode()))


def read_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that are one JSON array each, parsed."""
    return array_records(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
