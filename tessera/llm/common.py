"""Shared pieces of the corpus operators: scratch tables and text kernels.

The kernels work on the bytes of a whole Arrow column at once (numpy, no loop
over characters), so that a Python task costs little more than a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..storage import release, scratch_path, written  # noqa: F401

#: Bytes of text that a kernel holds at once (one longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


#: Spark's own setting: shuffle files go when the query that made them has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``storage.written``, without the shuffle files of what was written: they are of no use once the table is there."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return written(df, name, codec)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def with_field(df: DataFrame, name: str, ddl: str) -> StructType:
    """Schema of df without a column of that name (in any case of letters), and with it at the end."""
    return StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + StructType.fromDDL(f"`{name}` {ddl}").fields)


def but(df: DataFrame, *names: str) -> list[str]:
    """Columns of df without those of these names; Spark tells names apart without regard to case, and so does this."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def by_place(df: DataFrame) -> DataFrame:
    """df with columns named by their places, for Python batches: other names may hold dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def as_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 16), 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of all texts, in order."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order and do not overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    values *= _powers(int(lengths.max()))[place]
    sums = np.add.reduceat(values, first)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_per_text(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Borders into the list of words: words[b[i]:b[i+1]] are those of text i."""
    return np.searchsorted(starts, offsets, "left")


SHINGLE_WORDS = 5
_TERMS = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, one per start; the array is n - 4 long (empty if n < 5)."""
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        total += words[k : k + n] * _TERMS[k]
    return mix64(total)


def short_hash(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with one to four words: its whole sequence."""
    n = len(words)
    return mix64((words * _TERMS[:n]).sum(dtype=np.uint64, keepdims=True) + np.full(1, n, np.uint64) * np.uint64(0xA0761D6478BD642F))


def short_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """``short_hash`` of every run of so many words, one per start."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, size, np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(size):
        total += words[k : k + n] * _TERMS[k]
    return mix64(total)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a column, in order."""
    for first, end, data, offsets in as_chunks(column):
        data = lower_ascii(data)
        starts, ends = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        borders = words_per_text(offsets, starts)
        every = shingle_hashes(words)
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                yield np.unique(every[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                yield short_hash(words[a:b])
            else:
                yield every[:0]
