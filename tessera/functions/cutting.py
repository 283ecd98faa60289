"""Texts cut into search tokens (``text.search_tokens``) where they lie in an Arrow batch: runs of bytes that are found by arithmetic on whole columns, not by a regular expression for each text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of a character by its first byte.
_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:], _WIDTH[0xE0:], _WIDTH[0xF0:] = 2, 3, 4
_LAST = 0x10FFFF


@lru_cache(maxsize=1)
def token_characters(spark: SparkSession) -> np.ndarray:
    """Of each code point, whether it is part of a token: asked of Spark, so that both ways go by one table of characters."""
    points = spark.range(_LAST + 1).filter(~F.col("id").between(0xD800, 0xDFFF))
    held = points.filter(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").rlike(r"[\p{L}\p{N}_]"))
    out = np.zeros(_LAST + 1, bool)
    out[held.toArrow().column("id").to_numpy()] = True
    return out


def cut(texts: pa.Array, held: np.ndarray) -> tuple[pa.LargeListArray, pa.Array]:
    """(runs, n): the bytes of each text (lower-case strings) as runs of token characters in turn with runs of others, without a copy; and its number of tokens, runs of two characters or more.

    held: of ``token_characters``. A null text has no runs, and null as number.
    """
    known = texts.is_valid()
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    own = held[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        width = _WIDTH[data[lead]]
        code = data[lead] & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.int64)[width]
        for i in (1, 2, 3):
            at = np.minimum(lead + i, len(data) - 1)
            code = np.where(width > i, code << 6 | data[at] & 0x3F, code)
        part = held[np.minimum(code, _LAST)]
        own[lead] = part
        for i in (1, 2, 3):
            more = (width > i) & (lead + i < len(data))
            own[lead[more] + i] = part[more]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = own[1:] != own[:-1]
    edge[ends] = True
    at = np.flatnonzero(edge)
    first = np.searchsorted(at, ends)
    start = at[:-1]
    token = own[start] & (at[1:] - start > _WIDTH[data[start]])
    before = np.append(0, np.cumsum(token))
    runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data))
    n = pa.array((before[first[1:]] - before[first[:-1]]).astype(np.int32), mask=~known.to_numpy(zero_copy_only=False))
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), runs), n
