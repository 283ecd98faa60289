"""Removal of repeated passages: every byte of a ``length``-byte string that also starts earlier, by bucket-pointer refinement.

The strings are the suffixes of all texts, cut at ``length`` bytes; two are equal if refinement leaves them in one bucket.

1. Buckets of q-grams. Of the q-grams that start in a string (q = 2/5 of its length) the one with the smallest hash names the string's first bucket;
   neighbouring strings mostly share it, so a text has one row (a *cell*: the strings lo..hi that one q-gram at ``a`` names) for about thirty bytes.
   Equal strings have the same q-gram at the same place. Buckets of one cell leave here, which is most of them.
2. Cells of a bucket with the same bytes all around are one: their strings are all repeated, but in the first of them.
3. Buckets of different cells are refined in tasks (``refine``): identifiers of the 8-byte grams at later offsets are ranks; a pair of neighbouring
   identifiers is ranked anew for twice the bytes, and those ranks are used for the next doubling, until one identifier orders all suffixes of the bucket. The
   same is done leftwards, and the depth of common bytes between neighbours of both orders gives the class of each single string.
4. Buckets of more than ``MOST`` different cells are not held in one task: their strings are rows, grouped by (q-gram, place, 128-bit hash of the
   string) with the first of each group found by partial aggregation.

Texts are shuffled whole under their own key (id and hash), which no two different texts share; copies of a text are found by hash before anything else.

Defined results: a null or empty text has no bytes and loses none; a null id counts as the smallest long; rows with equal id and text are one document and
get the same result; different texts of one id are ordered by their hash; ties do not exist beyond that; very long texts are cut into blocks and judged whole;
an empty table gives an empty result; an input column named like ``info``, in any case of letters, is replaced, other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import as_chunks, but, materialise, mix64, release, shuffle_width

#: Different cells of a bucket that one task holds.
MOST = 2048
#: Cells that are refined at once, about, and bytes of text whose windows are formed at once.
CHUNK_CELLS, BLOCK = 16_384, 1 << 21
_PLACE = np.uint64((1 << 22) - 1)  # of a position in a block with what overlaps it
_SMALLEST = -(1 << 63)
_CELL = "gram long, id long, mark long, at long"


def _gram(length: int) -> int:
    return max(1, length * 2 // 5)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the bytes i..i+size-1 for every i, by doubling."""
    out, have = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    while have < size and len(out):
        step = min(have, size - have)
        if len(out) <= step:
            return out[:0]
        left, right = out[:-step], out[step:]
        out = left * np.uint64(0xBF58476D1CE4E5B9)
        out ^= right + (left >> np.uint64(31))
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
        have += step
    return out


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i..i+width-1] for every i, from running minima of whole blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def cells(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, a - lo, hi - lo, gram) of all cells; text: index of the text, lo: byte in it."""
    gram = _gram(length)
    n, found = len(data), []
    step = np.zeros(n + 1, np.int32)
    long_ = np.flatnonzero(np.diff(offsets) >= length)
    step[offsets[long_]] += 1
    step[offsets[long_ + 1] - length + 1] -= 1
    inside = np.cumsum(step[:n]) > 0
    for s in range(0, max(0, n - length + 1), BLOCK):
        piece = data[s : s + BLOCK + length - 1]
        hashes = gram_hashes(piece, gram)
        # the smaller hash, then the earlier place: the same choice for equal strings wherever they stand
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        least = window_minima(keys, length - gram + 1)
        ok = inside[s : s + len(least)]
        new, last = ok.copy(), ok.copy()
        same = (least[1:] == least[:-1]) & ok[1:] & ok[:-1]
        new[1:] &= ~same
        last[:-1] &= ~same
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        a = (least[lo] & _PLACE).astype(np.int64)
        text = np.searchsorted(offsets, lo + s, "right") - 1
        found.append((text, lo + s - offsets[text], a - lo, hi - lo, hashes[a].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(lo: np.ndarray, left: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (lo << 24) | (left << 12) | span


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 12) & 4095, at & 4095


def _sampled(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, _, data, offsets in as_chunks(batch.column(2)):
                text, lo, left, span, gram = cells(data, offsets, length)
                own = first + text
                columns = [gram, ids[own], marks[own], _pack(lo, left, span)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "id", "mark", "at"])

    return run


def _surroundings(length: int):
    """The bytes of each cell (all of its strings together), cut out of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            borders, flat = lists.offsets.to_numpy(), lists.flatten()
            base = int(borders[0])
            grams, ats = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for first, end, data, offsets in as_chunks(batch.column(2)):
                x, y = int(borders[first]) - base, int(borders[end]) - base
                text = np.repeat(np.arange(end - first), np.diff(borders[first : end + 1]))
                lo, _, span = _unpack(ats[x:y])
                sizes = span + length
                # a slice of cells at a time: their bytes overlap, so together they may be several times the text
                for k in range(0, y - x, 1 << 15):
                    n = sizes[k : k + (1 << 15)]
                    ends = np.cumsum(n)
                    place = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
                    body = data[np.repeat(offsets[text[k : k + len(n)]] + lo[k : k + len(n)], n) + place]
                    held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(body)])
                    own = first + text[k : k + len(n)]
                    columns = [pa.array(c) for c in (grams[x + k : x + k + len(n)], ids[own], marks[own], ats[x + k : x + k + len(n)])]
                    yield pa.RecordBatch.from_arrays([*columns, held], names=["gram", "id", "mark", "at", "bytes"])

    return run


def refine(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (bytes, a multiple of 8 wide) within their buckets, and the bytes each has in common with the one before it (-1: other bucket)."""
    pointers = np.unique(rows.view(">u8").astype(np.uint64), return_inverse=True)[1].reshape(len(rows), -1)
    while pointers.shape[1] > 1:
        if pointers.shape[1] % 2:
            pointers = np.concatenate([pointers, np.zeros((len(rows), 1), pointers.dtype)], axis=1)
        pairs = pointers[:, 0::2].astype(np.uint64) * np.uint64(pointers.max() + 1) + pointers[:, 1::2].astype(np.uint64)
        pointers = np.unique(pairs, return_inverse=True)[1].reshape(pairs.shape)
    order = np.lexsort((pointers[:, 0], bucket))
    common = np.full(len(rows), -1, np.int64)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(bucket[a] == bucket[b])
    differ = rows[a[near]] != rows[b[near]]
    common[near + 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def _side(flat: np.ndarray, at: np.ndarray, counts: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``counts`` bytes from ``at`` on, forwards or backwards, filled with zeros."""
    out = np.zeros((len(at), -(-max(width, 1) // 8) * 8), np.uint8)
    place = np.arange(out.shape[1])
    real = place[None, :] < counts[:, None]
    spots = at[:, None] + step * place[None, :]
    out[real] = flat[spots[real]]
    return out


def repeated(bucket: np.ndarray, at: np.ndarray, flat: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of runs of strings that an earlier row of the bucket has at the same place. Rows are in the order of their documents."""
    _, left, span = _unpack(at)
    window = length - _gram(length) + 1
    anchor = first + left
    right_order, right = refine(bucket, _side(flat, anchor, span + length - left, length, 1))
    left_order, leftward = refine(bucket, _side(flat, anchor - 1, left, window - 1, -1))
    n = len(at)
    names, others = np.empty(n, np.int64), np.empty(n, np.int64)
    rows_, places = [], []
    for o in range(window):
        own = np.flatnonzero((left >= o) & (left - span <= o))
        if len(own) < 2:
            continue
        names[right_order] = np.cumsum(right < length - o)
        others[left_order] = np.cumsum(leftward < o)
        classes = names[own] * (n + 1) + others[own]
        again = np.ones(len(own), bool)
        again[np.unique(classes, return_index=True)[1]] = False
        rows_.append(own[again])
        places.append(left[own[again]] - o)
    if not rows_:
        return (np.zeros(0, np.int64),) * 3
    row, place = np.concatenate(rows_), np.concatenate(places)
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row)) - 1 if len(row) else starts
    return row[starts], place[starts], place[ends] + length


def _refined(length: int):
    names = ["id", "mark", "start", "end"]

    def judge(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        gram, ids, marks, at = (table.column(c).to_numpy() for c in ("gram", "id", "mark", "at"))
        data = table.column("bytes").chunk(0)
        _, offsets, flat = data.buffers()
        first = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data)].astype(np.int64)
        bucket = np.cumsum(np.append(False, gram[1:] != gram[:-1]))
        row, start, end = repeated(bucket, at, np.frombuffer(flat, np.uint8), first, length)
        lo = at[row] >> 24
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[row], marks[row], lo + start, lo + end)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, count = [*held, batch], count + batch.num_rows
            if count >= CHUNK_CELLS:
                # whole buckets only; the last may go on in the next batch
                gram = batch.column(0).to_numpy()
                other = np.flatnonzero(gram != gram[-1])
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from judge([*held[:-1], batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    count = batch.num_rows - cut
        if held:
            yield from judge(held)

    return run


def _first() -> Column:
    return F.min(F.struct("id", "mark", "at")).alias("first")


def repeats(texts: DataFrame, length: int = 100) -> DataFrame:
    """(id, mark, start, end): runs of bytes to remove, some overlapping. texts: id, mark, text; no two rows with the same id and mark but different texts."""
    if not 8 <= length <= 4096:
        raise ValueError("length must be from 8 to 4096 bytes")
    spark = texts.sparkSession
    width = shuffle_width(spark)
    all_cells = materialise(texts.mapInArrow(_sampled(length), _CELL), "suffix-cells")
    shared = materialise(all_cells.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "suffix-buckets")
    kept = materialise(all_cells.join(shared.hint("merge"), "gram", "left_semi"), "suffix-shared")
    release(all_cells, shared)
    lists = kept.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("gram", "at")).alias("cells"))
    met = texts.join(lists.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("id", "mark", "text", "cells")
    around = met.mapInArrow(_surroundings(length), f"{_CELL}, bytes binary")
    around = materialise(around.withColumn("c1", F.xxhash64("bytes", F.col("at") % (1 << 24))).withColumn("c2", F.xxhash64(F.lit(7), "bytes", F.col("at") % (1 << 24))), "suffix-around")
    release(kept)
    same = ["gram", "c1", "c2"]
    firsts = materialise(around.groupBy(*same).agg(_first(), F.first("bytes").alias("bytes"), F.count("*").alias("n")), "suffix-firsts")
    # strings of cells that an earlier cell equals as a whole
    lo, span = F.shiftright("at", 24), F.col("at").bitwiseAND(4095)
    copied = firsts.filter("n > 1").select(*same, "first")
    whole = around.select(*same, "id", "mark", "at").join(copied.hint("merge"), same).filter(F.struct("id", "mark", "at") != F.col("first"))
    held = [around, firsts]
    found = [whole.select("id", "mark", lo.alias("start"), (lo + span + length).alias("end"))]
    # different cells of one bucket
    sizes = materialise(firsts.groupBy("gram").agg(F.count("*").alias("cells")).filter("cells > 1"), "suffix-sizes")
    several = firsts.join(sizes.hint("merge"), "gram").select("gram", "first.*", "bytes", "cells")
    light = several.filter(F.col("cells") <= MOST).drop("cells").repartition(width, "gram").sortWithinPartitions("gram", "id", "mark", "at")
    found.append(light.mapInArrow(_refined(length), "id long, mark long, start long, end long"))
    if sizes.filter(F.col("cells") > MOST).limit(1).count():
        heavy = several.filter(F.col("cells") > MOST)
        own = F.shiftright("at", 12).bitwiseAND(4095)
        strings = heavy.select("gram", "id", "mark", "bytes", lo.alias("lo"), own.alias("left"), F.explode(F.sequence(F.lit(0), span.cast("int"))).alias("j"))
        string = F.substring("bytes", F.col("j") + 1, F.lit(length))
        strings = strings.select("gram", (F.col("left") - F.col("j")).alias("o"), F.xxhash64(string).alias("s1"), F.xxhash64(F.lit(7), string).alias("s2"), "id", "mark", (F.col("lo") + F.col("j")).alias("p"))
        strings = materialise(strings, "suffix-strings")
        key = ["gram", "o", "s1", "s2"]
        lead = strings.groupBy(*key).agg(F.min(F.struct("id", "mark", "p")).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
        lead = materialise(lead, "suffix-leads")
        held += [strings, lead]
        later = strings.join(lead.hint("merge"), key).filter(F.struct("id", "mark", "p") != F.col("lead"))
        found.append(later.select("id", "mark", F.col("p").alias("start"), (F.col("p") + length).alias("end")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out._held = [*held, sizes]  # to be released when the runs are written
    return out


_CUT = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("spans", ArrayType(LongType())), StructField("kept", BinaryType())])


@F.pandas_udf(_CUT)
def _cut(text: pd.Series, runs: pd.Series, whole: pd.Series) -> pd.DataFrame:
    removed, counts, spans, kept = [], [], [], []
    for t, packed, all_ in zip(text, runs, whole):
        data = (t or "").encode()
        if all_:
            pairs = np.array([[0, len(data)]], np.int64)
        else:
            x = np.sort(np.asarray(packed, np.int64))
            start = x >> 24
            end = np.maximum.accumulate(start + (x & ((1 << 24) - 1)))
            new = np.append(True, start[1:] > end[:-1])
            first = np.flatnonzero(new)
            pairs = np.stack([start[first], end[np.append(first[1:], len(x)) - 1]], axis=1)
        removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
        counts.append(len(pairs))
        spans.append(pairs.ravel())
        edges = np.concatenate([[0], pairs.ravel(), [len(data)]])
        kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist())))
    return pd.DataFrame({"n_removed": removed, "n_spans": counts, "spans": spans, "kept": kept})


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, info: str = "repeats") -> DataFrame:
    """docs with a struct column ``info``: n_bytes, n_removed, n_spans, spans (start and end of every removed run, one after the other) and kept (the remaining bytes)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_SMALLEST)).alias("id"), F.xxhash64(text).alias("mark"), F.xxhash64(F.lit(7), text).alias("mark2")]
    texts = docs.select(*key, text.alias("text")).filter(F.octet_length("text") >= length)
    marks = ["mark", "mark2"]
    # of equal texts, those of larger ids are copies as a whole
    groups = texts.groupBy(*marks).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    groups = materialise(groups.select(*marks, "least"), "suffix-groups")
    # written before rows with equal id and text are put together, so that the join's exchange of a text with many copies can be split
    copied = materialise(texts.select("id", *marks).join(groups.hint("merge"), marks).filter("id > least").select("id", *marks), "suffix-copied")
    copies = materialise(copied.distinct(), "suffix-copies")
    release(copied)
    single = texts.join(copies.hint("merge"), ["id", *marks], "left_anti").select("id", "mark", "text")
    runs = repeats(single, length)
    packed = F.shiftleft("start", 24).bitwiseOR(F.col("end") - F.col("start"))
    held = runs._held
    runs = runs.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(packed).alias("_runs"))
    runs = runs.withColumn("_whole", F.lit(False)).unionByName(copies.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.array().cast("array<long>").alias("_runs"), F.lit(True).alias("_whole")))
    runs = materialise(runs, "suffix-runs")
    release(groups, copies, *held)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key[:2], text.alias("_text"))
    out = keyed.join(runs.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    hit = F.col("_runs").isNotNull()
    # texts that lose nothing are not sent to Python
    out = out.withColumn("_cut", F.when(hit, _cut(F.when(hit, F.col("_text")), F.coalesce("_runs", F.array().cast("array<long>")), F.coalesce("_whole", F.lit(True)))))
    fields = [F.octet_length("_text").cast("long").alias("n_bytes")]
    fields += [F.coalesce(F.col("_cut")[c], F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    fields += [F.coalesce(F.col("_cut")["spans"], F.array().cast("array<long>")).alias("spans"), F.coalesce(F.col("_cut")["kept"], F.col("_text").cast("binary")).alias("kept")]
    return out.select(*[F.col("_row")[c].alias(c) for c in but(docs, info)], F.struct(*fields).alias(info))
