"""An inverted index that is kept up to date: segments of postings with deletion bitmaps, statistics as sums, merges by size tiers.

An index is a folder of immutable tables and a list of them, written anew with every change; a change counts from the moment its list is there whole, so a job that dies leaves
tables that no list names, and the index as it was.

    docs-*      segment, number, doc_id, dl, tokens    documents of a segment, numbered along
    postings-*  segment, term, numbers, tfs, dls       sorted by term; a row for each term of some thousand documents
    gone-*      segment, bucket, bits                  numbers that were deleted later, a bitmap for 32,768 of them (Spark's bitmap functions)
    terms-*     term, df                               documents that hold a term; negative rows for those deleted
    sums-*      n, length                              documents and their lengths together; negative rows too

Upserts write a segment, and bitmaps for the documents that it replaces. When ``fanout`` segments are of one size tier, their documents are read without what is deleted and written as
one. Documents keep their tokens, so nothing but lists is shuffled to make a segment, and the terms of deleted documents come from their own rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, written
from .index import idf, tokenised
from .changes import changed_keys

#: Tokens whose documents a task inverts at once (one longer document is met alone); files that may share a term's lists.
LIST_TOKENS, SALTS = 1 << 20, 8


@dataclass
class Segment:
    """Names of its tables, its documents when it was written, and those deleted since."""

    name: str
    docs: int
    deleted: int = 0
    gone: list[str] = field(default_factory=list)


def _is_set(bits: Column, number: Column) -> Column:
    """Whether the bit of a number is set in the bitmap of its bucket; no bitmap, no bit."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, numbers, tfs, dls) of (number, dl, tokens), some documents at a time: the lists of a term are ascending numbers, and what stands beside them."""
    for batch in batches:
        tokens = batch.column(2)
        ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + LIST_TOKENS, "right")))
            part = tokens.slice(first, end - first)
            coded = part.flatten().dictionary_encode()
            if len(coded):
                n = end - first
                rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends[first:end], prepend=before))
                met, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * n + rows, return_counts=True)
                borders = pa.array(np.searchsorted(met, np.arange(len(coded.dictionary) + 1) * n), pa.int32())
                own = pa.array(met % n + first)
                lists = [batch.column(0).take(own), pa.array(tfs, pa.int32()), batch.column(1).take(own)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.ListArray.from_arrays(borders, x) for x in lists)], names=["term", "numbers", "tfs", "dls"])
            first = end


class SegmentedIndex:
    """An index below ``path``. One writer at a time; readers see the list that they found."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.turn, self.epoch, self.segments, self.stats = 0, -1, [], []
        self._read()

    # -- the list of tables

    def _read(self) -> None:
        listing = f"{self.path}/lists"
        if not exists(self.spark, listing):
            return
        at = self.spark._jvm.org.apache.hadoop.fs.Path(listing)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        turns = sorted((int(f.getPath().getName()) for f in found), reverse=True)
        self.turn = max([0, *turns])  # unfinished ones are not written again
        for turn in turns:
            if exists(self.spark, f"{listing}/{turn}/_SUCCESS"):
                about = json.loads(self.spark.read.text(f"{listing}/{turn}").first()[0])
                self.epoch, self.stats = about["epoch"], about["stats"]
                self.segments = [Segment(**s) for s in about["segments"]]
                return

    def _commit(self, segments: list[Segment], stats: list[str], epoch: int | None = None) -> None:
        about = {"epoch": self.epoch if epoch is None else epoch, "stats": stats, "segments": [vars(s) for s in segments]}
        self.turn += 1
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{self.path}/lists/{self.turn}")
        self.epoch, self.stats, self.segments = about["epoch"], stats, segments

    # -- tables

    def _table(self, kind: str, names: list[str]) -> DataFrame:
        if not names:
            raise ValueError("the index holds no documents")
        return self.spark.read.parquet(*[f"{self.path}/{kind}-{n}" for n in names])

    def _bitmaps(self, segments: list[Segment]) -> DataFrame | None:
        """One bitmap for each segment and bucket that lost a document."""
        names = [n for s in segments for n in s.gone]
        if not names:
            return None
        wanted = F.col("segment").isin([s.name for s in segments])
        return self._table("gone", sorted(set(names))).filter(wanted).groupBy("segment", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _live(self, kind: str, segments: list[Segment], rows: DataFrame | None = None) -> DataFrame:
        """Rows of the segments' tables whose documents are not deleted."""
        rows = self._table(kind, [s.name for s in segments]) if rows is None else rows
        bits = self._bitmaps(segments)
        if bits is None:
            return rows
        rows = rows.withColumn("bucket", F.bitmap_bucket_number("number"))
        return rows.join(bits, ["segment", "bucket"], "left").filter(~_is_set(F.col("bits"), F.col("number"))).drop("bucket", "bits")

    def _write_segment(self, name: str, tokens: DataFrame) -> Segment:
        """tokens: doc_id, tokens, dl, one row for each doc_id."""
        # numbers without gaps that matter: a bitmap bucket is kept only where a bit is set
        docs = tokens.select(F.lit(name).alias("segment"), F.monotonically_increasing_id().alias("number"), "doc_id", "dl", "tokens")
        docs.write.option("compression", "zstd").parquet(f"{self.path}/docs-{name}")
        docs = self._table("docs", [name])
        lists = docs.select("number", "dl", "tokens").mapInArrow(_inverted, "term string, numbers array<long>, tfs array<int>, dls array<int>")
        # a term that most documents hold goes to several files
        lists = lists.repartition("term", F.spark_partition_id() % SALTS).sortWithinPartitions("term")
        lists.select(F.lit(name).alias("segment"), "term", "numbers", "tfs", "dls").write.option("compression", "zstd").parquet(f"{self.path}/postings-{name}")
        return Segment(name, docs.count())

    def _write_stats(self, name: str, terms: DataFrame, docs: DataFrame, sign: int) -> None:
        """terms: term, n, how many documents each row counts for."""
        terms.groupBy("term").agg((F.sum("n") * sign).alias("df")).write.parquet(f"{self.path}/terms-{name}")
        docs.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("length")).write.parquet(f"{self.path}/sums-{name}")

    # -- changes

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, *, doc_id: str = "doc_id", text_col: str = "text", epoch: int | None = None) -> None:
        """Documents of ``upserts`` replace those of their ids or are new; those of ``deletes`` go, unless they are upserted. Rows without an id are left out; of rows with equal ids the largest text counts.

        epoch: of a stream's batch; one that the index has applied already is left out.
        """
        if epoch is not None and epoch <= self.epoch:
            return
        name = uuid.uuid4().hex
        ids, new = [], None
        if upserts is not None:
            last = upserts.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(text_col).alias("text"))
            new = self._write_segment(name, tokenised(last))
            ids.append(self._table("docs", [name]).select("doc_id"))
        if deletes is not None:
            ids.append(deletes.select(F.col(doc_id).alias("doc_id")))
        gone = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        segments, stats = [Segment(**vars(s)) for s in self.segments], list(self.stats)
        if segments:
            gone = gone.distinct().withColumnRenamed("doc_id", "_id")
            there = self._live("docs", segments).select("segment", "number", "doc_id", "dl")
            lost = written(there.join(gone, F.col("doc_id") == F.col("_id"), "left_semi"), "segment-lost")
            counts = {r["segment"]: r["n"] for r in lost.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
            if counts:
                bits = lost.groupBy("segment", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
                bits.write.parquet(f"{self.path}/gone-{name}")
                hit = [s for s in segments if s.name in counts]
                docs = self._table("docs", [s.name for s in hit]).withColumn("bucket", F.bitmap_bucket_number("number"))
                docs = docs.join(self._table("gone", [name]), ["segment", "bucket"]).filter(_is_set(F.col("bits"), F.col("number")))
                self._write_stats(f"{name}-gone", docs.select(F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("n")), lost, -1)
                stats.append(f"{name}-gone")
                for s in hit:
                    s.gone, s.deleted = [*s.gone, name], s.deleted + counts[s.name]
        if new is not None:
            segments.append(new)
            self._write_stats(name, self._table("postings", [name]).select("term", F.size("numbers").alias("n")), self._table("docs", [name]), 1)
            stats.append(name)
        self._commit([s for s in segments if s.deleted < s.docs], stats, epoch)

    def merge(self) -> int:
        """Merge segments of a tier (powers of ``fanout`` of live documents) wherever there are ``fanout`` of them, until there are not; the number of merges."""
        done = 0
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in self.segments:
                tier, size = 0, max(1, s.docs - s.deleted)
                while size >= self.fanout:
                    tier, size = tier + 1, size // self.fanout
                tiers.setdefault(tier, []).append(s)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return done
            self._merged(tiers[full])
            done += 1

    def _merged(self, old: list[Segment]) -> None:
        name = uuid.uuid4().hex
        new = self._write_segment(name, self._live("docs", old).select("doc_id", "tokens", "dl"))
        stats = self.stats
        if len(stats) > self.fanout * 4:
            # many small sums become one
            self.term_counts().write.parquet(f"{self.path}/terms-{name}-sum")
            self._table("sums", stats).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).write.parquet(f"{self.path}/sums-{name}-sum")
            stats = [f"{name}-sum"]
        dropped = {s.name for s in old}
        self._commit([*[s for s in self.segments if s.name not in dropped], new], stats)

    def follow(self, before: DataFrame, after: DataFrame, *, epoch: int | None = None) -> None:
        """Index the current text of every key whose version moved from before to after (tables of ``changes.add_versions``); keys are the documents' ids."""
        moved = after.join(changed_keys(before, after), "key", "left_semi")
        current = moved.groupBy("key").agg(F.max_by("text", "version").alias("text"))
        self.apply(current.withColumnRenamed("key", "doc_id"), epoch=epoch)

    # -- reading

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(doc_id, term, tf, dl) of the documents that are there; terms: only these."""
        rows = self._table("postings", [s.name for s in self.segments])
        if terms is not None:
            rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
        rows = rows.select("segment", "term", F.explode(F.arrays_zip("numbers", "tfs", "dls")).alias("p"))
        rows = rows.select("segment", "term", F.col("p.numbers").alias("number"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))
        docs = self._table("docs", [s.name for s in self.segments]).select("segment", "number", "doc_id")
        return self._live("postings", self.segments, rows).join(docs, ["segment", "number"]).select("doc_id", "term", "tf", "dl")

    def corpus_stats(self) -> DataFrame:
        """One row: n, avgdl."""
        return self._table("sums", self.stats).agg(F.sum("n").alias("n"), (F.sum("length") / F.greatest(F.sum("n"), F.lit(1))).alias("avgdl"))

    def term_counts(self) -> DataFrame:
        return self._table("terms", self.stats).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def term_stats(self) -> DataFrame:
        """(term, df, idf)"""
        return self.term_counts().crossJoin(F.broadcast(self.corpus_stats())).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row

