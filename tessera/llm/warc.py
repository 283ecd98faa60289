"""WARC archives of captures, and their index by an external merge of sorted runs.

Writing: payload digests (SHA-1) are pre-aggregated to the capture that keeps its payload (the largest id of equal payloads);
all others become revisit records. Every record is a gzip member of its own, so that a reader can seek to its offset and unpack it
alone. Spark's own text writer writes them, with an empty gzip member as line separator, so that any
file system Spark knows will do; a task begins a new archive after about ``ARCHIVE_BYTES`` (before gzip).

Reading: every archive is read back whole (they are of bounded size), member by member; record lengths and digests are checked.
Its captures, sorted by URL key, time and id, are one run. The runs are cut at common splitters of (URL key, time, id): a
range gets a sorted slice of every run, and a loser tree merges the slices. There are as many ranges as it takes for about ``RANGE_ROWS`` rows each, so a task's memory does not
follow the data. As the id is part of the key, a URL that a third of all captures share spreads
over many ranges. Ranges in order make the global capture history.

Defined results: null payloads are empty; a null id is smaller than all others; rows with equal id and payload share
their record type and are a record each; captures of equal URL key and time go by id; a null url has an empty URL key; a very long payload is one record in an archive
of its own size; other columns are not read, so their names cannot clash; an empty table gives no archive and an empty history.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, shuffle_width

#: Bytes of an archive, about (a longer record makes a longer archive).
ARCHIVE_BYTES = 8 << 20
#: Captures of a merged range, about.
RANGE_ROWS = 100_000
SEPARATOR = b"\r\n\r\n"
#: A gzip member of nothing: between the members that hold records.
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, *[0] * 8])
#: Captures without a date of their own are one second apart from here on.
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
_NO_ID = -(1 << 63)

_INDEX = (
    "url_key string, stamp string, page_id long, url string, payload_digest string, stored_bytes long, record_type string, refers_to long, "
    "archive string, offset long, length long"
)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and sorted query, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(labels))}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _clean(url: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", url or "")


def record(page_id: int | None, url: str | None, stamp: str, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record without the blank lines that end it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + SEPARATOR + block


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of every record; raises ValueError where the bytes are no record."""
    at, end = 0, len(data)
    while at < end:
        cut = data.find(SEPARATOR, at)
        if cut < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:cut].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = cut + len(SEPARATOR)
        stop = start + int(headers["Content-Length"])
        if stop > end or data[stop : stop + 4] != SEPARATOR:
            raise ValueError(f"record at byte {at} does not end where its length says")
        block = data[start:stop]
        yield at, stop + 4 - at, headers, block[block.index(SEPARATOR) + 4 :]
        at = stop + 4


def member(data: bytes) -> bytes:
    """A gzip member of these bytes; equal bytes make equal members."""
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: memoryview, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of every gzip member that holds any."""
    at = 0
    while at < len(data):
        reader, parts, end = zlib.decompressobj(31), [], at
        while not reader.eof:
            if end >= len(data):
                raise ValueError(f"gzip member at byte {at} has no end")
            piece = data[end : end + step]
            parts.append(reader.decompress(piece))
            end += len(piece)
        end -= len(reader.unused_data)
        if unpacked := b"".join(parts):
            yield at, end - at, unpacked
        at = end


class LoserTree:
    """k-way merge: inner nodes hold the losers, so that a new head plays only against those on its path."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.tree[0]]) is not None:
            leaf = self.tree[0]
            yield head
            self.heads[leaf] = next(self.runs[leaf], None)
            winner, node = leaf, (leaf + self.k) // 2
            while node > 0:
                if self._less(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def write_archives(
    pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, min_bytes: int = 0
) -> str:
    """Write one record per row; returns the folder of the archives. Equal payloads of at least min_bytes are kept once."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), (F.col(date_col).cast("timestamp") if date_col else F.lit(None).cast("timestamp")).alias("date")
    )
    keyed = plain.withColumn("hash", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    digests = materialise(keyed.select("page_id", "hash", "size").distinct(), "warc-digests")
    # the map side of the aggregation bounds what one payload sends by the number of tasks
    # and it is written, so that the join's own exchange of a frequent payload can be split
    kept = materialise(digests.filter(F.col("size") >= min_bytes).groupBy("hash").agg(F.max("page_id").alias("kept")), "warc-kept")
    types = digests.join(kept, "hash", "left").select(
        F.coalesce("page_id", F.lit(_NO_ID)).alias("t_id"),
        F.col("hash").alias("t_hash"),
        F.when(F.col("page_id").eqNullSafe(F.col("kept")) | (F.col("size") < min_bytes), None).otherwise(F.col("kept")).alias("refers_to"),
    )
    total, count = digests.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per_archive = max(1, int(ARCHIVE_BYTES * count / max(total + 400 * count, 1)))
    rows = keyed.join(types, (F.coalesce("page_id", F.lit(_NO_ID)) == F.col("t_id")) & (F.col("hash") == F.col("t_hash")))
    rows = rows.select("page_id", "url", "date", "hash", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, date, sha, refers_to, body in zip(*(c.to_pylist() for c in batch.columns)):
                when = date.astimezone(timezone.utc) if date is not None else EPOCH + timedelta(seconds=(page_id or 0) % 10**9)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.append(member(record(page_id, url, when.strftime("%Y-%m-%dT%H:%M:%SZ"), digest, body or b"", refers_to, refers_to is not None) + SEPARATOR))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # bytes pass through a string column as they are; the separator is one byte a character
    records.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", per_archive).option("compression", "none").text(path)
    return path


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives below ``path``, those of one archive sorted; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: None if urn is None or urn.endswith(":none>") else int(urn.rsplit(":", 1)[1][:-1])
        names = [c.split()[0] for c in _INDEX.split(", ")]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, length, unpacked in members(memoryview(data.as_buffer())):
                    ((_, _, h, payload),) = parse_archive(unpacked)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = h["WARC-Type"]
                    if kind == "response" and base32_digest(payload) != digest:
                        raise ValueError(f"{name}: payload at byte {offset} does not match its digest")
                    stamp = re.sub(r"\D", "", h["WARC-Date"])
                    page_id = number(h["WARC-Record-ID"])
                    url = h["WARC-Target-URI"]
                    stored = len(payload) if kind == "response" else None
                    rows.append((url_key(url), stamp, page_id, url, digest, stored, kind, number(h.get("WARC-Refers-To")), name.rsplit("/", 1)[-1], offset, length))
                rows.sort(key=lambda r: (r[0], r[1], _NO_ID if r[2] is None else r[2], r[9]))
                kinds = {"page_id": pa.int64(), "stored_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))], names=names)

    return files.mapInArrow(run, _INDEX)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered history: the runs' rows with history_range and history_pos (ascending within and across ranges)."""
    spark = runs.sparkSession
    runs = materialise(runs, "warc-runs")
    count = runs.count()
    ranges = max(1, -(-count // RANGE_ROWS), min(shuffle_width(spark), count // 2000))
    key = ["url_key", "stamp", F.col("page_id").asc_nulls_first(), "archive", "offset"]
    sliced = runs.repartitionByRange(ranges, *key).sortWithinPartitions("archive", "url_key", "stamp", F.col("page_id").asc_nulls_first(), "offset")
    schema = f"{_INDEX}, history_range int, history_pos long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slices: dict[str, list[pd.DataFrame]] = {}
        for b in batches:
            for name, part in b.groupby("archive", sort=False):
                slices.setdefault(name, []).append(part)
        if not slices:
            return
        whole = pd.concat([x for parts in slices.values() for x in parts], ignore_index=True)
        sizes = [sum(map(len, parts)) for parts in slices.values()]
        ids = whole["page_id"].astype("Int64").fillna(_NO_ID).astype("int64")
        rows = list(zip(whole["url_key"], whole["stamp"], ids.tolist(), whole["archive"], whole["offset"].tolist(), range(len(whole))))
        cursors, first = [], 0
        for n in sizes:
            cursors.append(iter(rows[first : first + n]))
            first += n
        order = [r[-1] for r in LoserTree(cursors)]
        merged = whole.iloc[order].reset_index(drop=True)
        merged["history_range"] = TaskContext.get().partitionId()
        merged["history_pos"] = range(len(merged))
        for a in range(0, len(merged), 10_000):
            yield merged.iloc[a : a + 10_000].astype({"page_id": "Int64", "stored_bytes": "Int64", "refers_to": "Int64"})

    return sliced.mapInPandas(run, schema)


def capture_history(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return their merged index with the full payload's size."""
    path = write_archives(pages, **options)
    history = materialise(merge_runs(read_runs(pages.sparkSession, path)), "warc-history")
    full = history.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("stored_bytes").alias("payload_bytes"))
    full = materialise(full, "warc-sizes")
    return history.join(full, "payload_digest", "left")
