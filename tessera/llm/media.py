"""Media columns: storing payloads as media, sniffing types by signature, carving embedded media.

An Aho-Corasick automaton finds all magic byte strings of a value in one pass. A hit counts only if the format's validator can walk the
structure from there (chunk checksums, sizes, trailers) and so knows the length; that corrects declared types and
gives the exact bytes of media inside media.

Defined results: a null or empty value has no type and nothing embedded; a value that no validator accepts at its first byte keeps its
declared type and is marked unconfirmed; of media that begin at one byte the longest comes first; a null text is stored as an empty one; a very long
value is read whole (a column's value is below 2 GB, so that sizes fit their 32-bit fields); equal texts and repeated rows give equal results; an empty table
gives an empty table; further columns are kept by ``sniff_media``, whatever their names (an input column named like the output, in any case of letters, is replaced).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import but, by_place, materialise, with_field

#: Payloads are padded to rows of so many samples.
ROW = 576


# -- formats ---------------------------------------------------------------------------------------------------


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


_GREYS = b"".join(bytes([i, i, i, 0]) for i in range(256))


def to_bmp(samples: bytes) -> bytes:
    """8-bit greys, one row of ROW samples after the other (rows top down)."""
    start = 14 + 40 + len(_GREYS)
    head = struct.pack("<2sIHHI", b"BM", start + len(samples), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, ROW, -(len(samples) // ROW), 1, 8, 0, len(samples), 2835, 2835, 256, 0) + _GREYS + samples


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    rows = len(samples) // ROW
    raw = b"".join(b"\0" + samples[r * ROW : (r + 1) * ROW] for r in range(rows))
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_media(kind: str, data: bytes) -> tuple[bytes, str]:
    """8-bit samples of a stored payload, and its shape."""
    if kind == "audio/wav":
        at = 12
        while data[at : at + 4] != b"data":
            at += 8 + struct.unpack_from("<I", data, at + 4)[0] + struct.unpack_from("<I", data, at + 4)[0] % 2
        size = struct.unpack_from("<I", data, at + 4)[0]
        return data[at + 8 : at + 8 + size], f"{size}@{struct.unpack_from('<I', data, 24)[0]}Hz"
    if kind == "image/bmp":
        start, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18)
        stride, rows = (width + 3) // 4 * 4, abs(height)
        lines = [data[start + r * stride : start + r * stride + width] for r in (range(rows) if height < 0 else range(rows - 1, -1, -1))]
        return b"".join(lines), f"{width}x{rows}"
    if kind == "image/png":
        at, packed = 8, []
        while at < len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            if name == b"IHDR":
                width, height = struct.unpack_from(">II", data, at + 8)
            elif name == b"IDAT":
                packed.append(data[at + 8 : at + 8 + size])
            at += 12 + size
        raw = zlib.decompress(b"".join(packed))
        if any(raw[r * (width + 1)] for r in range(height)):
            raise ValueError("only unfiltered rows are stored here")
        return b"".join(raw[r * (width + 1) + 1 : (r + 1) * (width + 1)] for r in range(height)), f"{width}x{height}"
    raise ValueError(f"no samples in {kind}")


# -- validators: (bytes, offset, end markers) to length, or 0 ---------------------------------------------------------------


def _png(d: bytes, at: int, marks: Marks) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, p)
        end = p + 12 + size
        if end > len(d) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(d[p + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def _gif(d: bytes, at: int, marks: Marks) -> int:
    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    if at + 13 > len(d):
        return 0
    p = at + 13 + (3 << (1 + (d[at + 10] & 7)) if d[at + 10] & 0x80 else 0)
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p += 10 + (3 << (1 + (d[p + 9] & 7)) if d[p + 9] & 0x80 else 0)
            p = blocks(p + 1)
        else:
            return 0
    return 0


def _jpeg(d: bytes, at: int, marks: Marks) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind, size = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if kind in (0x00, 0xFF, 0xD8) or size < 2:
            return 0
        p += 2 + size
        if kind == 0xDA:
            end = marks.after(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def _wav(d: bytes, at: int, marks: Marks) -> int:
    if at + 12 > len(d) or d[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return 0
    p, seen = at + 12, []
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", d, p)
        seen.append(kind)
        p += 8 + size + size % 2
    return end - at if p == end and b"fmt " in seen and b"data" in seen else 0


def _bmp(d: bytes, at: int, marks: Marks) -> int:
    if at + 54 > len(d):
        return 0
    total, spare, start, head, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", d, at + 2)
    if spare or planes != 1 or head not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0 or start < 14 + head:
        return 0
    if at + total > len(d) or (packing == 0 and total < start + (width * bits + 31) // 32 * 4 * abs(height)):
        return 0
    return total


class Marks:
    """End markers of a value, each kind found once for all hits, so that many hits cost no further passes."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places: dict[bytes, list[int]] = {}

    def all(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            found, at = [], self.data.find(mark)
            while at >= 0:
                found.append(at)
                at = self.data.find(mark, at + 1)
            self.places[mark] = found
        return self.places[mark]

    def after(self, mark: bytes, at: int) -> int:
        """First place of the mark from ``at`` on, or -1."""
        found = self.all(mark)
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    @cached_property
    def archives(self) -> dict[int, int]:
        """Archive's first byte to its length, from the end records; of several ends the first counts."""
        d, out = self.data, {}
        for p in self.all(b"PK\x05\x06"):
            if p + 22 <= len(d):
                size, start, note = struct.unpack_from("<IIH", d, p + 12)
                at = p - size - start
                if at >= 0 and d[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    out.setdefault(at, min(len(d), p + 22 + note) - at)
        return out


_PDF_TAIL, _PDF_TABLE = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF"), re.compile(rb"xref|\d+\s+\d+\s+obj")


def _pdf(d: bytes, at: int, marks: Marks) -> int:
    """Up to the end of the last section that is this file's: each ``startxref`` names a table of the file, an update's one behind the section before it."""
    end = linear = 0
    places = marks.all(b"startxref")
    k = bisect_left(places, at)
    while k < len(places) and (tail := _PDF_TAIL.match(d, places[k])):
        p, k = places[k], k + 1
        table = int(tail[1])
        if table == 0 and not end:
            linear, end = 1, tail.end() - at  # the first part of a file that is ordered for the web; its table is named at the end
            continue
        if at + table >= p or not _PDF_TABLE.match(d, at + table) or (end and not linear and table < end):
            break
        end, linear = tail.end() - at, 0
    return end


def _zip(d: bytes, at: int, marks: Marks) -> int:
    return marks.archives.get(at, 0)


def _gzip(d: bytes, at: int, marks: Marks) -> int:
    left = memoryview(d)[at:]
    reader = zlib.decompressobj(31)
    try:
        while left and not reader.eof:
            reader.decompress(reader.unconsumed_tail or left, 1 << 20)
            left = reader.unconsumed_tail
    except zlib.error:
        return 0
    return len(d) - at - len(reader.unused_data) if reader.eof else 0


def _ogg(d: bytes, at: int, marks: Marks) -> int:
    p, end = at, 0
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        n = d[p + 26]
        p += 27 + n + sum(d[p + 27 : p + 27 + n])
        end = p - at
    return end if 0 < end <= len(d) - at else 0


SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int, Marks], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _wav),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed medium, outer ones before those inside them."""
    out: list[tuple[int, int, str]] = []
    pages_until = -1
    marks = Marks(data)
    for last, (k, size) in _automaton().iter(data.decode("latin-1")):
        _, kind, validate = SIGNATURES[k]
        at = last + 1 - size
        if kind == "audio/ogg" and at < pages_until:  # a later page of the same stream
            continue
        if length := validate(data, at, marks):
            out.append((at, length, kind))
            if kind == "audio/ogg":
                pages_until = at + length
    return sorted(out, key=lambda x: (x[0], -x[1]))


def judge(data: bytes | None, declared: str | None) -> dict:
    """Type of a value and the media inside it."""
    found = sniff(data) if data else []
    whole = found[0] if found and found[0][0] == 0 else None
    kind = whole[2] if whole else declared
    return {
        "type": kind,
        "confirmed": whole is not None,
        "corrected": whole is not None and declared is not None and whole[2] != declared,
        "length": whole[1] if whole else None,
        "embedded": [{"offset": a, "length": n, "type": t} for a, n, t in found if whole is None or (a, n, t) != whole],
    }


_SNIFFED = "struct<type:string,confirmed:boolean,corrected:boolean,length:bigint,embedded:array<struct<offset:bigint,length:bigint,type:string>>>"
_SNIFFED_ARROW = pa.struct(
    [("type", pa.string()), ("confirmed", pa.bool_()), ("corrected", pa.bool_()), ("length", pa.int64()),
     ("embedded", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))]
)


def sniff_media(df: DataFrame, *, media_col: str = "media", declared_col: str = "declared", into: str = "sniffed") -> DataFrame:
    """df with a struct column: type, confirmed, corrected, length, embedded[offset, length, type]."""
    kept = but(df, into)
    where = {c: i for i, c in enumerate(df.columns)}
    schema = with_field(df, into, _SNIFFED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared = batch.column(where[declared_col]).to_pylist()
            found = [judge(m.as_py(), d) for m, d in zip(batch.column(where[media_col]), declared)]
            yield pa.RecordBatch.from_arrays([*[batch.column(where[c]) for c in kept], pa.array(found, _SNIFFED_ARROW)], names=[*kept, into])

    return by_place(df).mapInArrow(run, schema)


def carve(df: DataFrame, *, id_col: str, media_col: str = "media", into: str = "sniffed") -> DataFrame:
    """A row (id, offset, type, bytes) for each medium inside another."""
    inner = df.select(F.col(id_col), F.col(media_col), F.explode(f"{into}.embedded").alias("e"))
    return inner.select(id_col, "e.offset", "e.type", F.expr(f"substring({media_col}, cast(e.offset + 1 as int), cast(e.length as int))").alias("bytes"))


# -- texts as media --------------------------------------------------------------------------------------------

_WRITERS = (("audio/wav", to_wav), ("image/bmp", to_bmp), ("image/png", to_png))


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW if text else ROW)


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media), written once to the shared folder and read back.

    The format follows from the payload's checksum. What is declared follows from its size, as a file name would,
    so that it is often wrong.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, declared, media = [], [], []
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                payload = padded(raw)
                sizes.append(len(raw))
                declared.append(_WRITERS[len(raw) % 3][0])
                media.append(_WRITERS[zlib.crc32(payload) % 3][1](payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialise(plain.mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary"), "media")


def stored_features(stored: DataFrame) -> DataFrame:
    """Digests and features of the payloads, decoded from the stored bytes by their sniffed types."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "media_type string, declared string, corrected boolean, n_embedded int"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for doc, n, declared, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                media = value.as_py()
                found = judge(media, declared)
                if not found["confirmed"] or found["length"] != len(media):
                    raise ValueError(f"stored medium of {doc} is damaged")
                payload, shape = from_media(found["type"], media)
                samples = np.frombuffer(payload, np.uint8)
                counts = np.bincount(samples >> 4, minlength=16)
                feature = f"{found['type']} {shape} mean={samples.mean():.3f} nibbles={','.join(map(str, counts.tolist()))} embedded={len(found['embedded'])}"
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, found["type"], declared, found["corrected"], len(found["embedded"])))
            columns = list(zip(*out)) if out else [()] * len(names)
            kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "corrected": pa.bool_(), "n_embedded": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), batch.schema.field(0).type if k == "doc_id" else kinds.get(k, pa.string())) for k, c in zip(names, columns)], names=names)

    return stored.mapInArrow(run, schema)
