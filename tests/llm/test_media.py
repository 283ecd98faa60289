import gzip
import hashlib
import io
import time
import zipfile
import zlib

from pyspark.sql import functions as F

from tessera.llm import media
from tessera.llm.media import carve, judge, padded, sniff, sniff_media, store_texts, stored_features, to_bmp, to_png, to_wav


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd1234\xff\xd9"
PDF = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
OGG = b"OggS" + b"\0" * 22 + b"\x01\x03abc" + b"OggS" + b"\0" * 22 + b"\x01\x02de"


def test_types_lengths_and_carving():
    samples = padded(b"some text " * 200)
    for kind, data in (("audio/wav", to_wav(samples)), ("image/bmp", to_bmp(samples)), ("image/png", to_png(samples)), ("image/gif", GIF), ("image/jpeg", JPEG),
                       ("application/pdf", PDF), ("application/zip", zipped()), ("application/gzip", gzip.compress(b"x" * 999)), ("audio/ogg", OGG)):
        assert sniff(data) == [(0, len(data), kind)]
        found = judge(b"junk BM RIFF " + data + b" more", "text/plain")
        assert [(e["offset"], e["length"], e["type"]) for e in found["embedded"]] == [(13, len(data), kind)] and found["type"] == "text/plain"
        assert not any(x[2] == kind for x in sniff(data[:-3])) or kind == "application/zip"
    inner = to_wav(padded(to_png(samples)))
    assert [k for _, _, k in sniff(inner)] == ["audio/wav", "image/png"]
    assert judge(inner, "image/png")["corrected"] and not judge(b"", None)["confirmed"] and judge(None, "x")["type"] == "x"
    broken = bytearray(to_png(samples))
    broken[60] ^= 1
    assert sniff(bytes(broken)) == []


def test_spark_columns(spark):
    png = to_png(padded(b"a"))
    rows = [(1, png, "image/gif", "s"), (2, None, None, None), (3, b"", "x", None), (4, to_wav(padded(png)), "audio/wav", None), (4, png, None, None)]
    df = sniff_media(spark.createDataFrame(rows, "id long, media binary, declared string, sniffed string"))
    got = df.orderBy("id").collect()
    assert [r.sniffed.type for r in got][:3] == ["image/png", None, "x"] and got[0].sniffed.corrected
    assert [bytes(r.bytes) for r in carve(df, id_col="id").collect()] == [png]
    assert sniff_media(spark.createDataFrame([], "media binary, declared string")).count() == 0


def test_texts_round_trip(spark):
    texts = ["", None, "é" * 700, "x" * 576, "BM PK\x03\x04 RIFF", "long " * 40000, "same", "same"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", None)]
    got = stored_features(store_texts(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    assert len(got) == len(rows)
    for g in got:
        raw = ("no id" if g.doc_id is None else texts[g.doc_id] or "").encode()
        payload = padded(raw)
        assert len(payload) % 576 == 0 and payload
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = [g[1:] for g in got if g.doc_id in (6, 7)]
    assert same[0] == same[1]
    assert {k for k, _ in media._WRITERS} >= {g.media_type for g in got}
    assert stored_features(store_texts(spark.createDataFrame([], "doc_id long, text string"))).select(F.count("*")).first()[0] == 0


def test_many_members_take_linear_time():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(20000):
            z.writestr(f"{k}.txt", "PK")
    data = out.getvalue()
    begun = time.process_time()
    assert sniff(b"x" + data) == [(1, len(data), "application/zip")]
    assert sniff(b"%PDF-1.4 startxref " * 50000) == [] and sniff(b"PK\x03\x04" * 200000) == [] and sniff(JPEG[:-2] * 30000) == []
    assert time.process_time() - begun < 10


def test_archives_inside_archives():
    inner = zipped()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("inner.zip", inner)
        z.writestr("b.png", to_png(padded(b"b")))
    found = judge(out.getvalue(), "application/zip")
    assert found["confirmed"] and sorted(e["type"] for e in found["embedded"]) == ["application/zip", "image/png"]
    at = next(e for e in found["embedded"] if e["type"] == "application/zip")
    assert out.getvalue()[at["offset"] : at["offset"] + at["length"]] == inner


def test_columns_with_dots(spark):
    got = sniff_media(spark.createDataFrame([(to_png(padded(b"a")), None, 3)], "media binary, declared string, `a.b` long"))
    assert got.columns == ["media", "declared", "a.b", "sniffed"] and got.first().sniffed.type == "image/png"


def pdf(body, updates=0, web=False):
    """A file with a table, and with tables of later updates that name the one before."""
    data = b"%PDF-1.4\n" + body
    if web:
        data += b"startxref\n0\n%%EOF\n"
    table = None
    for k in range(updates + 1):
        data += b"7 0 obj\n%d\nendobj\n" % k
        at, prev = len(data), b"" if table is None else b"/Prev %d" % table
        data += b"xref\n0 1\n0000000000 65535 f \ntrailer << /Size 1 %s >>\nstartxref\n%d\n%%%%EOF" % (prev, at)
        table = at
        data += b"\n" if k < updates else b""
    return data


def test_pdf_ends_with_its_own_last_section():
    a, b, c = pdf(b"first"), pdf(b"a second, longer one"), pdf(b"updated", updates=2)
    for parts in ([a, b], [a, a], [c, a], [a, c, b], [pdf(b"web", web=True), a]):
        data, want = b"", []
        for p in parts:
            want.append((len(data), len(p), "application/pdf"))
            data += p + b" "
        assert sniff(data) == want
    assert sniff(a + b" text with %%EOF and startxref and startxref\n12\n%%EOF") == [(0, len(a), "application/pdf")]


def test_clashing_name_of_another_case(spark):
    out = sniff_media(spark.createDataFrame([(to_png(padded(b"a")), "x", 5)], "media binary, declared string, SNIFFED int"))
    assert out.columns == ["media", "declared", "sniffed"] and out.first()["sniffed"]["type"] == "image/png"
