import gzip
import random

import pytest

from tessera.llm.warc import EMPTY_MEMBER, LoserTree, base32_digest, capture_history, member, members, merge_runs, parse_archive, read_runs, record, url_key, write_archives


def test_loser_tree_merges():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted((r.randrange(50), i, j) for j in range(r.randrange(30))) for i in range(k)]
        assert list(LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert url_key("http://www.Example.com:80/A/b?z=1&a=2") == "com,example)/a/b?a=2&z=1"
    assert url_key("https://sub.example.org:8443") == "org,example,sub:8443)/"
    assert url_key(None) == "" and url_key("http://[bad") == "http://[bad"


def test_records_round_trip():
    payload = b"a\r\n\r\nWARC/1.1\r\n\r\nb"
    data = record(1, "http://x/\r\n", "2020-01-01T00:00:00Z", base32_digest(payload), payload, None, False) + b"\r\n\r\n"
    data += record(2, None, "2020-01-01T00:00:00Z", base32_digest(payload), b"", 1, True) + b"\r\n\r\n"
    got = list(parse_archive(data))
    assert [g[3] for g in got] == [payload, b""] and sum(g[1] for g in got) == len(data)
    assert got[1][2]["WARC-Refers-To"] == "<urn:x-page:1>"


def test_history(spark):
    r = random.Random(1)
    bodies = ["<p>" + "x" * r.randrange(2000) + "</p>" for _ in range(20)] + ["", "é\r\n\r\nü", "\r\n\r\n"]
    rows = [(i, f"http://h{r.randrange(5)}.example.com/{r.randrange(4)}", r.choice(bodies)) for i in range(400)]
    rows += [(500, None, None), (501, "http://hot.example.com/", ""), (None, "http://h1.example.com/", "only here"), (600, "http://z/", "y " * 200000), (7, rows[7][1], rows[7][2])]
    rows += [(1000 + i, "http://hot.example.com/", "the same page") for i in range(300)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, record_type string")
    got = capture_history(df).orderBy("history_range", "history_pos").collect()
    top = {}
    for i, _, b in rows:
        top[b or ""] = max(top.get(b or "", -1), -1 if i is None else i)
    want = []
    for i, u, b in rows:
        raw = (b or "").encode()
        last = top[b or ""]
        first = (-1 if i is None else i) == last
        want.append((i, len(raw), base32_digest(raw), "response" if first else "revisit", None if first else last))
    assert sorted(((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got), key=str) == sorted(want, key=str)
    keys = [(g.url_key, g.stamp, -1 if g.page_id is None else g.page_id) for g in got]
    assert keys == sorted(keys)


def test_small_payloads_stay_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in read_runs(spark, write_archives(df, min_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert merge_runs(read_runs(spark, write_archives(df))).count() == 4
    assert capture_history(df.limit(0)).count() == 0


def test_members_are_read_one_by_one():
    big = bytes(range(256)) * 4000
    parts = [member(b"a"), EMPTY_MEMBER, member(big), EMPTY_MEMBER, EMPTY_MEMBER, member(b"last")]
    data = b"".join(parts)
    got = list(members(memoryview(data)))
    assert [g[2] for g in got] == [b"a", big, b"last"]
    assert all(gzip.decompress(data[a : a + n]) == x for a, n, x in got) and gzip.decompress(data) == b"a" + big + b"last"
    with pytest.raises(ValueError):
        list(members(memoryview(data[:-3])))


def test_records_can_be_sought(spark):
    rows = [(i, f"http://h{i % 7}/", f"<p>{i % 11} é</p>" * 50) for i in range(60)]
    path = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    files = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()}
    for r in read_runs(spark, path).collect():
        one = gzip.decompress(files[r.archive][r.offset : r.offset + r.length])
        ((_, _, headers, payload),) = parse_archive(one)
        assert headers["WARC-Record-ID"] == f"<urn:x-page:{r.page_id}>" and (payload == rows[r.page_id][2].encode()) == (r.record_type == "response")
