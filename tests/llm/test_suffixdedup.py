"""Removal of repeated passages against all strings of all texts."""

import random

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm import suffixdedup
from tessera.llm.suffixdedup import cells, drop_repeats, refine

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def brute(rows, length):
    """(id, text) -> removed mask, from a set of all strings met so far. Rows with equal id and text are one document."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    texts = sorted({t or "" for _, t in rows})
    marks = {r["t"]: r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, marks[x[1]])):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        out[i, t] = gone
    return out


def check(spark, rows, length, parts=3):
    found = drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(parts), length=length).collect()
    assert len(found) == len(rows)
    want = brute(rows, length)
    for r in found:
        data = (r["text"] or "").encode()
        gone = want[r["doc_id"], r["text"] or ""]
        info = r["repeats"]
        starts = np.flatnonzero(gone & ~np.append(False, gone[:-1])) if len(gone) else []
        assert (info["n_bytes"], info["n_removed"], info["n_spans"]) == (len(data), int(gone.sum()), len(starts)), (r["doc_id"], info)
        assert bytes(info["kept"]) == bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = np.array(info["spans"], int).reshape(-1, 2)
        assert [int(a) for a in spans[:, 0]] == [int(a) for a in starts]


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeşığü") for _ in range(r.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randint(0, 3), r.choice(passages))
        text = "".join(parts) if r.random() < 0.5 else " ".join(parts)
        if rows and r.random() < 0.3:  # a near copy
            old = r.choice(rows)[1] or ""
            at = r.randint(0, len(old))
            text = old[:at] + r.choice(["", "x", "qq "]) + old[min(len(old), at + r.randint(0, 5)) :]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed,length", [(1, 40), (2, 100), (3, 8)])
def test_against_all_strings(spark, seed, length):
    check(spark, corpus(seed), length)


def test_odd_rows(spark):
    r = random.Random(5)
    long_ = "".join(r.choice("abc def") for _ in range(3000))
    rows = [(None, None), (None, long_), (4, ""), (5, "é" * 60), (6, "é" * 49), (7, "a" * 1000), (8, "ab" * 700), (9, "ab" * 700), (9, "ab" * 700), (9, "x" + "ab" * 60)]
    rows += [(10, long_[:150] + long_[100:400]), (2, long_), (2, long_), (11, long_[1:]), (12, "é" * 50 + long_[-99:]), (13, long_[500:599]), (14, long_[500:600]), (-(1 << 62), long_[:120])]
    check(spark, rows, 100)


def test_buckets_over_the_limit_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "MOST", 3)
    check(spark, corpus(7), 40)
    r = random.Random(8)
    line = "this line stands in every text of the corpus, more or less at any place"
    check(spark, [(i, "".join(r.choice("abcd ") for _ in range(50)) + line + "".join(r.choice("abcd ") for _ in range(50))) for i in range(40)], 60)


def test_blocks_and_chunks_of_cells(monkeypatch):
    r = random.Random(9)
    data = np.frombuffer("".join(r.choice("ab ") for _ in range(5000)).encode(), np.uint8)
    offsets = np.array([0, 0, 700, 1500, 1500, 1530, 5000])
    whole = cells(data, offsets, 50)
    monkeypatch.setattr(suffixdedup, "BLOCK", 333)
    cut = cells(data, offsets, 50)

    def names(found):
        return {(int(t), int(lo) + j): (int(lo + left), int(g)) for t, lo, left, span, g in zip(*found) for j in range(span + 1)}

    assert names(whole) == names(cut)
    want = {(i, p) for i in range(6) for p in range(int(offsets[i + 1] - offsets[i]) - 49)}
    assert set(names(whole)) == want


def test_refinement_sorts_suffixes():
    r = random.Random(10)
    rows = np.array([[r.choice([0, 1, 255]) for _ in range(24)] for _ in range(300)] + [[1] * 24] * 3, np.uint8)
    rows[50:100, :20] = rows[0, :20]
    bucket = np.array([r.randint(0, 3) for _ in range(len(rows))])
    order, common = refine(bucket, rows)
    keys = [(int(bucket[i]), bytes(rows[i])) for i in order]
    assert keys == sorted(keys)
    for k in range(1, len(order)):
        a, b = keys[k - 1], keys[k]
        same = next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), 24) if a[0] == b[0] else -1
        assert common[k] == same


def test_buckets_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK_CELLS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, corpus(11), 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_clashing_names(spark):
    empty = drop_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "repeats"]
    rows = spark.createDataFrame([(1, "a" * 150, 1, 2, 3, 4), (2, "a" * 150, 1, 2, 3, 4)], "doc_id long, text string, Repeats int, id int, gram int, `mark.x` int")
    out = drop_repeats(rows).orderBy("doc_id").collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "repeats", "id", "gram", "mark.x"}
    assert [r["repeats"]["n_removed"] for r in out] == [149, 150]
    with pytest.raises(ValueError):
        drop_repeats(rows, length=5)
