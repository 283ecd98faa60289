"""Tokens by arithmetic on Arrow columns, against the expression of every text."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.batches import pieces
from tessera.functions.cutting import cut, token_characters
from tessera.functions.text import search_tokens
from tessera.operators import index, topk


def odd_texts(seed, n=400):
    r = random.Random(seed)
    some = "abcXYZ019_ -.,;'\n\t\x00İIıſßΣσςéÉñ½²٣中文あ가́­‍ \xa0😀𝔸𐐀\U0001e4d0\U000323b0�€"
    every = lambda: chr(r.choice([r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    texts = ["".join(r.choice(some) if r.random() < 0.9 else every() for _ in range(r.randint(0, 30))) for _ in range(n)]
    return [*texts, None, "", "a", "é", "😀", "中", "中a", "a中", "ΑΣ ΑΣΑ", "ab" * 50_000, None, "_" * 3, ""]


def test_tokens_of_odd_texts(spark):
    held = token_characters(spark)
    texts = odd_texts(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = docs.select("doc_id", F.lower("text").alias("text"), search_tokens(F.col("text")).alias("tokens")).orderBy("doc_id").toArrow().combine_chunks()
    lower, want = own.column("text").chunk(0), own.column("tokens").to_pylist()
    for part in (slice(0, None), slice(7, 200), slice(395, None), slice(3, 3)):
        for column in (lower[part], lower[part].cast(pa.large_string())):
            runs, n = cut(column, held)
            got = [[t for t in x if all(held[ord(c)] for c in t) and len(t) > 1] for x in runs.to_pylist()]
            assert got == [x or [] for x in want[part]] and n.to_pylist() == [x if x is None else len(x) for x in want[part]]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": lower})
    whole = [r for piece in pieces(batch, 1, 900) for r in index._numbered(piece, pa.array(["ab", "_1"], pa.large_string()), held).to_pylist()]
    assert [r["dl"] for r in whole] == [x if x is None else len(x) for x in want]
    assert [dict(zip(r["numbers"], r["tfs"])) for r in whole] == [{i: x.count(t) for i, t in enumerate(["ab", "_1"]) if x and t in x} for x in want]
    assert len(index._numbered(batch.slice(0, 3), pa.array([], pa.large_string()), held).column("numbers").flatten()) == 0


def test_postings_stay_where_documents_are(spark, monkeypatch):
    """Nothing but counts and best rows is shuffled, and the rows are those of postings that are dealt out; null and repeated ids too."""
    texts = odd_texts(2)
    docs = spark.createDataFrame([(i, f"{t} common w{i % 7}" if t is not None else t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts[:30])] + [("r", "common w1 W3 common"), ("s", None)], "query_id string, text string")
    pick = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    twice = docs.unionByName(docs.filter("doc_id % 5 = 0")).withColumn("doc_id", F.when(F.col("doc_id") != 11, F.col("doc_id")))
    for own in (docs, twice):
        found = topk.bm25_top(own, queries, 7)
        assert ("FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()) == (own is twice)
        got = pick(found)
        with monkeypatch.context() as m:
            m.setattr(index, "LOOKED_UP", 1)
            assert got == pick(topk.bm25_top(own, queries, 7)) and got
        with monkeypatch.context() as m:
            m.setattr(topk, "SHARD_POSTINGS", 40)
            assert got == pick(topk.bm25_top(own, queries, 7))


def test_shards_hold_whole_documents():
    lists = pa.array([list(range(k)) for k in (3, 0, 50, 2, 2, 0, 9, 1)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), lists], names=["doc_id", "numbers"])
    got = [t.column("doc_id").to_pylist() for t in topk._shards([batch.slice(0, 5), batch.slice(5), batch.slice(0, 0)], 10)]
    assert sum(got, []) == list(range(8)) and len(got) == 4
    assert np.all([sum(len(lists[i]) for i in x) <= 10 or len(x) == 1 for x in got])


def test_only_cells_that_a_threshold_can_need():
    """Of what a task has counted, only the cells of each term's n largest contributions leave it."""
    r = np.random.default_rng(3)
    n, shards = 5, []
    for _ in range(4):
        number = r.choice([0, 1, 2, 9], 300, p=[0.8, 0.19, 0.005, 0.005]).astype(np.int32)
        shards.append((number, r.integers(100, 400, 300) / 100))
    got = {}
    for number, part in shards:
        rows = topk._cells(number, part, n).to_pylist()
        assert len(rows) <= 4 * (n + 1)
        for x in rows:
            got.setdefault(x["number"], []).append((x["cell"], x["had"]))
    for t in (0, 1, 2, 9):
        own = np.sort(np.concatenate([part[number == t] for number, part in shards]))[::-1]
        held = sorted(got.get(t, []), reverse=True)
        assert sum(had for _, had in held) == len(own)
        reached = [cell for i, (cell, _) in enumerate(held) if sum(had for _, had in held[: i + 1]) >= n]
        assert reached[:1] == [int(np.floor(x * topk.CELLS)) for x in own[n - 1 : n]]
    assert topk._cells(np.zeros(0, np.int32), np.zeros(0), n).num_rows == 0
