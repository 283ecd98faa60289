"""Top-n BM25 by MaxScore, and phrases by automaton, against the plain ways."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import index, phrases, topk
from tessera.operators.entities import contained
from tessera.operators.phrases import find_phrases


def corpus(spark, seed, n_docs, n_queries, vocabulary=200, common=8):
    """Texts of a skewed vocabulary: a few words are in nearly all of them."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [50 if i < common else 1 for i in range(vocabulary)]
    text = lambda k: " ".join(r.choices(words, weights, k=k))
    docs = [(i, text(r.randint(0, 60))) for i in range(n_docs)] + [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "w1 w2"), (n_docs + 3, "w1 w2")]
    queries = [(q, text(r.randint(1, 6)) + " " + " ".join(words[: r.randint(0, common)])) for q in range(n_queries)] + [(n_queries, ""), (n_queries + 1, None), (n_queries + 2, "nowhere")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id int, text string")


def plain(docs, queries, n, places):
    return index.top_n(index.bm25_scores(docs, queries).withColumn("score", F.round("score", places)), n)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("seed,n,places", [(1, 10, 4), (2, 1, 4), (3, 50, 9), (4, 5, 1)])
def test_same_rows_as_all_scores(spark, monkeypatch, seed, n, places):
    monkeypatch.setattr(topk, "SHARD_POSTINGS", 700)
    monkeypatch.setattr(topk, "BLOCK", 8)
    docs, queries = corpus(spark, seed, 300, 25)
    assert rows(topk.bm25_top(docs, queries, n, places=places)) == rows(plain(docs, queries, n, places))


def test_blocks_of_queries_string_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_TERMS", 30)
    docs, queries = corpus(spark, 5, 80, 20)
    docs = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert rows(topk.bm25_top(docs, queries, 3)) == rows(plain(docs, queries, 3, 4))
    assert topk.bm25_top(docs.limit(0), queries, 3).collect() == [] and topk.bm25_top(docs, queries.limit(0), 3).collect() == []
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id") != "d1", F.col("doc_id")))
    assert all(r["doc_id"] is not None for r in topk.bm25_top(nulls, queries, 3).collect())


def test_scores_under_a_tenth_of_all_pairs(spark):
    """Nearly all documents share common words with every query; what ranks is a few rare ones."""
    r = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    docs = [(i, " ".join(r.sample(common, 10) + [f"r{r.randint(0, 150)}" for _ in range(8)])) for i in range(3000)]
    queries = [(q, " ".join(r.sample(common, 8) + [f"r{r.randint(0, 150)}" for _ in range(2)])) for q in range(20)]
    docs, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id int, text string")
    counter = spark.sparkContext.accumulator(0)
    assert rows(topk.bm25_top(docs, queries, 10, counter=counter)) == rows(plain(docs, queries, 10, 4))
    assert 0 < counter.value * 10 < index.bm25_scores(docs, queries).count()


def test_kernel_keeps_ties_and_resets():
    r = np.random.default_rng(7)
    terms, docs = r.integers(0, 6, 400), r.integers(0, 90, 400)
    keep = np.unique(terms * 100 + docs, return_index=True)[1]
    terms, docs, parts = terms[keep], docs[keep], r.integers(1, 4, len(keep)).astype(float)
    lists = topk.Lists(terms, docs, parts, 90)
    for _ in range(30):
        asked, weights = r.permutation(7)[: r.integers(1, 7)], r.integers(1, 3, 7).astype(float)
        total = np.zeros(90)
        for t, w in zip(asked, weights):
            total[docs[terms == t]] += w * parts[terms == t]
        n = int(r.integers(1, 12))
        found, scores, _ = lists.top(asked, weights[: len(asked)], n, 0.0, 2e-4)
        got = dict(zip(found.tolist(), scores.tolist()))
        want = sorted(np.flatnonzero(total), key=lambda d: (-total[d], d))[:n]
        assert all(got[d] == total[d] for d in want)
        assert not lists.member.any() and not lists.score.any()


def found(df):
    return sorted((r["id"], r["phrase"]) for r in df.collect())


def brute(texts, words, lower=True):
    return sorted({(i, p) for i, t in texts if t is not None for p in words if p is not None and p in (t.lower() if lower else t)})


@pytest.mark.parametrize("lower", [True, False])
def test_phrases_in_one_automaton_and_in_parts(spark, monkeypatch, lower):
    r = random.Random(8)
    letters = "abAB ışÖ😀\n."
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(150)] + [(200, None), (201, ""), (202, "ab" * 5000)]
    words = list({"".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(300)}) + ["", None, "ab", "ab", "b"]
    left = spark.createDataFrame([(i, t, i) for i, t in texts], "id long, text string, `a.b` int")
    right = spark.createDataFrame([(w,) for w in words], "w string")
    want = brute(texts, words, lower)
    assert found(find_phrases(left, right, lower=lower)) == want
    monkeypatch.setattr(phrases, "PART_PHRASES", 40)
    monkeypatch.setattr(phrases, "GROUP_BYTES", 3000)
    many = find_phrases(left, right, lower=lower)
    assert many.columns == ["id", "text", "a.b", "phrase"] and found(many) == want
    assert find_phrases(left.limit(0), right).collect() == [] and find_phrases(left, right.limit(0)).collect() == []


def test_contained_with_300_000_phrases(spark):
    """More phrases than one automaton holds; repeated phrases of a lexicon give a row each."""
    r = random.Random(9)
    texts = [(q, " ".join(f"x{r.randint(0, 400_000)}y" for _ in range(20)) + " Straße tail") for q in range(100)]
    queries = spark.createDataFrame(texts, "query_id long, text string")
    lexicon = spark.range(300_000).select(F.concat(F.lit("x"), F.col("id"), F.lit("y")).alias("phrase"), F.col("id").cast("int").alias("ord"))
    lexicon = lexicon.unionByName(spark.createDataFrame([("straße", -1), ("straße", -2), ("Straße", -3)], "phrase string, ord int"))
    hits = contained(queries, lexicon)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BroadcastNestedLoopJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    want = []
    for q, t in texts:
        want += [(q, int(w[1:-1])) for w in set(t.lower().split()) if w[0] == "x" and int(w[1:-1]) < 300_000] + [(q, -1), (q, -2)]
    assert sorted((r["query_id"], r["ord"]) for r in hits.collect()) == sorted(want)


def test_wanted_postings_cut_documents_once(spark, monkeypatch):
    rows = [(1, "one two two Three"), (1, "two four"), (2, None), (None, "one one"), (None, "two"), (3, ""), (4, "nothing of it"), (5, "two, two; four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame([(7, "two", 1), (7, "four", 2), (8, "one", 1), (8, "absent", 1)], "query_id int, term string, qtf long")
    tokens = index.tokenised(docs)
    for few in (docs, docs.filter("doc_id > 1")):
        pick = lambda df: sorted((str(r["doc_id"]), r["term"], r["tf"]) for r in df.collect())
        want = pick(index.postings(index.tokenised(few), wanted))
        for most in (100, 2):
            monkeypatch.setattr(index, "LOOKED_UP", most)
            posts, stats = index.wanted_postings(few, wanted)
            assert pick(posts) == want
            assert stats.first() == index.corpus_stats(index.tokenised(few)).first()
    # a piece of documents holds the wanted terms only, and a row for each document
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 6, 7], "dl": pa.array([3, None, 1], pa.int32()), "tokens": pa.array([["a", "b", "a"], None, ["c"]], pa.list_(pa.string()))})
    got = [tuple(r.values()) for r in index._counted(batch, pa.array(["b", "a"])).to_pylist()]
    assert sorted(got, key=str) == sorted([(5, 3, None, 0), (6, None, None, 0), (7, 1, None, 0), (5, 3, "b", 1), (5, 3, "a", 2)], key=str)
    assert len(index._counted(batch, pa.array([], pa.string()))) == 3 and tokens.count() == 8
