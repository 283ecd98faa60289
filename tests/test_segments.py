"""The segmented index after random changes against an index made anew."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import changes, index, segments, topk
from tessera.operators.segments import SegmentedIndex


def state(posts, stats, terms):
    p = sorted((r["doc_id"], r["term"], r["tf"], r["dl"]) for r in posts.collect())
    s = stats.first()
    t = sorted((r["term"], r["df"], round(r["idf"], 9)) for r in terms.collect())
    return p, (s["n"], round(s["avgdl"], 9)), t


def rebuilt(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    tokens = index.tokenised(docs)
    posts, stats = index.postings(tokens), index.corpus_stats(tokens)
    return docs, state(posts, stats, index.term_stats(posts, stats))


def test_random_upserts_and_deletes(spark, tmp_path):
    r = random.Random(1)
    words = [f"word{i}" for i in range(30)]
    text = lambda: r.choice([None, "", *[" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(8)]])
    own = SegmentedIndex(spark, str(tmp_path / "index"), fanout=2)
    truth = {}
    merges = 0
    for turn in range(7):
        up = {r.randint(0, 60): text() for _ in range(r.randint(1, 25))}
        down = [r.randint(0, 60) for _ in range(r.randint(0, 6))]
        own.apply(
            spark.createDataFrame([(*x, "more") for x in up.items()] + [(None, "no id", "more")], "doc_id long, text string, extra string").repartition(3) if turn != 4 else None,
            spark.createDataFrame([(d,) for d in down], "doc_id long") if turn != 2 else None,
            epoch=turn,
        )
        for d in down if turn != 2 else []:
            truth.pop(d, None)
        truth.update(up if turn != 4 else {})
        if turn % 2:
            merges += own.merge()
        if turn in (3, 6):
            docs, want = rebuilt(spark, truth)
            assert state(own.postings(), own.corpus_stats(), own.term_stats()) == want
    assert merges > 0 and len(own.segments) < 7
    again = SegmentedIndex(spark, str(tmp_path / "index"))
    assert again.segments == own.segments and again.epoch == 6
    again.apply(spark.createDataFrame([(1, "twice")], "doc_id long, text string"), epoch=6)  # applied before
    assert again.turn == own.turn
    # searches over it, and over terms only
    asked = spark.createDataFrame([(1, "word1 word2 nowhere"), (2, "word3")], "query_id int, text string")
    wanted = index.query_terms(asked)
    found = topk.top_postings(again.postings(wanted), again.corpus_stats(), wanted, 5)
    plain = index.top_n(index.bm25_scores(docs, asked).withColumn("score", F.round("score", 4)), 5)
    pick = lambda df: sorted((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect())
    assert pick(found) == pick(plain)


def test_a_list_that_was_not_finished_does_not_count(spark, tmp_path):
    at = str(tmp_path / "index")
    own = SegmentedIndex(spark, at)
    own.apply(spark.createDataFrame([(1, "one text"), (2, "two text")], "doc_id long, text string"))
    (tmp_path / "index" / "lists" / "2").mkdir()
    (tmp_path / "index" / "lists" / "2" / "part-0.txt").write_text("{}")
    again = SegmentedIndex(spark, at)
    assert again.turn == 2 and again.postings().count() == 4
    again.apply(None, spark.createDataFrame([(1,), (7,)], "doc_id long"))
    assert sorted(x["term"] for x in SegmentedIndex(spark, at).postings().collect()) == ["text", "two"]
    again.apply(None, spark.createDataFrame([(2,)], "doc_id long"))
    assert again.segments == [] and again.corpus_stats().first()["n"] == 0 and again.term_counts().count() == 0


def test_follows_versions(spark, tmp_path):
    kind = "key string, version int, issue string, date string, text string, hash string"
    before = spark.createDataFrame([("a", 1, "i", "d", "old text", None), ("b", 1, "i", "d", "same text", None)], kind).withColumn("hash", F.sha2("text", 256))
    own = SegmentedIndex(spark, str(tmp_path / "index"))
    own.follow(before.limit(0), before)
    new = spark.createDataFrame([("a", "j", "e", "middle words", 1), ("a", "j", "e", "new words", 2), ("b", "j", "e", "same text", 3)], "key string, issue string, date string, text string, ord int")
    own.follow(before, changes.add_versions(before, new))
    assert len(own.segments) == 2 and own.segments[0].deleted == 1
    assert sorted((x["doc_id"], x["term"]) for x in own.postings().collect()) == [("a", "new"), ("a", "words"), ("b", "same"), ("b", "text")]


def test_lists_of_terms_are_made_where_the_documents_are(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(i * 7, [r.choice("abcdefgh") for _ in range(r.choice([0, 1, 5, 40]))] if i % 9 else None) for i in range(60)]
    batch = lambda part: pa.RecordBatch.from_pydict({"number": [n for n, _ in part], "dl": [None if t is None else len(t) for _, t in part], "tokens": pa.array([t for _, t in part], pa.list_(pa.string()))})
    monkeypatch.setattr(segments, "LIST_TOKENS", 30)
    made = [x for b in segments._inverted([batch(rows[:25]), batch(rows).slice(25), batch([])]) for x in b.to_pylist()]
    assert all(x["numbers"] == sorted(x["numbers"]) for x in made) and max(len(x["numbers"]) for x in made) > 1
    got = sorted((x["term"], *p) for x in made for p in zip(x["numbers"], x["tfs"], x["dls"]))
    assert got == sorted((t, n, k, len(ts)) for n, ts in rows if ts for t, k in Counter(ts).items())
    # rows of a table of postings: one for each term of a task's documents, not one for each term and document
    own = SegmentedIndex(spark, str(tmp_path / "index"))
    own.apply(spark.createDataFrame([(i, "common words") for i in range(100)], "doc_id long, text string").coalesce(1))
    assert own._table("postings", [own.segments[0].name]).count() <= 2 * 4 and own.postings().count() == 200
