"""Operators on hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkConfig
from tessera.functions.text import content_hash
from tessera.operators import answers, changes, chunking, citations, entities, fusion, index, metrics, models, vectors


def test_metric_case(spark):
    results = spark.createDataFrame([(1, k + 1, a) for k, a in enumerate(["10", "99", "11", "98", "12"])] + [(3, 1, "7"), (3, 2, "7"), (4, 1, "1")], "query_id int, rank int, article_no string")
    expected = spark.createDataFrame([(1, "A", ["10", "11", "12"]), (2, "A", ["5"]), (3, "B", ["7"]), (4, "B", [])], "query_id int, law string, expected array<string>")
    five = {r.query_id: r for r in metrics.per_query(results, expected, 5).collect()}
    two = {r.query_id: r for r in metrics.per_query(results, expected, 2).collect()}
    assert five[1].recall == 1 and two[1].recall == pytest.approx(1 / 3) and five[1].precision == pytest.approx(0.6) and five[1].mrr == 1 and five[1].hit == 1
    assert five[1].ndcg == pytest.approx((1 + 1 / math.log2(4) + 1 / math.log2(6)) / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    assert five[2].mrr == 0 and five[2].hit == 0 and five[2].missed == ["5"]
    assert five[3].ndcg > 1 and five[3].recall == 1  # repeated hits count for the gain
    assert five[4].recall == 0 and five[4].ndcg == 0
    by_law = {r.law: r for r in metrics.macro(metrics.per_query(results, expected, 5), "law").collect()}
    assert by_law["A"].queries == 2 and by_law["A"].recall == 0.5
    causes = {(r.query_id, r.cause) for r in metrics.root_causes(metrics.per_query(results, expected, 5)).collect()}
    assert (2, "no hit") in causes and (1, "partial") not in causes
    assert {r.metric: r.passed for r in metrics.against_targets(metrics.macro(metrics.per_query(results, expected, 5))).collect()}["mrr"] is False


def test_bm25_counts_query_terms_as_often_as_they_occur(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "yellow words here")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "red"), (2, "red red"), (3, "nothing")], "query_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in index.bm25_scores(docs, queries).collect()}
    idf, dl, avg = math.log((3 - 1 + 0.5) / 1.5 + 1), 3, 8 / 3
    want = idf * (2 * 2.6 / (2 + 1.6 * (1 - 0.68 + 0.68 * dl / avg)) + 1)
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] == pytest.approx(want) and got[2, 1] == pytest.approx(2 * want)


def test_fusion_rules(spark):
    dense = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.3)], "query_id int, doc_id string, score double")
    sparse = spark.createDataFrame([(1, "b", 4.0), (1, "c", 2.0)], "query_id int, doc_id string, score double")
    alphas = spark.createDataFrame([(1, 0.6), (2, 0.6)], "query_id int, alpha double")
    got = {(r.query_id, r.doc_id): r.score for r in fusion.fuse(dense, sparse, alphas).collect()}
    # the lowest of a list scales to 0; a single one to 1
    assert got == {(1, "a"): 0.6, (1, "b"): 0.4, (1, "c"): 0.0, (2, "a"): 0.6}
    hits = spark.createDataFrame([(1, f"d{k}", 0.0, 0.0, 1.0 - k / 10, a, "L", k + 1) for k, a in enumerate(["1", "1", "1/2", "2", None])],
                                 "query_id int, doc_id string, dense_score double, sparse_score double, score double, article_no string, law string, rank int")
    assert [r.doc_id for r in fusion.diversify(hits, 10).orderBy("rank").collect()] == ["d0", "d1", "d3", "d4"]
    queries = spark.createDataFrame([(1, "9", "L")], "query_id int, query_article string, query_law string")
    corpus = spark.createDataFrame([(f"n{k}", "9", law) for k, law in enumerate(["L", "M", "L", "L", "L"])], "doc_id string, article_no string, law string")
    got = fusion.inject(hits, queries, corpus).orderBy("rank").collect()
    assert [r.doc_id for r in got][:4] == ["n3", "n2", "n0", "d0"] and got[0].score == 1.2 and got[0].injected
    assert fusion.inject(hits, queries.withColumn("query_article", F.lit("2")), corpus).count() == 5


def test_entities(spark):
    q = spark.createDataFrame([(1, "TBK m.315 nedir"), (2, "borçlar kanunu 12. madde"), (3, "kira bedeli"), (4, "madde 7")], "query_id int, text string")
    number = lambda fixed: entities.article_number(F.col("text"), ["tbk"], ["6098"], ["borçlar"], fixed=fixed)
    assert [r.x for r in q.orderBy("query_id").select(number(True).alias("x")).collect()] == ["315", "12", None, "7"]
    assert [r.x for r in q.orderBy("query_id").select(number(False).alias("x")).collect()] == ["315", "12", None, None]
    aliases = spark.createDataFrame([(2, "borçlar", "B"), (1, "tbk", "A")], "ord int, phrase string, class string")
    words = spark.createDataFrame([("K", "kira", 3), ("K", "bedel", 2), ("L", "bedel", 2)], "class string, phrase string, weight int")
    assert {r.query_id: r["class"] for r in entities.detect_class(q, aliases, words).collect()} == {1: "A", 2: "B", 3: "K", 4: None}
    t = spark.createDataFrame([("hava nasıl",), ("x",), ("üç kelime var",), ("hak",), (" Merhaba ",)], "text string")
    assert [r.x for r in t.select(entities.on_topic(F.col("text"), ["hava"], ["hak"]).alias("x")).collect()] == [False, False, True, True, False]
    assert [r.x for r in t.select(entities.is_greeting(F.col("text"), ["merhaba"]).alias("x")).collect()][-1]
    made = spark.createDataFrame([("bir iki üç dört", "yeni"), ("bir iki", "yeni"), ("bir iki üç dört", "y" * 301)], "t string, p string")
    assert [r.x for r in made.select(entities.rewritten(F.col("t"), F.col("p")).alias("x")).collect()] == ["yeni", "bir iki", "bir iki üç dört"]


def test_windows():
    config = ChunkConfig(min_tokens=10, max_tokens=16, overlap_ratio=0.25, min_chunk_tokens=4, min_last_tokens=5)
    sentence = lambda k, n: " ".join([f"s{k}"] * n) + "."
    got = chunking.windows([sentence(k, 6) for k in range(5)], config)
    assert all(chunking.tokens_of(w) <= 16 + 4 for w in got) and " ".join(got).split()[0] == "s0"
    assert all(sentence(k, 6) in " ".join(got) for k in range(5))
    long = chunking.windows(["w " * 100], config)
    assert len(long) > 5 and all(chunking.tokens_of(w) <= 25 for w in long)
    assert chunking.windows(["a b"], config) == []  # a short only window is dropped
    assert chunking.grouped(["a b c", "d e", "x " * 30, "f"], config) == ["a b c d e", "x " * 30 + " f"]
    assert chunking.merged_short(["a " * 12, "b " * 12, "c"], config) == ["a " * 12, "b " * 12 + " c"]
    r = random.Random(1)
    for _ in range(50):
        parts = [" ".join(["w"] * r.randint(1, 30)) for _ in range(r.randint(1, 12))]
        assert " ".join(chunking.grouped(parts, config)) == " ".join(parts)
        assert " ".join(chunking.merged_short(parts, config)) == " ".join(parts)


def test_chunk_sources(spark):
    text = " ".join(f"({k}) " + "kelime " * 60 for k in range(1, 8))
    statutes = spark.createDataFrame([("TBK", "6098", "1", text), ("TBK", "6098", "2", " ")], "law string, law_no string, article_no string, text string")
    got = chunking.chunk_statutes(statutes).orderBy("chunk_index").collect()
    assert [g.chunk_index for g in got] == list(range(len(got))) and {g.chunk_total for g in got} == {len(got)} and got[0].chunk_id == "TBK_1_0"
    decisions = spark.createDataFrame([("d1", "kira", "DAVA: " + "a b. " * 200 + "KARAR: kısa"), ("d2", "kira", "c d. " * 100)], "decision_id string, query string, text string")
    d = chunking.chunk_decisions(decisions)
    assert d.filter("decision_id = 'd1'").count() > 1 and d.select("law").distinct().collect()[0].law == "kira"
    issues = spark.createDataFrame([("31000", ["6098"], [("5", "metin " * 300), ("6", "kısa"), ("7", " ")]), ("31001", [], [("1", "x")])], "rg_sayi string, kanunlar array<string>, degisen_maddeler array<struct<madde_no:string,icerik:string>>")
    g = chunking.chunk_gazette(issues, law_codes={"6098": "TBK"})
    assert g.filter("law = 'TBK' AND article_no = '6'").count() == 1 and g.filter("rg_sayi = '31001'").select("law").first().law is None
    every = chunking.all_chunks(chunking.chunk_statutes(statutes), d, g)
    assert {r.source for r in chunking.chunk_stats(every).collect()} == {"mevzuat", "yargitay", "resmigazete"}
    numbered = chunking.positional_ids(spark.range(500).selectExpr("id", "if(id % 3 = 0, 'a', 'b') AS source"), ["id"]).orderBy("source", "id").collect()
    assert [r.chunk_id for r in numbered][:2] == ["a_00000", "a_00001"] and numbered[-1].chunk_id == "b_00332"


def test_gazette_articles_keep_their_order_and_pages_their_numbers(spark):
    kind = "rg_sayi string, url string, kanunlar array<string>, degisen_maddeler array<struct<madde_no string, icerik string>>"
    issues = [("1", "u1", ["6098"], [("2", "first"), ("10", "second"), ("2", "third"), ("3", " ")]), ("1", "u2", ["6098"], [("7", "other page")]), ("1", "u2", ["6098"], [("7", "other page")])]
    g = chunking.chunk_gazette(spark.createDataFrame(issues, kind))
    got = sorted((r.article_no, r.chunk_index, r.chunk_total, r.text, r.chunk_id) for r in g.collect())
    assert got == [("10", 1, 3, "second", "6098_10_1"), ("2", 0, 3, "first", "6098_2_0"), ("2", 2, 3, "third", "6098_2_2")] + 2 * [("7", 0, 1, "other page", "6098_7_0")]


def test_versions_of_a_key_with_half_of_all_rows(spark):
    """Against one step after the other: a hot key, null texts, equal places, a stored version to begin with."""
    import random

    r = random.Random(3)
    kind = "key string, version int, issue string, date string, text string, hash string"
    stored = [("hot", 1, "i", "d", "a"), ("hot", 4, "i", "d", "b"), ("k1", 2, "i", "d", "c"), ("k2", 1, "i", "d", None), ("unchanged", 1, "i", "d", "z")]
    old = spark.createDataFrame([(*x, None) for x in stored], kind).withColumn("hash", content_hash(F.col("text")))
    new = [(r.choice(["hot", "hot", "hot", "k1", "k2", "unknown"]), f"i{n}", "d", r.choice(["a", "b", "b", "c", None]), n) for n in range(400)]
    new += [("k1", "j", "d", "b", 1000), ("hot", "x", "d", "b", 1001), ("hot", "y", "d", None, 1002), ("hot", "z", "d", "b", 1003)]
    changed = spark.createDataFrame(new, "key string, issue string, date string, text string, ord long").repartition(5)
    found = changes.add_versions(old, changed)
    want = [x for x in stored]
    now = {"hot": (4, "b"), "k1": (2, "c"), "k2": (1, None)}
    for key, issue, date, text, _ in sorted(new, key=lambda x: x[4]):
        if key in now and text is not None and now[key][1] != text:
            now[key] = now[key][0] + 1, text
            want.append((key, now[key][0], issue, date, text))
    assert sorted((tuple(x)[:5] for x in found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line or "_steps" in line for line in plan.splitlines() if "Window [" in line)


def test_citations(spark):
    text = "TBK m. 12, TTK'nın 5. maddesi, (TKHK, m. 7), 6098 sayılı Kanun madde 9, TBK 44. ve (TTK 3/1) DAVA"
    rows = [(f"d{k}", text if k == 0 else "TBK m. 12", k) for k in range(25)] + [("", "TBK m. 1", 99), ("e", "", 98)]
    cited = citations.citations(spark.createDataFrame(rows, "decision_id string, text string, pos int"))
    got = {r.key: r.citations for r in citations.citation_map(cited).collect()}
    assert set(got) == {"TBK_12", "TTK_5", "TKHK_7", "TBK_9", "TBK_44", "TTK_3"}
    assert [c.decision_id for c in got["TBK_12"]] == [f"d{k}" for k in range(20)] and got["TTK_5"][0].section == "DAVA"
    chunks = spark.createDataFrame([("TBK", "12", "x", 0), ("TBK", "1", "y", 0), ("TBK", "12", "z", 1)], "law string, article_no string, text string, chunk_index int")
    assert sorted(len(r.citations) for r in citations.attach(chunks, citations.citation_map(cited)).collect()) == [0, 20, 20]
    expected = spark.createDataFrame([("TBK", "12"), ("TTK", "1")], "law string, article_no string")
    assert {(r.article_no, r.chunks, r.first_text) for r in citations.coverage(expected, chunks).collect()} == {("12", 2, "x"), ("1", 0, None)}
    assert citations.missing(expected, chunks).count() == 1


def test_changes(spark):
    old = spark.createDataFrame([("k", 1, "i", "d", "t1", None), ("z", 4, "i", "d", "q", None)], "key string, version int, issue string, date string, text string, hash string")
    old = old.withColumn("hash", F.sha2("text", 256))
    new = spark.createDataFrame([("k", "j", "e", "t1", 1), ("k", "j", "e", "t2", 2), ("k", "j", "e", "t2", 3), ("k", "j", "e", "t1", 4), ("unknown", "j", "e", "x", 5)], "key string, issue string, date string, text string, ord int")
    got = changes.add_versions(old, new)
    assert [(r.version, r.text) for r in got.filter("key = 'k'").orderBy("version").collect()] == [(1, "t1"), (2, "t2"), (3, "t1")] and got.count() == 4
    assert [r.key for r in changes.changed_keys(old, got).collect()] == ["k"]
    issues = spark.createDataFrame([("1", "u1", "t", ["6098"], [("1", "a;b")]), ("1", "u2", " t  t ", [], [])], "rg_sayi string, url string, baslik string, kanunlar array<string>, degisen_maddeler array<struct<madde_no:string,icerik:string>>")
    state = changes.next_state(issues.limit(1), F.lit("now"))
    assert [r.url for r in changes.new_issues(issues, state).collect()] == ["u2"] and changes.relevant_issues(issues).count() == 1
    assert changes.prepare_issue(issues).first().degisen_maddeler[0].icerik == "a; b"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, changes.upsert(a, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    items = spark.createDataFrame([("yargitay", "x" * 400), ("yargitay", "short"), ("mevzuat", "y" * 60), ("other", "z")], "source string, text string")
    got = changes.route(items, {"yargitay": (changes.decision_gate,), "mevzuat": (changes.statute_gate,)})
    assert sorted(r.source for r in got.collect()) == ["mevzuat", "other", "yargitay"]


def test_vectors_and_increments(spark):
    points = spark.createDataFrame([(k, [float(k == j) + 0.1 for j in range(4)], "A" if k < 3 else "B") for k in range(4)], "doc_id int, vector array<float>, law string")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "A"), (2, [0.0, 0.0, 0.0, 1.0], None), (3, [0.0, 1.0, 0.0, 0.0], "C")], "query_id int, vector array<float>, law string")
    hits = vectors.dense_top(queries, points, 2)
    assert {(r.query_id, r.doc_id) for r in hits.filter("rank = 1").collect()} == {(1, 0), (2, 3)}
    both = vectors.fallback(hits, vectors.dense_top(queries, points, 2, filtered=False), 1)
    assert both.filter("query_id = 3").count() == 2 and both.filter("query_id = 1").count() == 2
    chunks = spark.createDataFrame([("a", "old"), ("b", "new"), ("c", "x")], "chunk_id string, text string")
    from tessera.functions.text import content_hash, point_id

    stored = spark.createDataFrame([("a", "old"), ("b", "before")], "c string, t string").select(point_id(F.col("c")).alias("point_id"), content_hash(F.col("t")).alias("content_hash"))
    assert {r.chunk_id for r in vectors.not_embedded(chunks, stored).collect()} == {"b", "c"}
    assert {r.chunk_id for r in vectors.not_embedded(chunks, stored, by_content=False).collect()} == {"c"}
    assert spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(vectors.quantised(vectors.unit(F.col("v"))).alias("q")).first().q == [76, 102]


def test_answers(spark):
    m = spark.createDataFrame([("TBK m. 12/a ve madde 7", ["12"]), ("hiç", ["1"]), ("m. 9", ["1", ""]), ("hiç", [])], "a string, s array<string>")
    rows = m.select(answers.article_mentions(F.col("a")).alias("m"), answers.faithfulness(answers.article_mentions(F.col("a")), F.col("s")).alias("c")).collect()
    assert rows[0].m == ["TBK m. 12/a", "ve madde 7"]
    assert [(r.c.faithful, r.c.warning) for r in rows] == [(True, ""), (True, "unnamed"), (False, "unsupported"), (True, "")]
    log = spark.createDataFrame([(1, k, "user", "m" * 400 if k == 9 else f"m{k}") for k in range(10)], "session_id long, seq long, role string, content string")
    assert answers.session_tail(log).count() == 8
    assert answers.session_context(log).first().context.split("\n")[-1] == "user: " + "m" * 300
    new = spark.createDataFrame([(1, "user", "x", 0), (1, "assistant", "y", 1), (2, "user", "z", 0)], "session_id long, role string, content string, turn int")
    assert {(r.session_id, r.seq) for r in answers.append_messages(log, new).filter("content IN ('x', 'y', 'z')").collect()} == {(1, 10), (1, 11), (2, 0)}


def test_models(spark):
    df = spark.createDataFrame([("red blue",), ("",)], "t string")
    got = df.select(models.encode(F.col("t"), lambda: models.hashing_encoder(8)).alias("v")).collect()
    assert sum(x * x for x in got[0].v) == pytest.approx(1, abs=1e-5) and len(got[1].v) == 8
    pair = spark.createDataFrame([("red blue", "a red thing. No. Blue sky is here.")], "q string, t string")
    assert pair.select(models.extractive_answer(F.col("q"), F.col("t"), 2).alias("a")).first().a == "a red thing. Blue sky is here."
    score = models.cross_score(F.col("q"), F.col("t"), lambda: lambda q, t: [float(len(x)) for x in t])
    assert pair.select(score.alias("s")).first().s == 34.0

    def failing():
        def model(prompts):
            raise TimeoutError

        return model

    assert df.select(models.generate(F.col("t"), failing).alias("g")).first().g == "[timeout]"
