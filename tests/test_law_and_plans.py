"""References, chunk windows as a state machine, saved index, dense search in blocks, versions over ranges, and answers against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkConfig
from tessera.functions import references as R
from tessera.operators import cells, changes, chunking, entities, index, models, vectors
from tessera.plans.retrieval import answer
from tessera.storage import exists, release, written


def texts(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_article_numbers(spark):
    number = lambda c: R.article_number(c, ["tbk", "ttk"], ["6098"], ["borçlar"])
    cases = {
        "TBK 12": "12", "tbk12": "12", "TBK'nın 5. maddesi": "5", "tbknın md. 7": "7", "7'nci": None, "12 inci madde": None, "5'inci madde": "5", "ilk 3 madde": "3", "6098 sayılı kanunun 40. maddesi": "40",
        "borçlar kanunu madde 9": "9", "xtbk 5": None, "m. 8": "8", "TBK 12345": "1234", "": None, "madde": None, "iki madde 4 ve TBK 6": "4",
    }
    assert texts(spark, list(cases), number) == list(cases.values())


def test_whether_a_text_has_a_reference(spark):
    cases = {"TBK m.12": True, "TBK 12a": False, "ttk madde 5": True, "xtbk 5": False, "16098": False, "6098": True, "60981": False, "m. 3": True, "m 3": False, "madde": False, "tbk'nın 5. maddesi": False}
    assert texts(spark, list(cases), R.has_reference) == list(cases.values())


def test_citations_of_each_form(spark):
    cases = {
        "TBK m. 12a/3 ve": [("TBK", "12a/3")], "TBK madde5": [("TBK", "5")], "TTK'nın 5/2. maddesi": [("TTK", "5/2")], "TTK'nın 5 maddesi": [], "(TKHK, m. 7 )": [("TKHK", "7")], "TKHK, m. 7 )": [],
        "TBK 44.": [("TBK", "44")], "TBK 44": [], "TBK 44x.": [], "( TTK 3/1 )": [("TTK", "3/1")], "6098 sayılı Kanunun ilgili madde 9b": [("6098", "9b")], "6098 sayılı. madde 9": [],
        "6098 sayılı " + "x" * 50 + "madde 9": [], "tbk M. 1, (TBK 2)": [("tbk", "1"), ("TBK", "2")],
    }
    got = texts(spark, list(cases), lambda c: R.cited_articles(c, ["TBK", "TTK", "TKHK"], ["6098"]))
    assert [sorted((x.law, x.article) for x in g) for g in got] == [sorted(v) for v in cases.values()]


def test_mentions(spark):
    cases = {"TBK m. 12/a ve": ["TBK m. 12/a"], "(m.5)": ["m.5"], "atom 5": ["atom 5"], "madde 12a": [], "m 7": ["m 7"], "12 m": [], "": [], "x m. 1 y madde 2": ["x m. 1", "y madde 2"]}
    assert texts(spark, list(cases), R.article_mentions) == list(cases.values())


def state_machine(sentences, most, least, ratio, last):
    """Window packing step by step: out, buffer, running count."""
    count = lambda t: len(t.split()) * 13 // 10
    carry = int(most * ratio)

    def overlap(pieces):
        kept = []
        for p in reversed(pieces):
            if sum(map(count, kept)) + count(p) > carry:
                break
            kept.insert(0, p)
        return " ".join(kept)

    out, buf, n = [], [], 0
    for s in sentences:
        t = count(s)
        if t > most:
            if buf:
                out.append(" ".join(buf))
                kept = overlap(buf)
                buf, n = ([kept], count(kept)) if kept else ([], 0)
            words, m = [], 0
            for w in s.split():
                if m + count(w) > most and m >= least:
                    out.append(" ".join(words))
                    words = overlap(words).split()
                    m = count(" ".join(words))
                words.append(w)
                m += count(w)
            if words:
                buf, n = [" ".join(words)], count(" ".join(words))
        else:
            if n + t > most and n >= least:
                out.append(" ".join(buf))
                kept = overlap(buf)
                buf, n = ([kept], count(kept)) if kept else ([], 0)
            buf.append(s)
            n += t
    if buf:
        rest = " ".join(buf)
        if count(rest) >= last:
            out.append(rest)
        elif out:
            out[-1] += " " + rest
    return [x for x in out if x.strip()]


def test_windows_follow_the_state_machine(spark):
    r = random.Random(4)
    config = ChunkConfig(min_tokens=18, max_tokens=25, overlap_ratio=0.3, min_chunk_tokens=4, min_last_tokens=6)
    rows = []
    for i in range(300):
        sentences = [" ".join(f"w{r.randrange(99)}" for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30, 70]))) + r.choice(".!?") for _ in range(r.randint(0, 12))]
        assert chunking.windows(sentences, config) == state_machine(sentences, 25, 18, 0.3, 6)
        rows.append((i, "  ".join(sentences)))
    got = chunking.chunk_windows(spark.createDataFrame(rows, "doc_id int, text string"), config=config).collect()
    want = {(i, k, w) for i, t in rows for k, w in enumerate(state_machine(chunking._sentences(t), 25, 18, 0.3, 6))}
    assert {(g.doc_id, g.chunk_index, g["text"]) for g in got} == want


def test_rows_of_one_article_stay_together(spark):
    rows = [("TBK", "6098", "1", f"({k}) " + f"{mark} " * 300 + f"({k + 1}) " + f"{mark} " * 300) for k, mark in ((1, "a"), (1, "b"), (1, "c"))]
    got = chunking.chunk_statutes(spark.createDataFrame(rows, "law string, law_no string, article_no string, text string")).orderBy("chunk_index").collect()
    marks = [g["text"].split()[-1] for g in got]
    assert len({g.chunk_id for g in got}) == len(got) == got[0].chunk_total
    assert sum(a != b for a, b in zip(marks, marks[1:])) == 2


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "kira bedeli artar"), (2, "kira sözleşmesi"), (3, "borç borç ödeme")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "kira borç"), (2, "yok")], "query_id int, text string")
    at = str(tmp_path / "index")
    want = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in index.bm25_scores(docs, queries).collect())
    for again in (False, False, True):
        posts, stats = index.saved_index(docs, at, reindex=again)
        assert sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in index.search_saved(posts, stats, queries).collect()) == want
    posts, _ = index.saved_index(docs.filter("doc_id = 1"), at)
    assert posts.select("doc_id").distinct().count() == 3  # kept until it is asked to be made again
    posts, _ = index.saved_index(docs.filter("doc_id = 1"), at, reindex=True)
    assert posts.select("doc_id").distinct().count() == 1


@pytest.mark.parametrize("block", [3, 10_000])
def test_dense_search_equals_brute_force(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(cells, "TILE_QUERIES", block)
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 8))
    base[40:50] = base[3]
    base[7] = 0
    points = [(k, base[k].tolist() if k != 9 else None, None if k % 11 == 0 else "AB"[k % 2]) for k in range(60)]
    queries = [(f"q{k}", base[k].tolist() if k != 5 else None, [None, "A", "B", "C"][k % 4]) for k in range(12)]
    p = spark.createDataFrame(points, "doc_id long, vector array<double>, law string").repartition(5)
    q = spark.createDataFrame(queries, "query_id string, vector array<double>, law string")
    for filtered in (True, False):
        want = set()
        for name, v, law in queries:
            if v is None:
                continue
            near = []
            for k, x, own in points:
                if x is not None and (not filtered or law is None or own == law):
                    size = np.linalg.norm(v) * np.linalg.norm(x)
                    near.append((-round(float(np.dot(v, x)) / size if size else 0.0, 4), k))
            want |= {(name, k, n + 1) for n, (_, k) in enumerate(sorted(near)[:15])}
        assert {(h.query_id, h.doc_id, h["rank"]) for h in vectors.dense_top(q, p, 15, filtered=filtered).collect()} == want


def test_quantised_search(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.normal(size=(200, 32))
    points = spark.createDataFrame([(k, v.tolist(), "A") for k, v in enumerate(x)], "doc_id long, vector array<double>, law string")
    stored = points.select("doc_id", vectors.quantise(F.col("vector")).alias("quantised"), "law")
    queries = points.filter("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    exact = {(h.query_id, h.doc_id) for h in vectors.dense_top(queries, points, 10).collect()}
    small = {(h.query_id, h.doc_id) for h in vectors.quantised_top(queries, stored, 10).collect()}
    assert len(exact & small) >= 0.97 * len(exact)
    rows = stored.select("doc_id", "quantised.scale", vectors.restored(F.col("quantised")).alias("v")).collect()
    assert all(abs(a - b) <= row.scale / 2 + 1e-12 for row in rows for a, b in zip(row.v, x[row.doc_id]))


def test_versions_over_ranges(spark):
    r = random.Random(8)
    rows = [(k, i, r.choice("aab")) for k in ("hot", "x", "y") for i in range(400 if k == "hot" else 7)]
    want, last, number = set(), {}, {}
    for k, i, t in rows:
        if last.get(k) != t:
            number[k] = number.get(k, 0) + 1
            want.add((k, i, number[k]))
        last[k] = t
    got = changes.versions_along(spark.createDataFrame(rows, "k string, i int, t string").repartition(3), "k", "i", "t")
    assert {(g.k, g.i, g.version) for g in got.collect()} == want


def test_exact_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    values = ["Madde 5 uyarınca kira bedeli.", "", None, "é中😀 " * 50]
    plain = Tokenizer.from_file(path)
    assert texts(spark, values, lambda c: models.token_counts(c, path)) == [len(plain.encode(v or "", add_special_tokens=False).ids) for v in values]


def test_blank_questions_go(spark):
    rows = spark.createDataFrame([(1, "x"), (2, " \t\xa0"), (3, None), (4, "")], "query_id int, text string")
    assert [r.query_id for r in entities.asked(rows).collect()] == [1]


def test_answers_equal_a_plain_model(spark):
    docs = {1: ("Kira artar. Bedel düşer. Ev boş.", "TBK", "12"), 2: ("Borç ödenir! Kira yok.", "TTK", None), 3: ("Hiç.", None, "7")}
    asked = [(1, "kira bedel", "info", "kira bedeli nedir"), (2, "borç", None, "borç"), (3, "bulunmaz", "compare", None)]
    hits = [(1, 1, 1), (1, 2, 2), (2, 2, 1)]
    q = spark.createDataFrame(asked, "query_id int, text string, intent string, rewritten string")
    d = spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id int, text string, law string, article_no string")
    h = spark.createDataFrame(hits, "query_id int, doc_id int, rank int").join(d.select("doc_id", "law", "article_no"), "doc_id")
    got = {r.query_id: r for r in answer(q, h, d).collect()}
    for query, text, intent, rewritten in asked:
        own = [d for k, d, _ in sorted(hits, key=lambda x: x[2]) if k == query]
        context = "\n\n".join(f"[{n + 1}] {docs[k][1] or '-'} m.{docs[k][2] or '-'}: {docs[k][0]}" for n, k in enumerate(own))
        sentences = chunking._sentences(context)
        words = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) > 1}
        best = sorted(range(len(sentences)), key=lambda i: (-len(words(text) & words(sentences[i])), i))[:3]
        assert got[query].answer.startswith(" ".join(sentences[i] for i in best))
        assert got[query].intent == intent and got[query].rewritten == (rewritten if rewritten != text else None)
        assert [s.summary for s in got[query].sources or []] == [docs[k][0] + "..." for k in own]


def test_scratch_tables_can_be_released(spark):
    table = written(spark.range(3).toDF("x"), "short-lived")
    assert table.count() == 3 and exists(spark, table._scratch_path)
    release(table, spark.range(1))
    assert not exists(spark, table._scratch_path)
