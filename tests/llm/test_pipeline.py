import random

import pytest

import corpus_pipeline
from tessera.llm import queries


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A small corpus with planted cases: junk, near copies, a shared line."""
    r = random.Random(9)
    words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    line = "this very line of over forty characters is in many documents"
    docs, labels, kind = [], [], {}
    for i in range(400):
        t = text(r.randint(30, 120))
        k = "clean"
        if i % 5 == 0:
            t, k = " ".join(w + "***" for w in t.split()), "junk"
        elif i % 5 == 1:
            t, k = t + "\n" + line, "line"
        elif i % 20 == 2:
            w = docs[i - 15][1].split() if i > 15 and kind[i - 15] == "clean" else t.split()
            t, k = " ".join([*w, "end"]), "near"
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        kind[i] = k
        labels.append((i, 0 if k == "junk" else 1, 0))
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at), kind, line


def test_stages_take_effect(spark, data):
    at, kind, line = data
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, at)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[k] = docs.collect()
    good = {r.doc_id for r in kept[0]}
    assert not {i for i in good if kind[i] == "junk"} and len([i for i in kind if kind[i] != "junk" and i not in good]) <= 3
    assert {r.doc_id for r in kept[1]} == good
    assert sum(line in r.text for r in kept[1]) == 1 and all(r.n_chars == len(r.text) for r in kept[1])
    gone = good - {r.doc_id for r in kept[2]}
    assert gone and all(kind[i] == "near" for i in gone)
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert len(pieces) == len(kept[3])


def test_run_and_rows_without_id(spark, data):
    at, _, _ = data
    assert corpus_pipeline.run(spark, at).count() > 0
    rows = [(None, "one two three four five six", "en", "a", 1), (None, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda d: [r.doc_id for r in corpus_pipeline.jaccard_join(spark, d, at).collect()]
    assert left(docs) == [1]  # rows without an id are judged by their text
    assert left(docs.filter("doc_id = 1")) == [1] and left(docs.filter("doc_id IS NULL")) == [None]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0


def test_rows_are_judged_by_text_not_by_id(spark, data):
    at, _, _ = data
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "uno dos tres cuatro cinco seis")
    rows = [(5, a), (5, b), (6, c), (None, c), (None, "je tu il nous vous ils"), (7, None), (8, ""), (8, ""), (9, a), (None, "je tu il nous vous ils")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, docs, at).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (6, c), (None, "je tu il nous vous ils"), (7, None), (8, ""), (8, "")], key=str)


def test_stages_with_odd_rows(spark, data):
    """Null texts, a very long text, repeated rows, and columns named like those of the stages."""
    at, _, _ = data
    r = random.Random(2)
    long_text = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60000))
    line = "a line of more than forty characters that is in every one of them"
    rows = [(1, None), (2, ""), (3, long_text), (4, f"x y z\n{line}"), *[(10 + k, f"own words number {k} of it\n{line}") for k in range(6)], (4, f"x y z\n{line}"), (None, "lost id")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _copy string, _quality string, _row string, _mix string, `a.b` string"
    docs = spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 1, "c", "q", "r", "m", "ab") for i, t in rows], schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all((g._copy, g._quality, g._row, g._mix, g["a.b"]) == ("c", "q", "r", "m", "ab") for g in got), name
        texts = [g.text for g in got]
        if k == 1:
            assert len(got) == len(rows) and sum(t is not None and line in t for t in texts) == 1 and long_text in texts and None in texts
        if k == 2:
            assert sorted((g.doc_id for g in got), key=str) == sorted([None, 1, 2, 3, 4, *[10 + k for k in range(6)]], key=str)
        if k == 3:
            assert texts.count(f"x y z\n{line}") % 2 == 0 and texts.count(None) == texts.count("")
    assert {p.doc_id for p in corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()} == {i for i, _ in rows}


def test_run_equals_the_stages_one_by_one(spark, data):
    """The whole run against its stages over collected rows, and against brute-force facts of each stage's result."""
    at, kind, line = data
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    fact = lambda rows: sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in rows)
    assert fact(corpus_pipeline.run(spark, at).collect()) == fact(docs.collect())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
