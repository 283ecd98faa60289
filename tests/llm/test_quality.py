import random

import numpy as np
import pyarrow as pa

from tessera.llm import quality
from tessera.llm.quality import classify, features, fit_ordinal, graded


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts, grades = [], []
    for _ in range(n):
        g = r.randrange(3)
        t = [r.choice(words) for _ in range(r.randint(20, 80))]
        if g == 0:
            t = [w + "***" for w in t] + ["awful"] * 3
        elif g == 1:
            t.insert(3, "awful")
        texts.append(" ".join(t))
        grades.append(g)
    return texts, np.array(grades)


def test_held_out_accuracy_and_order():
    texts, grades = corpus(900, 1)
    rows = list(features(pa.array(texts)))
    model = fit_ordinal(rows[:600], grades[:600], 3)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(model.score(pa.array(texts[600:])))
    assert (tails[:, 0] >= tails[:, 1]).all()
    guess = (tails > 0.5).sum(axis=1)
    assert (guess == grades[600:]).mean() > 0.9


def test_spark_scores_every_row(spark):
    texts, grades = corpus(400, 2)
    docs = [(i, t, "kept") for i, t in enumerate(texts)] + [(900, None, None), (901, "", None), (None, "awful", None), (902, "x " * 50000, None), (3, texts[3], "kept")]
    labels = [(i, int(g)) for i, g in enumerate(grades)] + [(None, 1), (5000, 2), (2, None), (4, 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    rated = spark.createDataFrame(labels, "doc_id long, grade int")
    got = classify(frame, rated).collect()
    assert len(got) == len(docs)
    good = [g.quality.keep for g in got if g.doc_id is not None and g.doc_id < 400]
    assert np.mean([k == (grades[g.doc_id] == 2) for k, g in zip(good, [g for g in got if g.doc_id is not None and g.doc_id < 400])]) > 0.9
    assert sorted(map(str, got)) == sorted(map(str, classify(frame, rated).collect()))


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [(g.quality.expected, g.quality.keep) for g in classify(docs, none).collect()] == [(None, True)] * 2
    assert classify(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in graded(labels).orderBy("doc_id").collect()] == [1, 1, 2, None]


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {k % 50}") for k in range(3000)] + [(k, f"own {k}") for k in range(2, 12)] + [(12, None)], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(1, 13)], "doc_id long, grade int")
    got = quality.sample_rated(docs, ratings, levels=3, sample=30).collect()
    assert sorted((g.text or "", g.grade) for g in got) == sorted([("text 0", 1), ("", 0), *((f"own {k}", k % 3) for k in range(2, 12))])


def test_clashing_name_of_another_case(spark):
    from tessera.llm.quality import score

    out = score(spark.createDataFrame([("a text", 3)], "text string, QUALITY int"), None)
    assert out.columns == ["text", "quality"] and out.first()["quality"]["keep"]


def test_ratings_of_absent_documents_take_no_place(spark):
    from tessera.llm.quality import sample_rated

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)] + [(None, "no id")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1000, 3000)] + [(i, i % 3) for i in range(10)] + [(None, 1)], "doc_id long, grade int")
    assert sample_rated(docs, ratings, levels=3, sample=30).count() == 10
    assert sample_rated(docs, ratings, levels=3, sample=6).count() == 6
