import re
from collections import defaultdict

import pytest

from tessera.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, mix string, src int, size string"


def rows(n, seed=0):
    import random

    r = random.Random(seed)
    out = [(i, " ".join("w" for _ in range(r.choice([1, 5, 20, 60]))), r.choice(["a", "a", "a", "b", "c", None]), "x", 1, "y") for i in range(n)]
    return [*out, (None, None, "b", None, None, None), (7, "", "c", None, None, None), (8, " \t ", None, None, None, None), *[(9, "same words here", "a", "x", 1, "y")] * 30]


def test_targets_and_takes(spark):
    data = rows(600)
    got = mix_sources(spark.createDataFrame(data, SCHEMA), max_repeat=3).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = defaultdict(int)
    for d in data:
        words[d[2]] += size(d[1])
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(words.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * words[s]]
        if not over:
            break
        fixed |= {s: 3 * words[s] for s in over}
    target = {s: fixed.get(s, level * weight[s]) for s in order}
    taken = defaultdict(int)
    for g in got:
        assert g.mix.size == size(g.text) and g.mix.source_size == words[g.source]
        assert g.mix.target == pytest.approx(target[g.source])
        assert 0 <= g.mix.taken <= 3 * g.mix.size and g.mix.taken == g.mix.copies * g.mix.size
        taken[g.source] += g.mix.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(60, 0.03 * target[s])
    assert {g.mix.copies for g in got if g.doc_id == 9 and g.text == "same words here"}.__len__() == 1  # equal rows share their fate
    assert got and sorted(map(str, got)) == sorted(map(str, mix_sources(spark.createDataFrame(data, SCHEMA), max_repeat=3).collect()))


def test_weights_of_documents_raise_their_chance(spark):
    data = [(i, "one two three", "a", 3.0 if i % 2 else 1.0) for i in range(2000)] + [(5000 + i, "one two three", "b", 1.0) for i in range(2000)]
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string, w double"), weights=(1.0, 3.0), doc_weight="w", max_repeat=3).collect()
    a = [g for g in got if g.source == "a"]
    high = sum(g.mix.copies for g in a if g.w == 3.0)
    low = sum(g.mix.copies for g in a if g.w == 1.0)
    assert abs(3 * (high + low) - a[0].mix.target) <= 3
    assert 2.5 <= high / low <= 3.5


def test_empty_table_and_empty_sources(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, None, "a", None, None, None), (2, "", "b", None, None, None)], SCHEMA)).collect()
    assert [(g.mix.taken, g.mix.copies) for g in got] == [(0, 0), (0, 0)]


def taken_and_target(got):
    taken, target = defaultdict(int), {}
    for g in got:
        taken[g.source] += g.mix.taken
        target[g.source] = g.mix.target
    return {s: (taken[s], target[s]) for s in taken}


@pytest.mark.parametrize("weights", [(5.0, 2.0, 1.0), (3.0,), (0.7,)])
def test_one_source_is_taken_once(spark, weights):
    for source in ("only", None):
        data = [(i, "w " * (1 + i % 50), source) for i in range(500)]
        got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=weights).collect()
        assert {g.mix.copies for g in got} == {1}


def test_whole_rates_give_whole_copies(spark):
    data = [(i, "w w w w", "a") for i in range(100)] + [(i, "w w w w", "b") for i in range(100, 400)]
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=(1.0, 1.0), max_repeat=3).collect()
    assert {g.mix.copies for g in got if g.source == "a"} == {2}
    assert taken_and_target(got) == {"a": (800, 800.0), "b": (800, 800.0)}


def test_very_long_documents_cost_no_accuracy(spark):
    import random

    r = random.Random(3)
    data = [(i, "w " * (r.choice([4000, 9000, 20000]) if i % 100 == 0 else r.randint(1, 60)), r.choice("ab")) for i in range(3000)] + [(5000, "w " * 3, "a")] * 40
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=(3.0, 2.0), max_repeat=3).collect()
    for taken, target in taken_and_target(got).values():
        assert abs(taken - target) <= 30
    assert len({g.mix.copies for g in got if g.doc_id == 5000}) == 1


def test_clashing_name_of_another_case(spark):
    from tessera.llm.mixing import mix_sources

    out = mix_sources(spark.createDataFrame([(i, "some words here", "ab"[i % 2], 7) for i in range(20)], "doc_id long, text string, source string, Mix int"))
    assert out.columns == ["doc_id", "text", "source", "mix"] and out.agg({"mix.size": "sum"}).first()[0] == 60
