"""Dense search over cells against all cosines."""

import numpy as np
import pytest

from tessera.operators import cells
from tessera.operators.vectors import dense_top

POINT = "doc_id long, vector array<double>, law string"
QUERY = "query_id long, vector array<double>, law string"


def plain(points, queries, k, filtered):
    out = []
    for q, v, law in queries:
        if v is None:
            continue
        found = []
        for i, x, own in points:
            if x is None or len(x) != len(v) or (filtered and law is not None and law != own):
                continue
            size = np.linalg.norm(v) * np.linalg.norm(x)
            found.append((-round(float(np.dot(v, x) / size), 4) if size else 0.0, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def same(found, want):
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[3] for x in found], [x[3] for x in want], atol=1.01e-4)
    assert sum(a[2] != b[2] for a, b in zip(found, want)) <= len(want) // 100  # a last digit at a rounding edge


def clustered(seed, n, dim=6, groups=8):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dim))
    return middle[r.integers(0, groups, n)] + 0.15 * r.normal(size=(n, dim)), r


@pytest.mark.parametrize("filtered", [True, False])
def test_against_all_cosines(spark, monkeypatch, filtered):
    monkeypatch.setattr(cells, "BLOCK_POINTS", 20)
    monkeypatch.setattr(cells, "CELL_POINTS", 30)
    monkeypatch.setattr(cells, "TILE_QUERIES", 7)
    monkeypatch.setattr(cells, "FEW_BLOCKS", 5)
    monkeypatch.setattr(cells, "TILE_HEADS", 9)
    x, r = clustered(1, 500)
    points = [(i, v.tolist(), ["a", "b", "c", None][r.integers(0, 4)]) for i, v in enumerate(x)]
    points += [(600 + i, v, "a") for i, v in enumerate([None, [], [0.0] * 6, [0.0] * 6, [1.0, 2.0], [3.0, -1.0], x[3].tolist(), x[3].tolist()])]
    queries = [(i, v.tolist(), ["a", "b", None, "nowhere"][i % 4]) for i, v in enumerate(x[:20])]
    queries += [(50, None, "a"), (51, [0.0] * 6, "a"), (52, [1.0, 1.0], None), (53, [1.0, 1.0, 1.0], None)]
    found = dense_top(spark.createDataFrame(queries, QUERY), spark.createDataFrame(points, POINT).repartition(4), 15, filtered=filtered)
    same(rows(found), plain(points, queries, 15, filtered))


def test_few_blocks_are_visited_and_plan_collects_nothing(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_POINTS", 32)
    monkeypatch.setattr(cells, "CELL_POINTS", 64)
    x, _ = clustered(2, 4000, dim=4, groups=30)
    points = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    queries = [(i, v.tolist(), "a") for i, v in enumerate(x[:25])]
    blocks = cells.built(spark.createDataFrame(points, POINT))
    visited = spark.sparkContext.accumulator(0)
    found = cells.search(spark.createDataFrame(queries, QUERY), blocks, 10, visited=visited)
    same(rows(found), plain(points, queries, 10, True))
    assert sum(r["n"] for r in blocks.select("n").collect()) == 4000
    share = visited.value / (25 * blocks.count())
    assert share < 0.25, share


def test_a_cell_with_all_points_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_POINTS", 16)
    points = [(i, [1.0, 0.001 * i], "a") for i in range(300)]
    blocks = cells.built(spark.createDataFrame(points, POINT).repartition(3))
    sizes = [r["n"] for r in blocks.collect()]
    assert max(sizes) <= 16 and sum(sizes) == 300 and len({r["block"] for r in blocks.collect()}) == len(sizes)
    strings = spark.createDataFrame([("x", [1.0, 0.0], None), ("y", [1.0, 0.0], None), ("z", [0.0, 1.0], None)], "doc_id string, vector array<float>, law string")
    asked = spark.createDataFrame([("q", [1.0, 0.0], None)], "query_id string, vector array<float>, law string").selectExpr("*")
    assert [(r["query_id"], r["doc_id"]) for r in dense_top(asked, strings, 2).orderBy("rank").collect()] == [("q", "x"), ("q", "y")]
    assert dense_top(asked.limit(0), strings, 2).collect() == [] and dense_top(asked, strings.limit(0), 2).collect() == []


@pytest.mark.parametrize("filtered", [True, False])
def test_search_over_bytes_gives_the_same_rows(spark, monkeypatch, filtered):
    from pyspark.sql import functions as F

    from tessera.operators import coded
    from tessera.operators.vectors import quantise, quantised_top

    monkeypatch.setattr(coded, "CHUNK_POINTS", 90)
    monkeypatch.setattr(coded, "TILE_QUERIES", 7)
    x, r = clustered(3, 500)
    points = [(i, (v * 10.0 ** r.integers(-3, 4)).tolist(), ["a", "b", None][r.integers(0, 3)]) for i, v in enumerate(x)]
    points += [(600 + i, v, "a") for i, v in enumerate([None, [], [0.0] * 6, [1.0, 2.0], x[3].tolist(), x[3].tolist(), [1e-9, 1.0, 0.0, 0.0, 0.0, 0.0]])]
    queries = [(i, v.tolist(), ["a", "b", None, "nowhere"][i % 4]) for i, v in enumerate(x[:20])] + [(50, None, "a"), (51, [0.0] * 6, "a"), (52, [1.0, 1.0], None)]
    p = spark.createDataFrame(points, POINT).repartition(4)
    stored = p.select("doc_id", quantise(F.col("vector")).alias("quantised"), "law")
    found = quantised_top(spark.createDataFrame(queries, QUERY), stored, 15, filtered=filtered, whole=p.select("doc_id", "vector"))
    same(rows(found), plain(points, queries, 15, filtered))


def test_bounds_of_codes_hold_and_leave_little():
    from tessera.operators.coded import bounds

    r = np.random.default_rng(4)
    x, q = r.normal(size=(3000, 64)), r.normal(size=(20, 64))
    step = np.abs(x).max(axis=1) / 127
    low, high = bounds(q, np.rint(x / step[:, None]).astype(np.int8))
    true = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    assert (low <= true).all() and (true <= high).all()
    least = np.sort(low, axis=1)[:, -10]
    assert (high >= least[:, None]).sum(axis=1).max() < 100  # of 3,000 vectors
