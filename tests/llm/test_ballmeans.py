"""Ball k-means against comparing every vector with every centroid."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tessera.llm import ballmeans
from tessera.llm.ballmeans import Balls, ball_kmeans, described

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))])


def plain(rows, k, rounds, scale):
    """Sorted (id, cluster, distance) and the centroids; rows: id, vector."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=str), centroids


@pytest.mark.parametrize("seed,k,dim", [(1, 16, 4), (2, 5, 3), (3, 7, 2)])
def test_against_all_centroids(spark, monkeypatch, seed, k, dim):
    monkeypatch.setattr(ballmeans, "BLOCK_ROWS", 37)
    r = random.Random(seed)
    middle = [[r.uniform(-3, 3) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in r.choice(middle)]) for i in range(400)]
    rows += [(500 + i, [round(2 * r.uniform(-2, 2)) / 2 for _ in range(dim)]) for i in range(200)]  # many ties
    found, centroids = ball_kmeans(spark.createDataFrame(rows, SCHEMA).repartition(5), k, rounds=3, dim=dim, scale=2.0)
    want, last = plain(rows, k, 3, 2.0)
    assert sorted(((x["id"], x["cluster"], x["distance"]) for x in found.collect()), key=str) == want
    assert centroids.tolist() == last
    about = described(found, centroids, spark).collect()
    assert {x["inertia"] for x in about} == {sum(d for _, _, d in want)}
    for x in about:
        assert x["cluster_inertia"] == sum(d for _, c, d in want if c == x["cluster"])
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[x["cluster"]])).encode()).hexdigest()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [5.0, 5.0]), (None, [0.0, -0.1]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-0.5, 0.0])]
    found, centroids = ball_kmeans(spark.createDataFrame(rows, SCHEMA), 4, dim=2, scale=4.0)
    want, last = plain([(i, v) for i, v in rows if v in ([1.0, 2.0], [5.0, 5.0], [0.0, -0.1], [-0.5, 0.0])], 4, 3, 4.0)
    assert sorted(((x["id"], x["cluster"], x["distance"]) for x in found.collect()), key=str) == want and centroids.tolist() == last
    none, centroids = ball_kmeans(spark.createDataFrame(rows[4:10], SCHEMA), 4, dim=2)
    assert described(none, centroids, spark).collect() == [] and len(centroids) == 0
    few, centroids = ball_kmeans(spark.createDataFrame([(1, [1.0, 1.0], 5)], "vec_id long, embedding array<float>, Cluster int"), 4, dim=2)
    assert len(centroids) == 1 and few.columns == ["id", "cluster", "distance"]
    with pytest.raises(Exception, match="after scaling"):
        ball_kmeans(spark.createDataFrame([(1, [1e30, 1.0])], SCHEMA), 4, dim=2)


def test_core_and_annuli_spare_distances():
    r = np.random.default_rng(4)
    centroids = r.integers(-2000, 2000, (16, 8))
    x = centroids[r.integers(0, 16, 5000)] + r.integers(-60, 60, (5000, 8))
    all_ = Balls(centroids)
    own, away, made = all_.assign(x, np.zeros(0, np.int32))
    radii = [int(np.sqrt(away[own == j].max(initial=0))) + 1 for j in range(16)]
    again, same, fewer = Balls(centroids, radii).assign(x, own)
    assert (again == own).all() and (same == away).all() and made == 16 * 5000 and fewer < 5000 * 1.5
