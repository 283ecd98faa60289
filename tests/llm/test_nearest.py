import numpy as np
import pytest

from tessera.llm import nearest as module
from tessera.llm.nearest import nearest, quantise


def brute(rows, k):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, v) for i, v in rows if i is not None and usable(v)]
    out = []
    for i, q in good:
        if i % 20:
            continue
        found = []
        for j, v in good:
            if j != i and len(v) == len(q):
                s = 0.0
                for x, y in zip(q, v):
                    s += float(np.float32(x)) * float(np.float32(y))
                found.append((-s, j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(module, "GROUP_BLOCKS", 1)
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] + [1.0] * 7), (1080, [None] + [1.0] * 7), (1100, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(1120, [1.0, 2.0, 3.0]), (1121, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = nearest(df.filter("vec_id % 20 = 0"), df, k=20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_error_bounds():
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 33)) * np.exp(r.normal(size=(60, 1)) * 5)
    codes, scale, error, norm = quantise(x)
    got = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    off = error[:, None] * norm[None, :] + (norm + error)[:, None] * error[None, :]
    assert (np.abs(got - x @ x.T) <= off + 1e-12 * norm[:, None] * norm[None, :]).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert nearest(empty, empty).count() == 0 and nearest(one, one).count() == 0 and nearest(one, empty).count() == 0


def test_repeated_rows(spark):
    r = np.random.default_rng(8)
    same, other, far = ([float(x) for x in r.normal(size=8).astype(np.float32)] for _ in range(3))
    rows = [(20, same)] * 5 + [(i, same) for i in range(21, 51)] + [(i, other) for i in (40, 41, 42)] + [(7, far)] * 30 + [(60, far)] * 3
    kind = "vec_id long, embedding array<float>"
    once = [(20, same), (60, far)]
    candidates = spark.createDataFrame(rows, kind)
    got = [tuple(g) for g in nearest(spark.createDataFrame(once * 3, kind), candidates, k=20).collect()]
    want = []
    for i, q in once:
        found = sorted((-sum(float(x) * float(y) for x, y in zip(q, v)), j) for j, v in rows if j != i)[:20]
        want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    assert sorted(got) == sorted(want)
    assert [g[2] for g in sorted(got) if g[0] == 60] == [7] * 20
