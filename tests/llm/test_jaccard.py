import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard
from tessera.llm.jaccard import CountTree, components, count_vector, fold, most_overlap, packed, prefix_length, similar_components, unpacked


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    low = lambda i: -(1 << 63) if i is None else i
    root = {low(i): low(i) for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(low(rows[a][0])), find(low(rows[b][0]))
                root[max(x, y)] = min(x, y)
    shown = lambda x: None if x == -(1 << 63) else x
    return sorted(((i, len(s), shown(find(low(i)))) for (i, _), s in zip(rows, sets)), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 3)))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(r.choice([3, 5, 6, 12, 40, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
        elif kind < 0.75:
            w = [word() for _ in range(r.randint(5, 60))] + passage + [word() for _ in range(r.randint(0, 60))]
        else:
            w = [word() for _ in range(r.randint(0, 30))]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize("tile", [2048, 8])
def test_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = corpus(tile, 260)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One\ttwo"), (None, rows[0][1]), (1005, "w " * 20000), (1006, rows[3][1]), (1006, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, component_id string")
    got = sorted(map(tuple, similar_components(df).collect()), key=str)
    assert got == brute(rows)


def test_a_chain_is_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(80)]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in brute(rows)}


def test_bounds_hold():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (3, 30, 60, 300, 2000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], sets[0]])) for s in sets]
    vectors = [count_vector(s) for s in sets]
    for s, v in zip(sets, vectors):
        assert (unpacked(packed(v)) == v).all() and v.sum() == len(s)
        for t, w in zip(sets, vectors):
            assert most_overlap(v, w) >= len(np.intersect1d(s, t))
    tree_sets = [np.unique(np.concatenate([sets[3][r.random(len(sets[3])) < 0.93], r.integers(0, 1 << 63, 20).astype(np.uint64)])) for _ in range(200)]
    tree = CountTree(np.array([fold(count_vector(s), 16) for s in tree_sets]).astype(np.int64), np.array([len(s) for s in tree_sets]))
    for i, s in enumerate(tree_sets):
        near = set(tree.near(fold(count_vector(s), 16).astype(np.int64), len(s), 75).tolist())
        for j, t in enumerate(tree_sets):
            both = len(np.intersect1d(s, t))
            if 100 * both >= 75 * (len(s) + len(t) - both):
                assert j in near
    assert [prefix_length(n, 75) for n in (1, 4, 100)] == [1, 2, 26]


def test_components_and_empty_table(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 102), (102, 100)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100, 200} and len(got) == 51 + 3 + 60
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_paths_in_any_order_of_ids(spark, monkeypatch):
    r = random.Random(6)
    falling, mixed, far = [0, *range(299, 0, -1)], r.sample(range(1000, 1600), 600), [2000, *range(3999, 2000, -1)]
    edges = [e for path in (falling, mixed, far) for e in zip(path, path[1:])]
    rounds = []
    plain = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name, *a, **b: rounds.append(name) or plain(df, name, *a, **b))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(path) for path in (falling, mixed, far) for i in path}
    assert rounds.count("components-labels") < 25


def test_long_chains_of_texts_in_any_order_of_ids(spark):
    r = random.Random(7)
    chains = {"f": [0, *range(599, 0, -1)], "m": r.sample(range(1000, 1600), 600)}
    rows = [(i, " ".join(f"{name}{k}" for k in range(7 * at, 7 * at + 60))) for name, ids in chains.items() for at, i in enumerate(ids)]
    got = {x.doc_id: x.component_id for x in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(ids) for ids in chains.values() for i in ids}


@pytest.mark.parametrize("n", [800])
def test_near_misses_make_no_pairs(spark, monkeypatch, n):
    """Texts that differ from one another by a little too much: right components, and rows that grow with the texts, not with pairs."""
    r = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(60), r.choice([1, 2, 2, 3, 3, 4])):
            w[at] = f"x{r.randrange(4000)}"
        rows.append((i, " ".join(w)))
    made = []
    plain = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name, *a, **b: made.append((name, (out := plain(df, name, *a, **b)).count())) or out)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, similar_components(df).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 50  # there are near misses
    assert max(count for name, count in made if name != "jaccard-places") <= 10 * n and sum(count for name, count in made if name == "jaccard-places") <= 20 * n


def test_hot_shingles_and_small_tiles(spark, monkeypatch):
    """Frequent cells, many tiles and small flushes change nothing."""
    for name, value in (("FREQUENT_LEAST", 4), ("FREQUENT_PART", 0.01), ("TILE", 4), ("TILE_ITEMS", 64), ("FLUSH", 500), ("REMEMBERED", 3), ("LEAF", 2), ("FAN", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(5, 200) + [(2000 + k, " ".join(f"v{j}" for j in range(40)) + f" own{k} tail{k}") for k in range(40)]
    got = sorted(map(tuple, similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=str)
    assert got == brute(rows)


def test_tree_finds_all_that_scanning_finds():
    r = np.random.default_rng(3)
    vectors = np.concatenate([r.poisson(1.0, (300, 64)), np.repeat(r.poisson(1.0, (20, 64)), 10, axis=0) + (r.random((200, 64)) < 0.05)]).astype(np.int64)
    sizes = vectors.sum(axis=1)
    tree = CountTree(vectors, sizes)
    for i in range(len(sizes)):
        bound = np.minimum(vectors, vectors[i]).sum(axis=1)
        fits = (sizes * 100 >= 75 * sizes[i]) & (sizes * 75 <= 100 * sizes[i]) & (bound * 175 >= 75 * (sizes + sizes[i]))
        assert set(np.flatnonzero(fits)) <= set(tree.near(vectors[i], int(sizes[i]), 75).tolist())
