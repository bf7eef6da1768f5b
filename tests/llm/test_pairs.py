from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import pairs as p


def brute(baskets):
    """baskets: (set, weight)"""
    one, two, n = Counter(), Counter(), 0
    for s, w in baskets:
        n += w
        one.update({i: w for i in s})
        two.update({c: w for c in combinations(sorted(s), 2)})
    return {(a, b): (c, one[a], one[b], n) for (a, b), c in two.items()}


def made(seed=0, n=400, items=60):
    rng = np.random.default_rng(seed)
    out = {}
    for t in range(n):
        s = set((rng.zipf(1.6, int(rng.integers(1, 9))) % items + 1).tolist())
        out[t] = s | ({7} if t % 3 == 0 else set())
    return out


def lines(spark, sets, extra=()):
    rows = [(t, i, "x", 1) for t, s in sets.items() for i in s] + list(extra)
    return spark.createDataFrame(rows, "tid INT, item INT, bid STRING, w INT")


def result(df):
    return {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in df.collect()}


DIRTY = [(0, None, "x", 1), (None, 3, "x", 1), (0, 0, "x", 1), (0, -4, None, None), (9999, 0, "x", 1)]


@pytest.mark.parametrize("big", [20_000, 4])
def test_all_pairs(spark, big):
    sets = made()
    again = [(t, i, "y", 2) for t, s in list(sets.items())[:50] for i in s]
    got = result(p.cooccurrence(lines(spark, sets, DIRTY + again), big=big))
    assert got == brute([(s, 1) for s in sets.values()])


@pytest.mark.parametrize("need", [5, 20])
def test_min_count_loses_nothing(spark, need, monkeypatch):
    monkeypatch.setattr(p, "BLOCK_ITEMS", 300)
    sets = made(1)
    got = result(p.cooccurrence(lines(spark, sets, DIRTY), min_count=need, min_share=0.01))
    want = {k: v for k, v in brute([(s, 1) for s in sets.values()]).items() if v[0] >= max(need, 4)}
    assert got == want and want


@pytest.mark.parametrize("big", [20_000, 5])
def test_candidates_in_groups(spark, monkeypatch, big):
    """More candidates than one pass takes, with and without baskets too large for a block."""
    monkeypatch.setattr(p, "GROUP", 30)
    monkeypatch.setattr(p, "BLOCK_ITEMS", 300)
    sets = made(2)
    got = result(p.cooccurrence(lines(spark, sets), min_count=6, big=big))
    assert got == {k: v for k, v in brute([(s, 1) for s in sets.values()]).items() if v[0] >= 6}


def test_trees(spark):
    nodes = [
        (1, 1, None, None, 10), (1, 2, 1, 5, 6), (1, 3, 2, 6, 4), (1, 4, 3, 7, 1), (1, 5, 1, 6, 3), (1, 5, 1, 6, 3),
        (2, 10, None, None, 2), (2, 11, 10, 7, 2), (None, None, 1, 3, 4), (2, 12, 11, None, None),
    ]
    df = spark.createDataFrame(nodes, "tree_no INT, node_id BIGINT, parent_id BIGINT, item INT, node_count BIGINT")
    base = made(3, 20)
    got = result(p.cooccurrence(lines(spark, base), df))
    trees = [({5}, 2), ({5, 6}, 3), ({5, 6, 7}, 1), ({6}, 3), (set(), 1), ({7}, 2)]
    assert got == brute([(s, 1) for s in base.values()] + trees)


def test_circle_of_parents_raises(spark):
    df = spark.createDataFrame([(1, 1, 2, 5, 3), (1, 2, 1, 6, 3)], "tree_no INT, node_id BIGINT, parent_id BIGINT, item INT, node_count BIGINT")
    with pytest.raises(ValueError, match="circle"):
        p.cooccurrence(lines(spark, made(3, 5)), df)


def test_long_paths(spark):
    nodes = [(1, 0, None, None, 1)] + [(1, i, i - 1, i, 1) for i in range(1, 40)]
    df = spark.createDataFrame(nodes, "tree_no INT, node_id BIGINT, parent_id BIGINT, item INT, node_count BIGINT")
    assert p.cooccurrence(lines(spark, {}), df).count() == 39 * 38 // 2


def test_lift_and_empty(spark):
    got = p.cooccurrence(lines(spark, {1: {1, 2}, 2: {1, 2}, 3: {3}, 4: {1}})).collect()
    assert len(got) == 1 and got[0]["lift"] == pytest.approx(2 * 4 / (3 * 2))
    assert p.cooccurrence(lines(spark, {})).count() == 0


def test_block_kinds_agree():
    """Heavy, mixed and light counting against plain counting, weights included."""
    rng = np.random.default_rng(5)
    sets = [sorted(set(rng.integers(1, 30, int(rng.integers(1, 12))).tolist())) for _ in range(200)]
    w = rng.integers(1, 9, 200)
    want = {k: v[0] for k, v in brute(list(zip(map(set, sets), w.tolist()))).items()}
    for heavy in ([], [1, 2, 3, 4], list(range(1, 30))):
        a, b, n = p._count_block(np.concatenate([np.array(s) for s in sets]), np.array(list(map(len, sets))), w, np.array(heavy, int))
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want
