from pathlib import Path

import numpy as np
import pytest

from quarry.llm import clusters as c
from quarry.plans import lineage


def table(spark, rows):
    return spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id BIGINT, dim INT, val DOUBLE, node INT, pair STRING")


def brute(vectors, t):
    ids = sorted(vectors)
    at = {d: i for i, d in enumerate(sorted({d for v in vectors.values() for d in v}))}
    x = np.zeros((len(ids), len(at)))
    for i, k in enumerate(ids):
        for d, w in vectors[k].items():
            x[i, at[d]] = w
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    comp = list(range(len(ids)))
    s = x @ x.T
    for i in range(len(ids)):
        for j in range(i):
            if s[i, j] >= t - 1e-9 and comp[i] != comp[j]:
                a, b = min(comp[i], comp[j]), max(comp[i], comp[j])
                comp = [a if q == b else q for q in comp]
    size = {q: comp.count(q) for q in set(comp)}
    return {(ids[i], ids[comp[i]]) for i in range(len(ids)) if size[comp[i]] > 1}


def made(seed, n=150):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        if i and rng.random() < 0.6:  # drift from an earlier one: chains
            v = dict(out[int(rng.integers(0, i))])
            for d in list(v):
                v[d] = max(0.1, v[d] + rng.normal(0, 0.5))
            v[int(rng.integers(0, 60))] = float(rng.random() + 0.1)
        else:
            v = {int(d): float(rng.integers(1, 5)) for d in rng.choice(60, int(rng.integers(1, 12)), replace=False)}
        out[i] = v
    return out


def rows(vectors):
    return [(i, d, w) for i, v in vectors.items() for d, w in v.items()]


@pytest.mark.parametrize(("seed", "t"), [(0, 0.8), (1, 0.8), (2, 0.6)])
def test_groups_are_exact(spark, seed, t):
    v = made(seed)
    dirty = [(0, -1, 9.0), (1, 3, None), (None, 3, 1.0), (2, None, 1.0), (3, 5, float("nan")), (700, 4, 0.0)]
    dirty += [(i, d, w) for i, x in list(v.items())[:20] for d, w in x.items()]
    got = [tuple(r)[:2] for r in c.similarity_clusters(table(spark, rows(v) + dirty), similarity=t).groups().collect()]
    assert set(got) == brute(v, t) and len(got) == len(set(got))


def test_links_are_exact(spark):
    """Forty vectors that are all alike: far more links than any node has best neighbours."""
    rng = np.random.default_rng(8)
    v = {i: {int(d): 4.0 + float(rng.random()) for d in rng.choice(14, 13, replace=False)} for i in range(40)} | {100 + i: x for i, x in made(5, 60).items()}
    x = np.zeros((200, 60))
    for i, e in v.items():
        x[i, list(e)] = list(e.values())
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {(int(i), int(j)) for i, j in np.argwhere(x @ x.T >= 0.8 - 1e-9) if i < j}
    got = c.similarity_clusters(table(spark, rows(v)))
    assert {(r["u"], r["v"]) for r in got.edges.collect()} == want
    for r in got.groups().collect():
        assert r["n_links"] == sum(r["doc_id"] in e for e in want)


def test_check_finds_what_the_graph_misses(spark, monkeypatch):
    """With no start of the graph at all, the exact check still ties every group."""
    monkeypatch.setattr(c, "_adjacent", lambda keys: keys.select(c.F.col("node").alias("u"), c.F.col("node").alias("v")).limit(0))
    v = made(3, 80)
    assert {tuple(r)[:2] for r in c.similarity_clusters(table(spark, rows(v))).groups().collect()} == brute(v, 0.8)


def test_crowded_pairs(spark, monkeypatch):
    """Pairs of dims that more nodes share than meet in one group: in blocks, with the same links."""
    v = made(1)
    got = c.similarity_clusters(table(spark, rows(v)))
    want = {(r["u"], r["v"]) for r in got.edges.collect()}
    monkeypatch.setattr(c, "CROWD", 2)
    monkeypatch.setattr(c, "LONG", 6)
    got = c.similarity_clusters(table(spark, rows(v)))
    assert {tuple(r)[:2] for r in got.groups().collect()} == brute(v, 0.8)
    assert {(r["u"], r["v"]) for r in got.edges.collect()} == want and len(want) > 20


def test_communities_are_no_worse_than_components(spark):
    """Modularity of the settled communities is at least that of the groups."""
    edges = c.similarity_clusters(table(spark, rows(made(2, 200)))).edges
    link = [(r["u"], r["v"], r["sim"]) for r in edges.collect()]

    def modularity(part):
        twice, deg = 2 * sum(w for *_, w in link), {}
        for u, v, w in link:
            deg[u], deg[v] = deg.get(u, 0) + w, deg.get(v, 0) + w
        inside = sum(2 * w for u, v, w in link if part[u] == part[v]) / twice
        tot = {}
        for n, x in deg.items():
            tot[part[n]] = tot.get(part[n], 0) + x
        return inside - sum((x / twice) ** 2 for x in tot.values())

    com = {r["node"]: r["community"] for r in c.communities(edges).collect()}
    comp = {r["node"]: r["comp"] for r in c.components(edges).collect()}
    assert modularity(com) >= modularity(comp) - 1e-12 and len(set(com.values())) >= len(set(comp.values()))


def test_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(c, "LONG", 5)
    v = made(7)
    assert {tuple(r)[:2] for r in c.similarity_clusters(table(spark, rows(v))).groups().collect()} == brute(v, 0.8)


def test_copies_are_one_node(spark):
    v = {i: {1: 1.0 + i, 2: 2.0 + 2 * i} for i in range(30)} | {50: {9: 1.0}, 51: {8: 1.0}}
    got = c.similarity_clusters(table(spark, rows(v)))
    assert {tuple(r)[:2] for r in got.groups().collect()} == {(i, 0) for i in range(30)}
    d = got.described().collect()
    assert len(d) == 1 and d[0]["n_docs"] == 30 and d[0]["n_vectors"] == 1 and d[0]["typical"] == [0]


def test_communities_split_a_bridge(spark):
    edge = [(a, b, 1.0) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 0.5)]
    got = {r["node"]: r["community"] for r in c.communities(spark.createDataFrame(edge, "u BIGINT, v BIGINT, sim DOUBLE"), 20).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


@pytest.mark.parametrize("apart", [200_000, 0])
def test_communities_settle(spark, monkeypatch, apart):
    """With the production default no node has a better neighbouring community, nor two merge."""
    monkeypatch.setattr(c, "APART", apart)
    rng = np.random.default_rng(9)
    chain = [(i, i + 1, 1.0) for i in range(40)]  # settles slowly
    edge = chain + [(100 + i, 100 + j, float(0.8 + 0.2 * rng.random())) for i in range(40) for j in range(i + 1, 40) if rng.random() < (0.5 if i // 10 == j // 10 else 0.05)]
    com = {r["node"]: r["community"] for r in c.communities(spark.createDataFrame(edge, "u BIGINT, v BIGINT, sim DOUBLE")).collect()}
    ids = sorted(com)
    w = np.zeros((len(ids), len(ids)))
    for u, v, s in edge:
        w[ids.index(u), ids.index(v)] = w[ids.index(v), ids.index(u)] = s
    names = sorted(set(com.values()))
    m = np.array([[com[i] == n for n in names] for i in ids], float)
    assert all(min(i for i in ids if com[i] == n) == n for n in names)
    deg, twice = w.sum(1), w.sum()
    link, tot = m.T @ w @ m, m.T @ deg
    gain = link - np.outer(tot, tot) / twice
    assert (gain[~np.eye(len(names), dtype=bool)] <= 1e-8).all()
    if apart == 0:
        state = {r["node"]: r["com"] for r in c._settled_together(spark.createDataFrame(edge, "u BIGINT, v BIGINT, sim DOUBLE"), float(twice), 1000).collect()}
        one = np.array([[state[i] == n for n in sorted(set(state.values()))] for i in ids], float)
        score = w @ one - deg[:, None] * (one.T @ deg - one * deg[:, None]) / twice
        assert (score.max(1, where=w @ one > 0, initial=-np.inf) <= (score * one).sum(1) + 1e-8).all()


def test_described(spark):
    v = made(4)
    got = c.similarity_clusters(table(spark, rows(v)))
    groups, d = got.groups().collect(), got.described().collect()
    assert sum(r["n_docs"] for r in d) == len(groups)
    assert {t for r in d for t in r["typical"]} <= {r["doc_id"] for r in groups} and all(1 <= len(r["typical"]) <= 5 for r in d)


def test_prefix_pairs_always_meet():
    rng = np.random.default_rng(6)
    for _ in range(300):
        d = np.sort(rng.choice(30, int(rng.integers(1, 15)), replace=False))
        x = rng.exponential(size=len(d))
        y = np.maximum(x + rng.normal(0, 0.4, len(d)), 0)
        keep = y > 0.05
        if not keep.any():
            continue
        x, dy, y = x / np.linalg.norm(x), d[keep], y[keep] / np.linalg.norm(y[keep])
        if float(x[keep] @ y) >= 0.8:
            for single in (False, True):
                assert set(c.prefix_pairs(d, x, 0.8, single).tolist()) & set(c.prefix_pairs(dy, y, 0.8, single).tolist())


def test_empty_and_bad(spark):
    got = c.similarity_clusters(table(spark, []))
    assert got.groups().count() == 0 and got.described().count() == 0
    with pytest.raises(ValueError):
        c.similarity_clusters(table(spark, []), similarity=0)


def test_small_room(spark, monkeypatch):
    """Many ranges of keys, classes of nodes and parts of pairs: the same groups and links."""
    v = made(1)
    got = c.similarity_clusters(table(spark, rows(v)))
    want = {(r["u"], r["v"]): r["sim"] for r in got.edges.collect()}
    monkeypatch.setattr(c, "LONG", 8)
    monkeypatch.setattr(c, "CROWD", 10)
    monkeypatch.setattr(c, "ROOM", 60_000)
    monkeypatch.setattr(c, "_bytes", lambda t: 10_000)
    got = c.similarity_clusters(table(spark, rows(v)))
    assert {tuple(r)[:2] for r in got.groups().collect()} == brute(v, 0.8)
    assert {(r["u"], r["v"]): r["sim"] for r in got.edges.collect()} == pytest.approx(want) and len(want) > 20


def test_shared_buckets():
    """All 64 bits of a word count, the sign among them."""
    x = {b: np.array([-1, -1, 3], np.int64) for b in c.BITS} | {"need": np.array([200, 256, 8])}
    assert c._shared(x, np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [True, False, False]
    assert c._shared(x, np.array([2]), np.array([2])).tolist() == [True]


def test_disk_follows_the_vectors(spark, monkeypatch):
    """Keys are on disk a part at a time: all tables together take less than the keys would alone."""
    monkeypatch.setattr(c, "ROOM", 1_000_000, raising=False)
    rng = np.random.default_rng(3)
    v = {i: {int(d): float(rng.integers(1, 4)) for d in rng.choice(400, 16, replace=False)} for i in range(2_000)}
    most, write = 0, c.materialize
    root = Path(lineage.shared_root(spark).removeprefix("file://"))
    on_disk = lambda: sum(p.stat().st_size for p in root.rglob("*.parquet"))
    base = on_disk()

    def written(df, name="t"):
        nonlocal most
        got = write(df, name)
        most = max(most, on_disk() - base)
        return got

    monkeypatch.setattr(c, "materialize", written)
    assert c.similarity_clusters(table(spark, rows(v))).assigned().count() == 0
    unit = [(np.array(list(e)), np.array(list(e.values())) / np.linalg.norm(list(e.values()))) for e in v.values()]
    keys = sum(len(c.prefix_pairs(d, w, 0.8)) for d, w in unit)
    assert 0 < most < 8 * keys, (most, keys)  # a key is a number of 8 bytes at least
