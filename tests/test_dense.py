import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import vectors as fn
from quarry.operators import matrix, nearest, neighbours, ridge
from quarry.queries import dense

# fixed values: the three-feature toy set of the classic programs
TRAIN = [(0, 0, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 2, [0.0, 0.0, 1.0])]


def table(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, label INT, features ARRAY<DOUBLE>")


def brute(train, test, k, by):
    out = {}
    for i, _, x in test:
        x, scored = np.array(x), []
        for j, _, y in train:
            y = np.array(y)
            d, p, q = x @ y, x @ x, y @ y
            if by == "l2":
                scored.append((round(float(p + q - 2 * d), 6), j))
            else:
                den = np.sqrt(p) * np.sqrt(q) if by == "cosine" else p + q - d
                if den:
                    scored.append((-round(float(d / den), 9), j))
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("by", ["l2", "cosine", "jaccard"])
def test_neighbours(spark, by, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 7)
    monkeypatch.setattr(neighbours, "CHUNK", 5)
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), rng.integers(0, 4, 6).astype(float).tolist()) for i in range(40)] + [(99, 0, [0.0] * 6)]
    train, test = rows[:25] + rows[40:], rows[25:40]
    got = neighbours.neighbours(table(spark, train), table(spark, test), 4, by).orderBy("id", "rank").collect()
    mine = {}
    for r in got:
        mine.setdefault(r["id"], []).append(r["nb_id"])
    assert mine == brute(train, test, 4, by)


def test_fewer_rows_than_k(spark):
    got = neighbours.neighbours(table(spark, TRAIN), table(spark, TRAIN[:1]), 20, "l2")
    assert got.count() == 3


def test_vote_ties_take_smallest_label(spark):
    ranked = spark.createDataFrame([(1, 0, 2, 1), (1, 0, 1, 2), (1, 0, 0, 3)], "id BIGINT, label INT, nb_label INT, rank INT")
    assert neighbours.vote(ranked, 3).first()["pred"] == 0
    assert neighbours.vote(ranked, 1).first()["pred"] == 2
    assert neighbours.choose_k(ranked, 3) == 3


def test_measures(spark):
    assert fn.measure(1) is fn.measure("L2") and fn.measure(3) is fn.measure("Jaccard")
    for bad in ("x", 9):
        with pytest.raises(ValueError):
            fn.measure(bad)
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert df.select(fn.cosine(F.col("a"), F.col("b")), fn.sq_euclidean(F.col("a"), F.col("b"))).first()[:] == (None, 5.0)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] > 0).astype(int)
    df = table(spark, [(i, int(y[i]), x[i].tolist()) for i in range(60)])
    s = ridge.statistics(df, 4)
    w, _ = ridge.descend(s, 0.5, tol=1e-14)
    for k, lab in enumerate(s.labels):
        t = np.where(y == lab, 1.0, -1.0)
        assert w[k] == pytest.approx(np.linalg.solve(x.T @ x + 0.5 * np.eye(4), x.T @ t), abs=1e-6)
        assert ridge.objective(s, k, w[k], 0.5) == pytest.approx(float(((x @ w[k] - t) ** 2).sum() + 0.5 * w[k] @ w[k]))


def trained(x, y, labels, lam, nonneg):
    """Weights by label from the rows themselves, until the objective falls by at most 1e-4 of itself."""
    out = []
    for lab in labels:
        t = np.where(y == lab, 1.0, 0.0 if nonneg else -1.0)
        w = np.zeros(x.shape[1])
        value = lambda: float(((x @ w - t) ** 2).sum() + lam * w @ w)  # noqa: B023, E731
        last, now = np.inf, value()
        while last == np.inf or last - now > 1e-4 * last:
            for i in range(len(w)):
                w[i] = 0.0
                top = x[:, i] @ (t - x @ w)
                w[i] = max(top, 0.0) / (x[:, i] @ x[:, i] + lam) if nonneg else top / (x[:, i] @ x[:, i] + lam)
            last, now = now, value()
        out.append((w, now))
    return np.array([w for w, _ in out]), [v for _, v in out]


def test_trained_queries(spark, tmp_path):
    """Correlated features: three sweeps are far from trained weights."""
    rng = np.random.default_rng(11)
    base = rng.random((180, 49))
    x = base + 3 * rng.random((180, 1))
    y = base[:, :3].argmax(1)
    split = np.array(["train", "valid", "test"])[np.arange(180) % 3]
    table = spark.createDataFrame([(i, int(y[i]), str(split[i]), x[i].tolist()) for i in range(180)], "id BIGINT, label INT, split STRING, features ARRAY<DOUBLE>")
    table.write.parquet(str(tmp_path / "dense_labelled.parquet"))
    run = lambda name: dense.QUERIES[name](spark, str(tmp_path)).collect()
    xt, yt = x[split == "train"], y[split == "train"]
    w, values = trained(xt, yt, range(3), dense.LAM, False)
    assert [r["objective"] for r in sorted(run("ridge_objective_trained"))] == pytest.approx(values, abs=1e-3)
    assert max(abs(a["objective"] - v) for a, v in zip(sorted(run("ridge_objective")), values)) > 0.1
    at = np.flatnonzero(split == "test")
    assert {r["id"]: r["pred"] for r in run("ridge_predict_trained")} == dict(zip(at.tolist(), (x[at] @ w.T).argmax(1).tolist()))
    for nonneg, name in ((False, "ridge_validate_lambda_trained"), (True, "nn_ridge_validate_lambda_trained")):
        got, at = {r["lam"]: r["accuracy"] for r in run(name)}, split == "valid"
        for lam in ridge.LAMBDAS:
            assert got[lam] == pytest.approx(((x[at] @ trained(xt, yt, range(3), lam, nonneg)[0].T).argmax(1) == y[at]).mean(), abs=1e-9)


def test_nonnegative_ridge_kkt(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    y = (x[:, 1] > 0).astype(int)
    s = ridge.statistics(table(spark, [(i, int(y[i]), x[i].tolist()) for i in range(50)]), 4, nonneg=True)
    w, _ = ridge.descend(s, 0.1, nonneg=True, tol=1e-14)
    for k in range(2):
        g = s.g @ w[k] - s.b[k] + 0.1 * w[k]
        assert (w[k] >= 0).all() and (g[w[k] == 0] >= -1e-6).all() and np.abs(g[w[k] > 0]).max(initial=0) < 1e-4


def test_classify(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (np.eye(3)[i % 3] + rng.normal(0, 0.05, 3)).tolist()) for i in range(45)]
    a, b, c = (table(spark, rows[i::3] if False else rows[15 * i : 15 * i + 15]) for i in range(3))
    for got in (neighbours.classify(a, b, c, 5), ridge.classify(a, b, c, 3), ridge.classify(a, b, c, 3, nonneg=True)):
        assert all(r["pred"] == r["label"] for r in got.collect()) and got.count() == 15


def test_svd_and_gram(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 5))
    df = table(spark, [(i, 0, x[i].tolist()) for i in range(30)])
    values, _ = matrix.singular_values(df, 5, 5)
    assert values == pytest.approx(np.linalg.svd(x, compute_uv=False))
    assert (values**2).sum() == pytest.approx(np.trace(matrix.gram_matrix(df, 5)))
    us = np.array([r["features"] for r in matrix.svd_project(df, 5, 2).orderBy("id").collect()])
    assert us.T @ us == pytest.approx(np.diag(values[:2] ** 2), abs=1e-8)


def test_block_mean(spark):
    df = table(spark, [(1, 0, [float(i) for i in range(16)])])
    got = {(r["br"], r["bc"]): r["val"] for r in matrix.block_mean(df, 4, 4, 2).collect()}
    assert got == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=8))
def test_block_measures_agree(pairs):
    a, b = (np.array([[float(p[i]) for p in pairs]]) for i in (0, 1))
    d, p, q = a @ b.T, (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    assert fn.MEASURES["l2"].block(d, p, q)[0, 0] == ((a - b) ** 2).sum()
    c = fn.MEASURES["cosine"].block(d, p, q)[0, 0]
    assert np.isnan(c) == (p[0, 0] == 0 or q[0, 0] == 0)


@pytest.mark.parametrize("kind", ["ties", "tiny", "outlier", "multiples", "beyond squares"])
def test_nearest_others(spark, kind, monkeypatch):
    """Blocks of single precision that only rule out give what scoring every pair gives, copies and ties included."""
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "CHUNK", 30)
    rng = np.random.default_rng(7)
    x = {
        "ties": rng.integers(0, 3, (60, 4)).astype(float),
        "tiny": rng.normal(size=(60, 5)) * 1e-4,
        "outlier": np.vstack([rng.normal(size=(57, 5)), 1e9 * rng.normal(size=(3, 5))]),
        "multiples": np.vstack([np.outer(rng.integers(1, 9, 40), [1.0, 2, 3, 4]), np.zeros((3, 4)), -np.outer(rng.integers(1, 4, 17), [1.0, 2, 3, 4])]),
        "beyond squares": np.vstack([rng.normal(size=(58, 3)), [[1e200] * 3, [1e200, 1e200, 3e199]]]),
    }[kind]
    half = lambda v: v[:, :2] / 2
    forms = [(f, by) for f in (None, half) for by in ("l2", "cosine", "jaccard")]
    rows = lambda v: table(spark, [(3 * int(i) + 1, int(i % 3), y.tolist()) for i, y in zip(np.random.default_rng(1).permutation(60), v)])
    got = nearest.nearest_others(rows(x), forms).collect()
    for k, (f, by) in enumerate(forms):
        all_pairs = neighbours.neighbours(rows(f(x) if f else x), rows(f(x) if f else x), 1, by, skip_self=True)
        want = sorted(tuple(r) for r in all_pairs.select("id", "label", "nb_id", "nb_label").collect())
        assert sorted(tuple(r)[1:] for r in got if r["form"] == k) == want


@pytest.mark.parametrize("by", ["l2", "cosine", "jaccard"])
def test_few_pairs_are_scored_in_full(by, monkeypatch):
    rng = np.random.default_rng(8)
    scored, m = [], fn.MEASURES[by]
    monkeypatch.setattr(m, "block", lambda d, p, q, f=m.block: scored.append(d.size) or f(d, p, q))
    a, b = (nearest.Side(np.arange(k, 2000, 2), np.zeros(1000, np.int32), rng.integers(0, 200, (1000, 49)).astype(float), by) for k in (0, 1))
    nearest._pair(a, b, by)
    assert sum(scored) < 0.01 * 1000 * 1000 and np.isfinite(a.best).all() and np.isfinite(b.best).all()


def test_means_of_images(spark):
    x = np.random.default_rng(12).integers(0, 255, (20, 49)).astype(float)
    want = matrix.block_mean(table(spark, [(i, 0, v.tolist()) for i, v in enumerate(x)]), 7, 7, 4).orderBy("id", "br", "bc").collect()
    assert dense._means(x).ravel().tolist() == [r["val"] for r in want]
