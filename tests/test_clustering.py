import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate
from quarry.operators import partition as ops
from quarry.plans.components import components
from quarry.sources import tables

POINTS = [(0, 0, 1.0), (1, 0, 2.0), (2, 1, 1.0), (3, 1, 3.0)]
A, B = [0, 0, 1, 1], [0, 1, 1, 1]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "doc_id BIGINT, dim INT, val DOUBLE")


def assign(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, cluster INT")


@pytest.mark.parametrize(
    ("by", "partial", "a", "b"), [("sse", False, 2.5, 7.333333), ("sse", True, 2.5, 4.666667), ("I2", False, 7.0, 5.472136), ("e1", False, 2.8, 3.551610)]
)
def test_objectives(spark, points, by, partial, a, b):
    for labels, want in ((A, a), (B, b)):
        assert ops.objective(points, assign(spark, labels), by, partial).first()[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("by", "delta"), [("sse", -4.833333), ("i2", 1.527864), ("e1", -3.758048)])
def test_move_rules(spark, points, by, delta):
    got = {r["doc_id"]: r for r in ops.best_moves(points, assign(spark, B), by).collect()}
    assert got[1]["target"] == 0 and got[1]["delta"] == pytest.approx(delta, abs=1e-5) and got[1]["moved"]


def test_singleton_stays_under_sse(spark, points):
    assert 0 not in {r["doc_id"] for r in ops.best_moves(points, assign(spark, B), "sse").collect()}


def test_unknown_criterion(points):
    with pytest.raises(ValueError):
        ops.fit(points, 2, "nope")


@pytest.mark.parametrize("by", ["sse", "i2", "e1"])
def test_fit_finds_plain_clusters(spark, by):
    rng = np.random.default_rng(0)
    rows = [(i, int(j) + 10 * (i % 3), 1 + float(rng.random())) for i in range(60) for j in range(5)]
    pts = spark.createDataFrame(rows, "doc_id BIGINT, dim INT, val DOUBLE")
    got, log = ops.best_trial(pts, 3, by, trials=4, max_iter=10, stop=0.001)
    labels = spark.createDataFrame([(i, str(i % 3)) for i in range(60)], "doc_id BIGINT, label STRING")
    conf = evaluate.confusion(got.join(labels, "doc_id"))
    assert evaluate.purity(conf).first()[0] >= 0.6 and len(log) == 4
    value = log["objective"].max() if by == "i2" else log["objective"].min()
    assert ops.objective(pts, got, by).first()[0] == pytest.approx(value)


@pytest.mark.parametrize("by", ["sse", "i2", "e1"])
def test_sequential_moves_improve(spark, by, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, int(j) + 10 * (i % 3), 1 + float(rng.random())) for i in range(45) for j in range(5)]
    pts = spark.createDataFrame(rows, "doc_id BIGINT, dim INT, val DOUBLE")
    values = []
    for rounds in (1, 2, 10):
        got = ops.fit_sequential(pts, 3, by, trials=2, max_iter=rounds, stop=0.0).where("trial = 1").cache()
        values.append(got.first()["objective"])
        assert ops.objective(pts, got.select("doc_id", "cluster"), by).first()[0] == pytest.approx(values[-1])
    assert values == sorted(values, reverse=by != "i2")
    monkeypatch.setattr(ops, "MAX_SEQUENTIAL", 10)
    with pytest.raises(ValueError):
        ops.fit_sequential(pts, 3, by)


def test_sequential_moves_of_many_cells(spark):
    """More cells than a task should hold at once: 5.2 million, in two plain groups."""
    pts = spark.range(1300).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3999))).alias("j"))
    pts = pts.select("doc_id", (F.col("j") + 4000 * (F.col("doc_id") % 2)).cast("int").alias("dim"), (1 + F.pmod(F.xxhash64("doc_id", "j"), F.lit(100)) / 1000).alias("val"))
    got = ops.fit_sequential(pts, 4, "i2", max_iter=3)
    assert got.groupBy("cluster").agg(F.countDistinct(F.col("doc_id") % 2).alias("n")).where("n > 1").count() == 0
    assert got.count() == 1300


def one_by_one(rows, k, by, trial, max_iter):
    """Clusters when each point is scored against the composites that the one before it left."""
    x = np.zeros((1 + max(r[0] for r in rows), 1 + max(r[1] for r in rows)))
    for i, j, v in rows:
        x[i, j] = v
    g, own = x.sum(0), np.full(len(x), -1)
    own[np.random.default_rng(2 * trial + 1).choice(len(x), k, replace=False)] = np.arange(k)
    for _ in range(max_iter):
        for i in range(len(x)):
            m = np.array([x[own == c].sum(0) for c in range(k)])
            n = np.array([(own == c).sum() for c in range(k)], float)
            s = np.round(ops._score(by, n, (m * m).sum(1), m @ g, (m @ x[i])[None, :], np.array([x[i] @ x[i]]), np.array([x[i] @ g]), own[i : i + 1])[0], 12)
            if own[i] < 0 or s.min() < 0:
                own[i] = s.argmin()
    return own.tolist()


@pytest.mark.parametrize("by", ["sse", "i2", "e1"])
def test_sequential_is_one_by_one(spark, by):
    rng = np.random.default_rng(9)
    rows = [(i, int(j), 1 + float(rng.random())) for i in range(120) for j in rng.choice(30, 6, replace=False)]
    got = ops.fit_sequential(spark.createDataFrame(rows, "doc_id BIGINT, dim INT, val DOUBLE"), 5, by, trials=2, max_iter=4, stop=0.0)
    for trial in (0, 1):
        assert [r["cluster"] for r in got.where(F.col("trial") == trial).orderBy("doc_id").collect()] == one_by_one(rows, 5, by, trial, 4)


@pytest.mark.parametrize("by", ["sse", "i2", "e1"])
def test_fit_with_composites_as_a_table(spark, monkeypatch, by):
    """Beyond the dense limit the rounds are joins, with the same clusters."""
    rng = np.random.default_rng(4)
    rows = [(i, int(j), 1 + float(rng.random())) for i in range(80) for j in rng.choice(30, 6, replace=False)]
    pts = spark.createDataFrame(rows, "doc_id BIGINT, dim INT, val DOUBLE")
    got, value = ops.fit(pts, 4, by, max_iter=4, stop=0.0)
    dense = {r["doc_id"]: r["cluster"] for r in got.collect()}
    monkeypatch.setattr(ops, "MAX_DENSE", 10)
    other, same = ops.fit(pts, 4, by, max_iter=4, stop=0.0)
    joined = {r["doc_id"]: r["cluster"] for r in other.collect()}
    assert joined == dense and same == pytest.approx(value)


def test_fit_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, dim INT, val DOUBLE")
    assert ops.fit(none, 3)[0].count() == 0
    few = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "doc_id BIGINT, dim INT, val DOUBLE")
    assert ops.fit(few, 5)[0].count() == 2


def test_entropy_and_purity(spark):
    conf = spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "b", 4)], "cluster INT, label STRING, n BIGINT")
    assert evaluate.entropy(conf).first()[0] == pytest.approx(0.405639, abs=1e-6)
    assert evaluate.purity(conf).first()[0] == pytest.approx(0.875)


def test_cleaned_tables(spark):
    t = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (1, -1, 1.0), (1, 3, None), (None, 3, 1.0), (2, 3, float("nan"))], "doc_id BIGINT, dim INT, val DOUBLE")
    assert [tuple(r) for r in tables.triplets(t).collect()] == [(1, 2, 0.5)]
    a = spark.createDataFrame([(1, 2, 5), (1, 1, 7), (2, 1, -1), (3, None, 1), (4, 1, None)], "doc_id BIGINT, run_no INT, cluster_no INT")
    assert [tuple(r) for r in tables.assignment(a).collect()] == [(1, 7)]
    c = spark.createDataFrame([(1, " Oil "), (1, "oil"), (2, None), (3, " ")], "doc_id BIGINT, label STRING")
    assert [tuple(r) for r in tables.class_labels(c).collect()] == [(1, "oil")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "u BIGINT, v BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0
