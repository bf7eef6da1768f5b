"""Dense labelled vectors: functions, neighbours, ridge regression, matrices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors as fn
from quarry.operators import evaluate, matrix, nearest, neighbours, ridge
from quarry.plans.lineage import materialize
from quarry.plans.numbering import numbered
from quarry.queries.views import DN, DN_ANY, DN_LABEL
from quarry.sources import files, tables

DIM, K, MAX_K, LAM, SWEEPS = 49, 5, 20, 1.0, 3


def _dense(s: SparkSession, d: str, need: tuple[str, ...] = ("label", "split")) -> DataFrame:
    return materialize(tables.dense_vectors(s.read.parquet(f"{d}/dense_labelled.parquet"), DIM, need=need), "dense")


def _any(s: SparkSession, d: str) -> DataFrame:
    """All usable vectors, whatever their label and split."""
    return _dense(s, d, ())


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d, ("label",))


def _splits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = _dense(s, d)
    return tuple(df.where(F.col("split") == x).drop("split") for x in ("train", "valid", "test"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Each row beside the row of the next id there is, the last beside the first."""
    df = materialize(numbered(_any(s, d).select("id", "features"), ["id"], "n"), "placed")
    n = df.count()
    b = df.select(F.pmod(F.col("n") - 1, F.lit(max(n, 1))).alias("n"), F.col("features").alias("other"))
    return df.join(b, "n").select("id", "features", "other")


def _pairwise(f, digits: int = 9):
    return lambda s, d: _pairs(s, d).select("id", F.round(f(F.col("features"), F.col("other")), digits).alias("value"))


def _neighbours(by: str | int):
    def run(s: SparkSession, d: str) -> DataFrame:
        train, _, test = _splits(s, d)
        got = neighbours.neighbours(train, test, K, by)
        return got.select("id", "nb_id", "nb_label", F.round("score", 6).alias("score"), "rank")

    return run


def _self(by: str):
    return lambda s, d: neighbours.self_match(_labelled(s, d), by).select("id", "nb_id", (F.col("label") == F.col("nb_label")).alias("matched"))


def knn_predict(s: SparkSession, d: str) -> DataFrame:
    train, _, test = _splits(s, d)
    return neighbours.vote(neighbours.neighbours(train, test, K, "jaccard"), K)


def knn_validate_k(s: SparkSession, d: str) -> DataFrame:
    train, valid, _ = _splits(s, d)
    return neighbours.accuracy_by_k(neighbours.neighbours(train, valid, MAX_K, "jaccard"), MAX_K).withColumn("accuracy", F.round("accuracy", 9))


def _weights(nonneg: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        train = _splits(s, d)[0]
        st = ridge.statistics(train, DIM, nonneg)
        return ridge.weight_table(train, st, ridge.descend(st, LAM, nonneg, SWEEPS)[0]).withColumn("w", F.round("w", 9))

    return run


def _trained(nonneg: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        train = _splits(s, d)[0]
        st = ridge.statistics(train, DIM, nonneg)
        return ridge.weight_table(train, st, ridge.descend(st, LAM, nonneg)[0])

    return run


def _objective(sweeps: int | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        train = _splits(s, d)[0]
        st = ridge.statistics(train, DIM)
        w = ridge.descend(st, LAM, sweeps=sweeps)[0]
        rows = [(lab, ridge.objective(st, k, w[k], LAM)) for k, lab in enumerate(st.labels)]
        return s.createDataFrame(rows, "label INT, objective DOUBLE").withColumn("objective", F.round("objective", 4))

    return run


def _predict(sweeps: int | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        train, _, test = _splits(s, d)
        st = ridge.statistics(train, DIM)
        return ridge.predict(test, st, ridge.descend(st, LAM, sweeps=sweeps)[0])

    return run


def _validate(nonneg: bool, sweeps: int | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        train, valid, _ = _splits(s, d)
        return ridge.validate(train, valid, DIM, nonneg, sweeps=sweeps).withColumn("accuracy", F.round("accuracy", 9))

    return run


def accuracy(s: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(knn_predict(s, d)).withColumn("accuracy", F.round("accuracy", 9))


def xty(s: SparkSession, d: str) -> DataFrame:
    sums = matrix.label_sums(_splits(s, d)[0])
    total = sums.groupBy("i").agg(F.sum("v").alias("t"))
    return sums.join(F.broadcast(total), "i").select("label", F.col("i").alias("dim"), F.round(2 * F.col("v") - F.col("t"), 6).alias("v"))


def svd_singular_values(s: SparkSession, d: str) -> DataFrame:
    values, _ = matrix.singular_values(_any(s, d), DIM, 20)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k INT, value DOUBLE")


def svd_trace(s: SparkSession, d: str) -> DataFrame:
    """The squared singular values add up to the sum of all squared features, and the squared
    lengths of the rows in the space of all right vectors do as well."""
    df = _any(s, d)
    values, _ = matrix.singular_values(df, DIM, DIM)
    rows = matrix.svd_project(df, DIM, DIM).agg(F.coalesce(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0)).alias("t")).first()["t"]
    return s.createDataFrame([(float((values**2).sum()), float(rows))], "of_values DOUBLE, of_rows DOUBLE").select(F.round("of_values", 2).alias("of_values"), F.round("of_rows", 2).alias("of_rows"))


def _match_counts(df: DataFrame, forms: list[tuple[str, Callable | None]], measures: tuple[str, ...]) -> DataFrame:
    """(representation, measure, matched, n): rows whose nearest other row has their label."""
    each = [(name, by, f) for name, f in forms for by in measures]
    hit = F.sum((F.col("label") == F.col("nb_label")).cast("bigint"))
    got = nearest.nearest_others(df, [(f, by) for _, by, f in each]).groupBy("form").agg(hit.alias("matched"), F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(k, name, by) for k, (name, by, _) in enumerate(each)], "form INT, representation STRING, measure STRING")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(names).join(got, "form", "left").select("representation", "measure", zero("matched"), zero("n"))


def _means(x: np.ndarray) -> np.ndarray:
    """The images at a quarter of their size: block means in reading order."""
    at = np.arange(49)
    cell = at // 7 // 4 * 2 + at % 7 // 4
    return np.stack([reduce(np.add, x.T[cell == c]) / (cell == c).sum() for c in range(4)], 1)


def nn_match_counts(s: SparkSession, d: str) -> DataFrame:
    return _match_counts(_labelled(s, d), [("values", None), ("means", _means)], ("l2",))


def nn_match_counts_svd(s: SparkSession, d: str) -> DataFrame:
    """The same in the space of the top right vectors, unscaled and scaled."""
    df = _labelled(s, d)
    values, v = matrix.singular_values(df, DIM, DIM)
    onto = lambda m: lambda x: x @ m
    forms = [(f"{'us' if scaled else 'u'}{k}", onto(matrix.projection(values[:k], v[:, :k], scaled))) for k in (5, 10, 20, 40) for scaled in (False, True)]
    return _match_counts(df, forms, ("l2", "cosine", "jaccard"))


QUERIES = {
    "scan_dense_labelled": lambda s, d: _any(s, d).select("id", "label", "split", F.size("features").cast("bigint").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
    "scan_images_limit": lambda s, d: files.first_images(_labelled(s, d), 50).select("id", "label"),
    "union_train_valid": lambda s, d: _splits(s, d)[0].unionByName(_splits(s, d)[1]).select("id", "label"),
    "vec_sq_euclidean": _pairwise(fn.sq_euclidean, 6),
    "vec_cosine": _pairwise(fn.cosine),
    "vec_ext_jaccard": _pairwise(fn.ext_jaccard),
    "vec_dot": _pairwise(fn.dot, 6),
    "vec_axpby": lambda s, d: _pairs(s, d).select("id", F.posexplode(fn.axpby(2.0, F.col("features"), -1.0, F.col("other"))).alias("dim", "val")).withColumn("val", F.round("val", 6)),
    "knn_neighbors_l2": _neighbours("l2"),
    "knn_neighbors_cosine": _neighbours("cosine"),
    "knn_neighbors_jaccard": _neighbours("jaccard"),
    "knn_neighbors_by_number": _neighbours(3),
    "knn_predict": knn_predict,
    "knn_validate_k": knn_validate_k,
    "knn_classify": lambda s, d: neighbours.classify(*_splits(s, d), max_k=MAX_K),
    "nn_self_match_l2": _self("l2"),
    "nn_self_match_cosine": _self("cosine"),
    "nn_self_match_jaccard": _self("jaccard"),
    "accuracy": accuracy,
    "binarize_labels": lambda s, d: ridge.binarized(_splits(s, d)[0]),
    "binarize_labels_nonneg": lambda s, d: ridge.binarized(_splits(s, d)[0], True),
    "gram_matrix": lambda s, d: matrix.gram(_splits(s, d)[0], DIM).withColumn("v", F.round("v", 4)),
    "xty": xty,
    "transpose": lambda s, d: matrix.transposed(_any(s, d)),
    "block_average": lambda s, d: matrix.block_mean(_any(s, d), 7, 7, 4).withColumn("val", F.round("val", 9)),
    "ridge_weights_fixed_sweeps": _weights(False),
    "nn_ridge_weights_fixed_sweeps": _weights(True),
    "ridge_weights": _trained(False),
    "nn_ridge_weights": _trained(True),
    # as their SQL has it: weights of SWEEPS sweeps
    "ridge_objective": _objective(SWEEPS),
    "ridge_predict": _predict(SWEEPS),
    "ridge_validate_lambda": _validate(False, SWEEPS),
    "nn_ridge_validate_lambda": _validate(True, SWEEPS),
    # weights trained to the operator's own stop
    "ridge_objective_trained": _objective(None),
    "ridge_predict_trained": _predict(None),
    "ridge_validate_lambda_trained": _validate(False, None),
    "nn_ridge_validate_lambda_trained": _validate(True, None),
    "ridge_classify": lambda s, d: ridge.classify(*_splits(s, d), dim=DIM),
    "nn_ridge_classify": lambda s, d: ridge.classify(*_splits(s, d), dim=DIM, nonneg=True),
    "svd_singular_values": svd_singular_values,
    "svd_project": lambda s, d: matrix.svd_project(_any(s, d), DIM, 10),
    "svd_trace": svd_trace,
    "nn_match_counts": nn_match_counts,
    "nn_match_counts_svd": nn_match_counts_svd,
}

_V = "v AS MATERIALIZED (SELECT id, label, split, features AS f, list_inner_product(features, features) AS q FROM dn)"
_D2 = f"{DN}, {_V}"
_PAIR = f"""WITH {DN_ANY}, {_V}, nx AS (SELECT *, lead(f) OVER (ORDER BY id) AS o1, lead(q) OVER (ORDER BY id) AS p1, first_value(f) OVER (ORDER BY id) AS o0, first_value(q) OVER (ORDER BY id) AS p0 FROM v),
 pr AS (SELECT id, f, coalesce(o1, o0) AS o, q, coalesce(p1, p0) AS p FROM nx)"""
_DOT = "list_inner_product(a.f, b.f)"
_SCORE = {
    "l2": f"round(greatest(a.q + b.q - 2 * {_DOT}, 0), 6)",
    "cosine": f"-round({_DOT} / (sqrt(a.q) * sqrt(b.q)), 9)",
    "jaccard": f"-round({_DOT} / (a.q + b.q - {_DOT}), 9)",
}


def _rank_sql(by: str, cond: str) -> str:
    return f"""sc AS (SELECT a.id, a.label, b.id AS nb_id, b.label AS nb_label, {_SCORE[by]} AS s FROM v a JOIN v b ON {cond}),
 rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY s, nb_id) AS INTEGER) AS rank FROM sc)"""


def _nb_sql(by: str) -> str:
    cond = "a.split = 'test' AND b.split = 'train'"
    return f"WITH {_D2}, {_rank_sql(by, cond)} SELECT id, nb_id, nb_label, round({'' if by == 'l2' else '-'}s, 6) AS score, rank FROM rk WHERE rank <= {K}"


def _self_sql(by: str) -> str:
    return f"WITH {DN_LABEL}, {_V}, {_rank_sql(by, 'a.id <> b.id')} SELECT id, nb_id, label = nb_label AS matched FROM rk WHERE rank = 1"


_TEST = _rank_sql("jaccard", "a.split = 'test' AND b.split = 'train'")
_VALID = _rank_sql("jaccard", "a.split = 'valid' AND b.split = 'train'")
_VOTE = f"""vt AS (SELECT id, label, nb_label, count(*) AS n FROM rk WHERE rank <= {K} GROUP BY 1, 2, 3),
 pd AS (SELECT id, label, nb_label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, nb_label) AS rn FROM vt) WHERE rn = 1)"""
_BOTH = _rank_sql("jaccard", "a.split = 'test' AND b.split IN ('train', 'valid')").replace("sc ", "sc2 ").replace("rk AS", "rk2 AS").replace("FROM sc)", "FROM sc2)")
_LG = "lg AS (SELECT id, label, split, CAST(unnest(range(49)) AS INTEGER) AS dim, unnest(features) AS val FROM dn)"
_LONG, _LONG_ANY = f"{DN}, {_LG}", f"{DN_ANY}, {_LG}"
_NEAREST = """{0}_rk AS (SELECT a.label, b.label AS nb, row_number() OVER (PARTITION BY a.id ORDER BY round(greatest(a.q + b.q - 2 * list_inner_product(a.f, b.f), 0), 6), b.id) AS rn FROM {0} a JOIN {0} b ON a.id <> b.id)"""
_COUNT = "SELECT '{0}' AS representation, 'l2' AS measure, CAST(coalesce(sum(CASE WHEN label = nb THEN 1 ELSE 0 END), 0) AS BIGINT) AS matched, count(*) AS n FROM {1}_rk WHERE rn = 1"
# for dot products the rows of G are lists; weights of all labels and lambdas go through one recursion
_STATS = f"""{_LONG}, t AS MATERIALIZED (SELECT * FROM lg WHERE split = 'train'),
 gm AS (SELECT a.dim AS i, b.dim AS j, sum(a.val * b.val) AS v FROM t a JOIN t b ON a.id = b.id GROUP BY 1, 2),
 gr AS MATERIALIZED (SELECT i, list(v ORDER BY j) AS row FROM gm GROUP BY i),
 ls AS (SELECT label, dim AS i, sum(val) AS v FROM t GROUP BY 1, 2), tot AS (SELECT dim AS i, sum(val) AS s FROM t GROUP BY 1)"""


def _descent_sql(nonneg: bool, lams: str) -> str:
    b = "v" if nonneg else "2 * v - s"
    zero = "WHEN top <= 0 THEN 0" if nonneg else "WHEN top = 0 THEN 0"
    return f"""WITH RECURSIVE {_STATS}, bb AS MATERIALIZED (SELECT label, i, {b} AS b FROM ls JOIN tot USING (i)),
 it AS (SELECT 0 AS step, label, lam, list_transform(range(49), lambda x: CAST(0 AS DOUBLE)) AS w FROM (SELECT DISTINCT label FROM ls), (SELECT unnest({lams}) AS lam)
  UNION ALL SELECT step + 1, label, lam, list_concat(list_concat(w[1:i], [CASE {zero} ELSE top / (gii + lam) END]), w[i + 2:])
  FROM (SELECT it.*, gr.i, row[gr.i + 1] AS gii, bb.b - list_inner_product(row, w) + row[gr.i + 1] * w[gr.i + 1] AS top
   FROM it JOIN gr ON gr.i = it.step % 49 JOIN bb ON bb.label = it.label AND bb.i = gr.i WHERE step < 49 * {SWEEPS})),
 wt AS MATERIALIZED (SELECT label, lam, w FROM it WHERE step = 49 * {SWEEPS})"""


_ONE, _GRID = f"[CAST({LAM} AS DOUBLE)]", f"CAST({[float(x) for x in ridge.LAMBDAS]} AS DOUBLE[])"


def _argmax_sql(split: str) -> str:
    return f"""pd AS (SELECT id, lam, label, pred FROM (SELECT dn.id, dn.label, lam, wt.label AS pred, row_number() OVER (PARTITION BY id, lam
 ORDER BY list_inner_product(features, w) DESC, wt.label) AS rn FROM dn, wt WHERE split = '{split}') WHERE rn = 1)"""


SQL = {
    "scan_dense_labelled": f"WITH {DN_ANY} SELECT id, label, split, len(features) AS n, round(list_sum(features), 6) AS total FROM dn",
    "scan_images_limit": f"WITH {DN_LABEL} SELECT id, label FROM dn ORDER BY id LIMIT 50",
    "union_train_valid": f"WITH {DN} SELECT id, label FROM dn WHERE split IN ('train', 'valid')",
    "vec_sq_euclidean": f"{_PAIR} SELECT id, round(q + p - 2 * list_inner_product(f, o), 6) AS value FROM pr",
    "vec_cosine": f"{_PAIR} SELECT id, round(list_inner_product(f, o) / (sqrt(q) * sqrt(p)), 9) AS value FROM pr",
    "vec_ext_jaccard": f"{_PAIR} SELECT id, round(list_inner_product(f, o) / (q + p - list_inner_product(f, o)), 9) AS value FROM pr",
    "vec_dot": f"{_PAIR} SELECT id, round(list_inner_product(f, o), 6) AS value FROM pr",
    "vec_axpby": f"{_PAIR}, e AS (SELECT id, CAST(unnest(range(49)) AS INTEGER) AS dim, unnest(f) AS x, unnest(o) AS y FROM pr) SELECT id, dim, round(2 * x - y, 6) AS val FROM e",
    **{f"knn_neighbors_{m}": _nb_sql(m) for m in _SCORE},
    "knn_neighbors_by_number": _nb_sql("jaccard"),
    "knn_predict": f"WITH {_D2}, {_TEST}, {_VOTE} SELECT id, label, pred FROM pd",
    "knn_validate_k": f"""WITH {_D2}, {_VALID}, ks AS (SELECT rk.*, k FROM rk, (SELECT CAST(unnest(range(1, {MAX_K + 1})) AS INTEGER) AS k) WHERE rank <= k),
 vt AS (SELECT k, id, label, nb_label, count(*) AS n FROM ks GROUP BY 1, 2, 3, 4), pd AS (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY n DESC, nb_label) AS rn FROM vt)
 SELECT k, round(avg(CASE WHEN label = nb_label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pd WHERE rn = 1 GROUP BY k""",
    "knn_classify": f"""WITH {_D2}, {_VALID}, ks AS (SELECT rk.*, k FROM rk, (SELECT unnest(range(1, {MAX_K + 1})) AS k) WHERE rank <= k),
 vt AS (SELECT k, id, label, nb_label, count(*) AS n FROM ks GROUP BY 1, 2, 3, 4), pd AS (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY n DESC, nb_label) AS rn FROM vt),
 best AS (SELECT k FROM pd WHERE rn = 1 GROUP BY k ORDER BY avg(CASE WHEN label = nb_label THEN 1.0 ELSE 0.0 END) DESC, k LIMIT 1), {_BOTH},
 v2 AS (SELECT id, label, nb_label, count(*) AS n FROM rk2, best WHERE rank <= k GROUP BY 1, 2, 3)
 SELECT id, label, nb_label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, nb_label) AS rn FROM v2) WHERE rn = 1""",
    **{f"nn_self_match_{m}": _self_sql(m) for m in _SCORE},
    "accuracy": f"WITH {_D2}, {_TEST}, {_VOTE} SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM pd",
    "binarize_labels": f"WITH {DN}, t AS (SELECT * FROM dn WHERE split = 'train') SELECT id, l.target, CASE WHEN label = target THEN 1 ELSE -1 END AS y FROM t, (SELECT DISTINCT label AS target FROM t) l",
    "binarize_labels_nonneg": f"WITH {DN}, t AS (SELECT * FROM dn WHERE split = 'train') SELECT id, l.target, CASE WHEN label = target THEN 1 ELSE 0 END AS y FROM t, (SELECT DISTINCT label AS target FROM t) l",
    "gram_matrix": f"WITH {_STATS} SELECT i, j, round(v, 4) AS v FROM gm",
    "xty": f"WITH {_STATS} SELECT label, i AS dim, round(2 * v - s, 6) AS v FROM ls JOIN tot USING (i)",
    "transpose": f"WITH {_LONG_ANY} SELECT dim, id, val FROM lg",
    "block_average": f"WITH {_LONG_ANY} SELECT id, CAST((dim // 7) // 4 AS INTEGER) AS br, CAST((dim % 7) // 4 AS INTEGER) AS bc, round(avg(val), 9) AS val FROM lg GROUP BY 1, 2, 3",
    "svd_trace": f"WITH {DN_ANY}, t AS (SELECT coalesce(sum(list_inner_product(features, features)), 0) AS t FROM dn) SELECT round(t, 2) AS of_values, round(t, 2) AS of_rows FROM t",
    "nn_match_counts": f"""WITH {DN_LABEL}, {_V}, {_LG}, bm AS (SELECT id, any_value(label) AS label, (dim // 7) // 4 AS br, (dim % 7) // 4 AS bc, avg(val) AS val FROM lg GROUP BY id, br, bc),
 mf AS (SELECT id, any_value(label) AS label, list(val ORDER BY br, bc) AS f FROM bm GROUP BY id), mv AS MATERIALIZED (SELECT *, list_inner_product(f, f) AS q FROM mf),
 {_NEAREST.format("v")}, {_NEAREST.format("mv")} {_COUNT.format("values", "v")} UNION ALL {_COUNT.format("means", "mv")}""",
    "ridge_weights_fixed_sweeps": f"{_descent_sql(False, _ONE)} SELECT label, CAST(unnest(range(49)) AS INTEGER) AS dim, round(unnest(w), 9) AS w FROM wt",
    "nn_ridge_weights_fixed_sweeps": f"{_descent_sql(True, _ONE)} SELECT label, CAST(unnest(range(49)) AS INTEGER) AS dim, round(unnest(w), 9) AS w FROM wt",
    "ridge_predict": f"{_descent_sql(False, _ONE)}, {_argmax_sql('test')} SELECT id, label, pred FROM pd",
    "ridge_objective": f"""{_descent_sql(False, _ONE)} SELECT wt.label, round(any_value(lam * list_inner_product(w, w)) + sum(power(list_inner_product(features, w) - CASE WHEN dn.label = wt.label THEN 1 ELSE -1 END, 2)), 4) AS objective
 FROM wt, dn WHERE split = 'train' GROUP BY wt.label""",
    "ridge_validate_lambda": f"{_descent_sql(False, _GRID)}, {_argmax_sql('valid')} SELECT lam, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pd GROUP BY lam",
    "nn_ridge_validate_lambda": f"{_descent_sql(True, _GRID)}, {_argmax_sql('valid')} SELECT lam, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pd GROUP BY lam",
}
