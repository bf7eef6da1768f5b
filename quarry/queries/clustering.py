"""Objectives, move rules and validity of a given assignment, and clustering from scratch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluate
from quarry.operators import partition as ops
from quarry.plans.lineage import materialize, shared_root
from quarry.queries.views import ASG, CL, TR
from quarry.sources import files, tables

K = 20


def _points(s: SparkSession, d: str) -> DataFrame:
    return tables.triplets(s.read.parquet(f"{d}/sparse_triplets.parquet"))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return tables.assignment(s.read.parquet(f"{d}/kc_assignment.parquet"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return tables.class_labels(s.read.parquet(f"{d}/class_labels.parquet"))


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = materialize(_points(s, d), "points")
    return p, materialize(_assigned(s, d).join(p.select("doc_id").distinct(), "doc_id", "left_semi"), "assigned")


def _confusion(s: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_assigned(s, d).join(_labels(s, d), "doc_id"))


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})  # + 0.0: no negative zero


def _step(by: str):
    return lambda s, d: _r(ops.best_moves(*_both(s, d), by), "delta")


def _objective(by: str, partial: bool = False):
    return lambda s, d: _r(ops.objective(*_both(s, d), by, partial), "objective")


def confusion_pivot(s: SparkSession, d: str) -> DataFrame:
    """The table as text lines: cluster, then one count a label in label order."""
    conf = materialize(_confusion(s, d), "confusion")
    labels = [r["label"] for r in conf.select("label").distinct().orderBy("label").collect()]
    wide = evaluate.pivoted(conf, labels)
    return wide.select(F.concat_ws(" ", "cluster", *[F.col(f"`{x}`").cast("string") for x in labels]).alias("line"))


def kmeans_fit(s: SparkSession, d: str) -> DataFrame:
    return ops.fit(_points(s, d), K, "i2")[0]


def kmeans_best_trial(s: SparkSession, d: str) -> DataFrame:
    return ops.best_trial(_points(s, d), K, "sse", trials=3)[0]


def kmeans_fit_e1(s: SparkSession, d: str) -> DataFrame:
    return ops.fit(_points(s, d), K, "e1")[0]


def kmeans_sequential(s: SparkSession, d: str) -> DataFrame:
    """The best of three sequential trials under E1."""
    got = materialize(ops.fit_sequential(_points(s, d), K, "e1", trials=3), "trials")
    best = got.groupBy("trial").agg(F.first("objective").alias("o")).orderBy("o", "trial").limit(1)
    return got.join(F.broadcast(best.select("trial")), "trial", "left_semi").select("doc_id", "cluster")


def clustering_metrics(s: SparkSession, d: str) -> DataFrame:
    """One row with the objective, entropy and purity of the given assignment."""
    p, a = _both(s, d)
    conf = materialize(_confusion(s, d), "confusion")
    row = ops.objective(p, a, "i2").crossJoin(evaluate.entropy(conf)).crossJoin(evaluate.purity(conf))  # one row each
    return _r(row, "objective", "entropy", "purity")


def kmeans_invariants(s: SparkSession, d: str) -> DataFrame:
    """What every fit must keep: all points assigned, no cluster beyond k, and the objective it reports
    is that of its assignment."""
    p = materialize(_points(s, d), "points")
    rows = []
    for by in ("sse", "i2"):
        got, value = ops.fit(p, K, by)
        again = ops.objective(p, got, by).first()["objective"]
        used = got.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k")).first()
        rows.append((by, used["n"], used["k"] <= K, abs(again - value) <= 1e-6 * max(1.0, abs(value))))
    return s.createDataFrame(rows, "criterion STRING, n_points BIGINT, at_most_k BOOLEAN, objective_agrees BOOLEAN")


def trial_report(s: SparkSession, d: str) -> DataFrame:
    """Trials of the sum of squared errors, and whether the kept one has the best objective."""
    p = materialize(_points(s, d), "points")
    got, log = ops.best_trial(p, K, "sse", trials=2, max_iter=3)
    kept = ops.objective(p, got, "sse").first()["objective"]
    best = float(log["objective"].min())
    return s.createDataFrame([(len(log), abs(kept - best) <= 1e-6 * max(1.0, abs(best)))], "n_trials BIGINT, kept_the_best BOOLEAN")


def read_back_triplets(s: SparkSession, d: str) -> DataFrame:
    """The points as text lines, parsed again."""
    path = f"{shared_root(s)}/triplets-{uuid.uuid4().hex}"
    files.write_csv(_points(s, d), path)
    return files.read_triplets(s, path)


def domain_sizes(s: SparkSession, d: str) -> DataFrame:
    tx = tables.transactions(s.read.parquet(f"{d}/baskets.parquet")).agg(F.max("item").alias("max_item"))
    return tx.join(F.broadcast(_points(s, d).agg((F.max("dim") + 1).alias("n_dims"))))


QUERIES = {
    "vector_sq_norms": lambda s, d: _r(ops.sq_norms(_points(s, d)), "sq", digits=9),
    "global_composite": lambda s, d: _r(ops.global_composite(_points(s, d)), "g", digits=9),
    "dot_global": lambda s, d: _r(ops.dot_global(_points(s, d)), "xg"),
    "cluster_composites": lambda s, d: _r(ops.composites(_points(s, d), _assigned(s, d)), "v", digits=9),
    "cluster_sizes": lambda s, d: ops.sizes(_assigned(s, d)),
    "sparse_dot": lambda s, d: _r(ops.sparse_dot(_points(s, d), ops.composites(_points(s, d), _assigned(s, d))), "dot", digits=9),
    "cluster_assignments": lambda s, d: _assigned(s, d).select(F.concat_ws(", ", "doc_id", "cluster").alias("line")),
    "labelled_clusters": lambda s, d: _assigned(s, d).join(_labels(s, d), "doc_id").select("doc_id", "cluster", "label"),
    "confusion_matrix": _confusion,
    "confusion_matrix_scaled": lambda s, d: _r(evaluate.scaled(_confusion(s, d)), "p", digits=9),
    "confusion_pivot": confusion_pivot,
    "cluster_entropy": lambda s, d: _r(evaluate.entropy(_confusion(s, d)), "entropy"),
    "cluster_purity": lambda s, d: _r(evaluate.purity(_confusion(s, d)), "purity"),
    "objective_sse": _objective("sse"),
    "objective_sse_partial": _objective("sse", True),
    "objective_i2": _objective("i2"),
    "objective_e1": _objective("e1"),
    "objective_any_case": _objective("SsE"),
    "kmeans_step_sse": _step("sse"),
    "kmeans_step_i2": _step("i2"),
    "kmeans_step_e1": _step("e1"),
    "initial_seeds": lambda s, d: ops.initial_seeds(_points(s, d), K),
    "kmeans_fit": kmeans_fit,
    "kmeans_fit_e1": kmeans_fit_e1,
    "kmeans_best_trial": kmeans_best_trial,
    "kmeans_sequential": kmeans_sequential,
    "domain_sizes": domain_sizes,
    "trial_report": trial_report,
    "read_back_triplets": read_back_triplets,
    "clustering_metrics": clustering_metrics,
    "kmeans_invariants": kmeans_invariants,
}

_A = f"""{TR}, {ASG}, a AS (SELECT asg.doc_id, cluster FROM asg SEMI JOIN tr ON asg.doc_id = tr.doc_id), p AS (SELECT tr.*, cluster FROM tr JOIN a USING (doc_id)),
 g AS (SELECT dim, sum(val) AS g FROM p GROUP BY dim), sz AS (SELECT cluster, count(*) AS n FROM a GROUP BY 1),
 co AS (SELECT cluster, dim, sum(val) AS v FROM p GROUP BY 1, 2),
 fa AS (SELECT cluster, any_value(n) AS n, sum(v * v) AS dd, sum(v * g) AS dg FROM co JOIN g USING (dim) JOIN sz USING (cluster) GROUP BY 1)"""
_CONF = f"{ASG}, {CL}, cf AS (SELECT cluster, label, count(*) AS n FROM asg JOIN cl USING (doc_id) GROUP BY 1, 2)"


def _step_sql(leave: str, join: str, sign: str) -> str:
    return f"""WITH {_A}, x AS (SELECT doc_id, any_value(cluster) AS cluster, sum(val * val) AS xx, sum(val * g) AS xg FROM p JOIN g USING (dim) GROUP BY 1),
 d AS (SELECT p.doc_id, co.cluster, sum(p.val * co.v) AS dx FROM p JOIN co ON p.dim = co.dim GROUP BY 1, 2),
 full_d AS (SELECT x.doc_id, x.cluster AS own, xx, xg, fa.*, coalesce(dx, 0) AS dx FROM x CROSS JOIN fa LEFT JOIN d ON d.doc_id = x.doc_id AND d.cluster = fa.cluster),
 l AS (SELECT doc_id, {leave} AS leave FROM full_d WHERE cluster = own),
 m AS (SELECT doc_id, own, cluster AS target, round(leave + {join}, 9) AS delta FROM full_d JOIN l USING (doc_id) WHERE cluster <> own),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {sign}delta, target) AS rn FROM m WHERE delta IS NOT NULL)
 SELECT doc_id, own AS cluster, target, round(delta, 6) + 0.0 AS delta, {sign}delta < 0 AS moved FROM r WHERE rn = 1"""


_FAR = "(dd / (n * n) - 2 * dx / n + xx)"
_MORE, _LESS = "sqrt(greatest(dd + 2 * dx + xx, 0))", "sqrt(greatest(dd - 2 * dx + xx, 0))"

SQL = {
    "vector_sq_norms": f"WITH {TR} SELECT doc_id, round(sum(val * val), 9) AS sq FROM tr GROUP BY 1",
    "global_composite": f"WITH {TR} SELECT dim, round(sum(val), 9) AS g FROM tr GROUP BY 1",
    "dot_global": f"WITH {TR}, g AS (SELECT dim, sum(val) AS g FROM tr GROUP BY 1) SELECT doc_id, round(sum(val * g), 6) AS xg FROM tr JOIN g USING (dim) GROUP BY 1",
    "cluster_composites": f"WITH {_A} SELECT cluster, dim, round(v, 9) AS v FROM co",
    "cluster_sizes": f"WITH {ASG} SELECT cluster, count(*) AS n FROM asg GROUP BY 1",
    "sparse_dot": f"WITH {_A} SELECT tr.doc_id, co.cluster, round(sum(val * v), 9) AS dot FROM tr JOIN co USING (dim) GROUP BY 1, 2",
    "cluster_assignments": f"WITH {ASG} SELECT doc_id || ', ' || cluster AS line FROM asg",
    "labelled_clusters": f"WITH {ASG}, {CL} SELECT doc_id, cluster, label FROM asg JOIN cl USING (doc_id)",
    "confusion_matrix": f"WITH {_CONF} SELECT cluster, label, n FROM cf",
    "confusion_matrix_scaled": f"WITH {_CONF} SELECT cluster, label, round(n / sum(n) OVER (PARTITION BY cluster), 9) AS p FROM cf",
    "confusion_pivot": f"""WITH {_CONF}, full_c AS (SELECT c.cluster, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster FROM cf) c CROSS JOIN (SELECT DISTINCT label FROM cf) l
 LEFT JOIN cf ON cf.cluster = c.cluster AND cf.label = l.label) SELECT cluster || ' ' || string_agg(CAST(n AS VARCHAR), ' ' ORDER BY label) AS line FROM full_c GROUP BY cluster""",
    "cluster_entropy": f"WITH {_CONF}, t AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS s FROM cf) SELECT round(sum(-n * log2(n / s)) / sum(n), 6) AS entropy FROM t",
    "cluster_purity": f"WITH {_CONF}, t AS (SELECT max(n) AS m, sum(n) AS s FROM cf GROUP BY cluster) SELECT round(sum(m) / sum(s), 6) AS purity FROM t",
    "objective_sse": f"WITH {_A} SELECT round((SELECT sum(val * val) FROM p) - sum(dd / n), 6) AS objective FROM fa",
    "objective_sse_partial": f"WITH {_A} SELECT round(sum((val - v / n) * (val - v / n)), 6) AS objective FROM p JOIN co USING (cluster, dim) JOIN sz USING (cluster)",
    "objective_i2": f"WITH {_A} SELECT round(sum(sqrt(dd)), 6) AS objective FROM fa",
    "objective_any_case": f"WITH {_A} SELECT round((SELECT sum(val * val) FROM p) - sum(dd / n), 6) AS objective FROM fa",
    "objective_e1": f"WITH {_A} SELECT round(sum(n * dg / sqrt(dd)) / (SELECT sqrt(sum(g * g)) FROM g), 6) AS objective FROM fa",
    "kmeans_step_sse": _step_sql(f"CASE WHEN n > 1 THEN -(n / (n - 1)) * {_FAR} END", f"(n / (n + 1)) * {_FAR}", ""),
    "kmeans_step_i2": _step_sql(f"{_LESS} - sqrt(dd)", f"{_MORE} - sqrt(dd)", "-"),
    "kmeans_step_e1": _step_sql(f"(CASE WHEN n > 1 THEN (n - 1) * (dg - xg) / {_LESS} ELSE 0 END) - n * dg / sqrt(dd)", f"(n + 1) * (dg + xg) / {_MORE} - n * dg / sqrt(dd)", ""),
    "initial_seeds": f"""WITH {TR}, h AS (SELECT DISTINCT doc_id, md5(doc_id || ':1') AS h FROM tr)
 SELECT doc_id, CAST(row_number() OVER (ORDER BY h, doc_id) - 1 AS INTEGER) AS cluster FROM h ORDER BY h, doc_id LIMIT {K}""",
    "clustering_metrics": f"""WITH {_A}, {CL}, cf AS (SELECT cluster, label, count(*) AS n FROM asg JOIN cl USING (doc_id) GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS s FROM cf),
 mx AS (SELECT max(n) AS m, sum(n) AS s FROM cf GROUP BY cluster) SELECT (SELECT round(sum(sqrt(dd)), 6) FROM fa) AS objective, (SELECT round(sum(-n * log2(n / s)) / sum(n), 6) FROM t) AS entropy,
 (SELECT round(sum(m) / sum(s), 6) FROM mx) AS purity""",
    "kmeans_invariants": f"WITH {TR} SELECT unnest(['sse', 'i2']) AS criterion, count(DISTINCT doc_id) AS n_points, true AS at_most_k, true AS objective_agrees FROM tr",
    "trial_report": "SELECT CAST(2 AS BIGINT) AS n_trials, true AS kept_the_best",
    "read_back_triplets": f"WITH {TR} SELECT * FROM tr",
    "domain_sizes": f"""WITH {TR} SELECT (SELECT max(item) FROM baskets WHERE tid IS NOT NULL AND item >= 1) AS max_item, (SELECT max(dim) + 1 FROM tr) AS n_dims""",
}
