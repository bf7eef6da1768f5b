"""DuckDB SQL for the registered queries, by the plainest definition of each result."""

_WORDS = """art AS (SELECT newid, min(body) AS body FROM reuters WHERE newid IS NOT NULL GROUP BY newid),
 tok AS (SELECT newid, unnest(string_split(regexp_replace(lower(regexp_replace(body, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' ')) AS term FROM art WHERE body IS NOT NULL),
 ok AS (SELECT newid, term FROM tok WHERE term <> '' AND NOT regexp_full_match(term, '[0-9]+')),
 tf AS (SELECT newid, term, count(*) AS tf FROM ok GROUP BY 1, 2),
 n AS (SELECT count(DISTINCT newid) AS n FROM tf),
 ct AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY 1)"""

_DENSE = """dn AS MATERIALIZED (SELECT DISTINCT id, label, features AS f, split, source FROM dense_labelled WHERE id IS NOT NULL
 AND len(features) = 49 AND len(list_filter(features, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(features, lambda x: x <> 0)) > 0)"""
_EXACT = "list_sum(list_transform(list_zip(a.f, b.f), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _near(queries: str) -> str:
    return f"""{_DENSE}, q AS ({queries}),
 rk AS (SELECT a.id AS qid, b.id, b.label, {_EXACT} AS d2, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {_EXACT}, b.id) AS INTEGER) AS rank
 FROM q JOIN dn a ON a.id = q.id JOIN dn b ON a.id <> b.id)"""


_CROSS = f"""{_DENSE}, v AS MATERIALIZED (SELECT *, list_inner_product(f, f) AS q FROM dn),
 m AS MATERIALIZED (SELECT a.id AS t, b.id AS h, b.split, b.source FROM v a JOIN v b ON a.split = 'train' AND b.split IN ('valid', 'test') AND 400 * {_EXACT} <= greatest(a.q, b.q))"""

_GROUPS = """tr AS (SELECT doc_id, dim, min(val) AS val FROM sparse_triplets WHERE doc_id IS NOT NULL AND dim >= 0 AND val IS NOT NULL AND NOT isnan(val) AND val <> 0 GROUP BY 1, 2),
 nm AS (SELECT doc_id, sqrt(sum(val * val)) AS n FROM tr GROUP BY 1), u AS MATERIALIZED (SELECT doc_id, dim, val / n AS w FROM tr JOIN nm USING (doc_id)),
 e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.dim = b.dim AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8 - 1e-9),
 r AS (SELECT x AS doc_id, x AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)"""

_PAIRS = """nd AS MATERIALIZED (SELECT DISTINCT node_id, parent_id, item, node_count FROM fpt_node),
 up AS (SELECT node_id, parent_id AS up, item FROM nd WHERE item IS NOT NULL
  UNION ALL SELECT up.node_id, n.parent_id, n.item FROM up JOIN nd n ON up.up = n.node_id WHERE n.item IS NOT NULL),
 b AS MATERIALIZED (SELECT DISTINCT tid, item FROM baskets WHERE tid IS NOT NULL AND item >= 1),
 n AS (SELECT CAST((SELECT count(DISTINCT tid) FROM b) + (SELECT sum(node_count) FROM nd WHERE parent_id IS NULL) AS BIGINT) AS n),
 one AS MATERIALIZED (SELECT item, CAST(sum(c) AS BIGINT) AS c FROM (SELECT item, count(*) AS c FROM b GROUP BY 1 UNION ALL SELECT item, sum(node_count) FROM nd WHERE item >= 1 GROUP BY 1) GROUP BY 1),
 two AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS c FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2
  UNION ALL SELECT least(nd.item, up.item), greatest(nd.item, up.item), sum(node_count) FROM nd JOIN up USING (node_id) WHERE up.item <> nd.item GROUP BY 1, 2),
 pr AS (SELECT item_a, item_b, CAST(sum(two.c) AS BIGINT) AS n_ab, any_value(o.c) AS n_a, any_value(p.c) AS n_b, any_value(n.n) AS n_baskets
  FROM two JOIN one o ON item_a = o.item JOIN one p ON item_b = p.item, n GROUP BY 1, 2)"""

_TEXT = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_LEAKS = f"""iw AS (SELECT item_id, {_TEXT.format('item_text')} AS w FROM eval_items WHERE item_id IS NOT NULL),
 ig AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
 dw AS (SELECT doc_id, {_TEXT.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
 dg AS (SELECT doc_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)),
 lk AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (k, g))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_near('SELECT DISTINCT query_id AS id FROM knn_queries')} SELECT DISTINCT least(qid, id) AS id_a, greatest(qid, id) AS id_b FROM rk WHERE rank <= 10",
    "p1_neighbours": f"WITH {_near('SELECT id FROM dn')} SELECT qid AS id_of, id, label, round(d2, 6) AS d2, rank FROM rk WHERE rank <= 10",
    "p3_found": f"WITH {_CROSS} SELECT DISTINCT least(t, h) AS id_a, greatest(t, h) AS id_b FROM m",
    "p3_counts": f"""WITH {_CROSS}, c AS (SELECT h, count(*) AS c FROM m GROUP BY 1)
 SELECT split, source, count(*) AS n_rows, count(c) AS n_overlapping, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_pairs FROM v LEFT JOIN c ON v.id = c.h WHERE split IN ('valid', 'test') GROUP BY 1, 2""",
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT doc_id, min(other) AS cluster_id FROM r GROUP BY 1",
    "p5_found": f"""WITH {_WORDS} SELECT term, CASE WHEN df < 5 THEN 'rare' ELSE 'common' END AS mark FROM ct, n WHERE df < 5 OR df > n.n / 4.0""",
    "p5_terms": f"""WITH {_WORDS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, cf AS n_occurrences, df AS n_records,
 CASE WHEN df < 5 THEN 'rare' WHEN df > n.n / 4.0 THEN 'common' END AS mark FROM ct, n""",
    "p6_found": f"""WITH {_WORDS}, sc AS (SELECT newid, tf.term, row_number() OVER (PARTITION BY newid ORDER BY round(tf * ln(n.n / df), 6) DESC, tf.term) AS rn
 FROM tf JOIN ct ON tf.term = ct.term, n WHERE df >= 2) SELECT newid, term FROM sc WHERE rn <= 3""",
    "p6_scores": f"""WITH {_WORDS}, size AS (SELECT sum(tf) AS s FROM tf), len AS (SELECT newid, sum(tf) AS len FROM tf GROUP BY 1),
 p AS (SELECT tf.newid, tf.term, tf, df, n.n, cf / s AS pc, (tf + 2000.0 * (cf / s)) / (len + 2000.0) AS pd
 FROM tf JOIN ct ON tf.term = ct.term JOIN len ON tf.newid = len.newid, n, size WHERE df >= 2)
 SELECT newid, term, tf, df AS n_records, round(pd * ln(pd / pc), 9) AS divergence, round(tf * ln(n / df), 6) AS tf_idf FROM p""",
    "p6_top": f"""WITH {_WORDS}, size AS (SELECT sum(tf) AS s FROM tf), len AS (SELECT newid, sum(tf) AS len FROM tf GROUP BY 1),
 p AS (SELECT tf.newid, tf.term, cf / s AS pc, (tf + 2000.0 * (cf / s)) / (len + 2000.0) AS pd FROM tf JOIN ct ON tf.term = ct.term JOIN len ON tf.newid = len.newid, size WHERE df >= 2),
 rk AS (SELECT newid, term, CAST(row_number() OVER (PARTITION BY newid ORDER BY round(pd * ln(pd / pc), 9) DESC, term) AS INTEGER) AS rank FROM p) SELECT * FROM rk WHERE rank <= 3""",
    "p10_ungraded": rf"""WITH RECURSIVE w AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1), c AS MATERIALIZED (SELECT doc_id, {_TEXT.format('text')} AS w,
 len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))) AS s FROM w),
 g AS MATERIALIZED (SELECT doc_id, 4.71 * list_sum(list_transform(w, lambda x: length(x))) / len(w) + 0.5 * len(w) / s - 21.43 AS g FROM c WHERE len(w) >= 20),
 m AS (SELECT avg(g) AS m FROM g), ue AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(w)) AS word FROM c WHERE len(w) BETWEEN 1 AND 19),
 uw AS (SELECT word, count(*) AS fc FROM ue GROUP BY 1), gw AS (SELECT word, sum(g) AS s, count(*) AS c FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM c) JOIN g USING (doc_id) GROUP BY 1),
 wd AS MATERIALIZED (SELECT word, coalesce(s, 0) AS s, coalesce(c, 0) + fc AS n FROM uw LEFT JOIN gw USING (word)),
 it AS (SELECT 0 AS step, doc_id, m AS x FROM (SELECT DISTINCT doc_id FROM ue), m
  UNION ALL SELECT any_value(v.step) + 1, ue.doc_id, avg(v.v) FROM ue JOIN (SELECT any_value(step) AS step, ue.word, (any_value(wd.s) + sum(it.x)) / any_value(wd.n) AS v FROM it JOIN ue USING (doc_id) JOIN wd ON wd.word = ue.word GROUP BY ue.word) v
   ON ue.word = v.word WHERE v.step < 200 GROUP BY ue.doc_id)
 SELECT it.doc_id, round(x, 3) AS level, len(w) AS n_words FROM it JOIN c USING (doc_id) WHERE step = 200""",
    "p7_found": f"WITH RECURSIVE {_PAIRS} SELECT item_a, item_b FROM pr WHERE n_ab >= 5 AND 500 * n_ab >= n_baskets AND n_ab * n_baskets >= 3 * n_a * n_b",
    "p7_pairs": f"WITH RECURSIVE {_PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, n_baskets, round(n_ab * CAST(n_baskets AS DOUBLE) / (n_a * n_b), 9) AS lift FROM pr",
    "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM lk",
    "p8_clean": f"WITH {_LEAKS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lk)",
    "p10_found": rf"""WITH w AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1), c AS (SELECT doc_id, {_TEXT.format('text')} AS w,
 len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))) AS s FROM w),
 g AS (SELECT doc_id, 4.71 * list_sum(list_transform(w, lambda x: length(x))) / len(w) + 0.5 * len(w) / s - 21.43 AS g FROM c WHERE len(w) >= 20)
 SELECT doc_id, CASE WHEN g <= 3 THEN 'easy' ELSE 'hard' END AS band FROM g WHERE g <= 3 OR g >= 15""",
}
