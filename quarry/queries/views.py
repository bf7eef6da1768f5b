"""The cleaned tables of ``sources.tables`` again, as SQL common table expressions."""

TX = "tx AS (SELECT DISTINCT tid, item FROM baskets WHERE tid IS NOT NULL AND item >= 1)"
TR = """tr AS (SELECT doc_id, dim, min(val) AS val FROM sparse_triplets
 WHERE doc_id IS NOT NULL AND dim >= 0 AND val IS NOT NULL AND NOT isnan(val) GROUP BY 1, 2)"""
CL = """cl AS (SELECT doc_id, min(lower(trim(label))) AS label FROM class_labels
 WHERE doc_id IS NOT NULL AND trim(label) <> '' GROUP BY 1)"""
ASG = """asg AS (SELECT doc_id, cluster_no AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run_no, cluster_no) AS rn
 FROM kc_assignment WHERE doc_id IS NOT NULL AND run_no IS NOT NULL AND cluster_no >= 0) WHERE rn = 1)"""
DN_ANY = """dn AS (SELECT DISTINCT id, label, features, split FROM dense_labelled WHERE id IS NOT NULL
 AND len(features) = 49 AND len(list_filter(features, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(features, lambda x: x <> 0)) > 0)"""
DN_LABEL = DN_ANY.replace("id IS NOT NULL", "id IS NOT NULL AND label IS NOT NULL")
DN = DN_ANY.replace("id IS NOT NULL", "id IS NOT NULL AND label IS NOT NULL AND split IS NOT NULL")
ART = """art AS (SELECT DISTINCT newid, list_sort(list_distinct(list_filter(list_transform(coalesce(topics, []), lambda t: trim(t)), lambda t: t <> ''))) AS topics, body
 FROM reuters WHERE newid IS NOT NULL)"""
SINGLE = f"""{ART}, one AS (SELECT newid, topics[1] AS topic, body FROM art WHERE len(topics) = 1 AND body IS NOT NULL)"""


def clean(col: str) -> str:
    return f"regexp_replace(lower(regexp_replace({col}, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]', ' ', 'g')"
