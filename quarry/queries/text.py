"""From articles to weighted vectors, and the clean-text stages by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators import corpus
from quarry.plans.lineage import broadcast_if_small, materialize
from quarry.plans.numbering import numbered
from quarry.queries.views import ART, CL, SINGLE, TR, clean
from quarry.sources import tables


def _articles(s: SparkSession, d: str) -> DataFrame:
    return tables.articles(s.read.parquet(f"{d}/reuters.parquet"))


def _single(s: SparkSession, d: str) -> DataFrame:
    return corpus.single_topic(_articles(s, d))


def _stop(s: SparkSession) -> DataFrame:
    """The stop-list as a table, as ``files.read_words`` gives it."""
    return s.createDataFrame([(w,) for w in fn.STOP_WORDS], "word STRING")


def _occ(s: SparkSession, d: str) -> DataFrame:
    return corpus.occurrences(_articles(s, d), _stop(s))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return corpus.term_counts(_occ(s, d))


def _weights(form: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        c = materialize(_counts(s, d), "counts")  # read for the vocabulary and for the weights
        return corpus.weighted(c, corpus.vocabulary(c), form).withColumn("val", F.round("val", 9))

    return run


def scan_class_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels with a class number by first document."""
    lab = tables.class_labels(s.read.parquet(f"{d}/class_labels.parquet"))
    first = lab.groupBy("label").agg(F.min("doc_id").alias("first"))
    ids = numbered(first, ["first", "label"], "class_id").select("label", F.col("class_id").cast("int").alias("class_id"))
    return lab.join(broadcast_if_small(ids, ids.count()), "label").select("doc_id", "label", "class_id")


def stem_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return fn.stem_vocabulary(_occ(s, d))


def _stem_counts(s: SparkSession, d: str) -> DataFrame:
    """Stems of the one-topic articles of the 20 top topics."""
    docs = corpus.of_top_topics(_single(s, d))
    return materialize(corpus.stem_counts(corpus.term_counts(corpus.occurrences(docs, _stop(s)))), "stems")


def stemmed_vectors(s: SparkSession, d: str) -> DataFrame:
    """The full text pipeline: one-topic articles of the 20 top topics, stems, log2 weights."""
    counts = _stem_counts(s, d)
    return corpus.weighted(counts, corpus.vocabulary(counts), "log2").withColumn("val", F.round("val", 9))


QUERIES = {
    "scan_sparse_triplets": lambda s, d: tables.triplets(s.read.parquet(f"{d}/sparse_triplets.parquet")),
    "scan_class_labels": scan_class_labels,
    "filter_single_topic": lambda s, d: corpus.of_top_topics(_single(s, d)).select("newid", "topic"),
    "topic_counts": lambda s, d: corpus.topic_counts(_single(s, d)),
    "top_topics": lambda s, d: corpus.top_topics(_single(s, d)),
    "clean_text": lambda s, d: _articles(s, d).where("body IS NOT NULL").select("newid", fn.clean(F.col("body")).alias("text")),
    "tokenize": lambda s, d: _articles(s, d).where("body IS NOT NULL").select("newid", F.posexplode(F.split(fn.clean(F.col("body")), " ")).alias("pos", "token")),
    "filter_tokens": _occ,
    "term_counts": _counts,
    "term_doc_freq": lambda s, d: corpus.doc_freq(_counts(s, d)),
    "vocab_min_df": lambda s, d: corpus.doc_freq(_counts(s, d)).where("df >= 5"),
    "vocabulary_index": lambda s, d: corpus.vocabulary(_counts(s, d)),
    "stem_vocabulary": stem_vocabulary,
    "term_weights_freq": _weights("freq"),
    "term_weights_sqrt": _weights("sqrt"),
    "term_weights_log2": _weights("log2"),
    "stemmed_vectors": stemmed_vectors,
    "stem_counts": _stem_counts,
    "stem_vocabulary_index": lambda s, d: corpus.vocabulary(_stem_counts(s, d)),
}

_TOK = f"tk AS (SELECT newid, unnest(string_split({clean('body')}, ' ')) AS term FROM art WHERE body IS NOT NULL)"
_STOP = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)
_CT = f"""{ART}, {_TOK}, occ AS (SELECT newid, term FROM tk WHERE term <> '' AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP})),
 ct AS (SELECT newid, term, count(*) AS n FROM occ GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM ct GROUP BY 1),
 vo AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df FROM df WHERE df >= 5)"""


# the stemmer by stages: a y after a consonant is written Y first, so that vowels are aeiouY
_VOWEL, _CONS = "[aeiouY]", "[^aeiouY]"
_M1, _M2 = f"{_VOWEL}{_CONS}", f"{_VOWEL}{_CONS}+{_VOWEL}+{_CONS}"
_CVC = f"{_CONS}{_VOWEL}[^aeiouYwxy]$"


def _replaced(w: str, table: dict[str, str], measure: str, extra: dict[str, str] | None = None) -> str:
    """The longest suffix that fits is replaced where the rest has the measure."""
    cases = ""
    for suffix in sorted(table, key=len, reverse=True):
        rest = f"left({w}, len({w}) - {len(suffix)})"
        also = (extra or {}).get(suffix, "")
        cases += f" WHEN ends_with({w}, '{suffix}') AND len({w}) > {len(suffix)} THEN CASE WHEN regexp_matches({rest}, '{measure}'){also.format(rest)} THEN {rest} || '{table[suffix]}' ELSE {w} END"
    return f"CASE{cases} ELSE {w} END"


def _stem_sql(source: str) -> str:
    """(term, stem) of the distinct terms of ``source``."""
    ing = f"CASE WHEN ends_with(w, 'ed') AND regexp_matches(left(w, len(w) - 2), '{_VOWEL}') THEN 2 WHEN ends_with(w, 'ing') AND regexp_matches(left(w, len(w) - 3), '{_VOWEL}') THEN 3 ELSE 0 END"
    short = f"(regexp_matches(b, '{_M1}') AND NOT regexp_matches(b, '{_M2}') AND regexp_matches(b, '{_CVC}'))"
    tidy = f"""CASE WHEN n = 0 THEN w WHEN ends_with(b, 'at') OR ends_with(b, 'bl') OR ends_with(b, 'iz') THEN b || 'e'
 WHEN len(b) > 1 AND b[-1] = b[-2] AND regexp_matches(b, '{_CONS}$') THEN CASE WHEN b[-1] IN ('l', 's', 'z') THEN b ELSE left(b, len(b) - 1) END WHEN {short} THEN b || 'e' ELSE b END"""
    last = "left(w, len(w) - 1)"
    st4 = {x: "" for x in fn._STEP4}
    stages = [
        ("s0", f"SELECT DISTINCT term, regexp_replace(term, '([^aeiouY])y', '\\1Y', 'g') AS w FROM {source}"),
        ("s1", "SELECT term, CASE WHEN len(term) <= 2 THEN w WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, len(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, len(w) - 1) ELSE w END AS w FROM s0"),
        ("s2", f"SELECT term, w, CASE WHEN ends_with(w, 'eed') THEN -1 ELSE {ing} END AS n FROM s1"),
        ("s3", "SELECT *, CASE WHEN n > 0 THEN left(w, len(w) - n) ELSE w END AS b FROM s2"),
        ("s4", f"SELECT term, CASE WHEN n = -1 THEN CASE WHEN regexp_matches(left(w, len(w) - 3), '{_M1}') THEN {last} ELSE w END ELSE {tidy} END AS w FROM s3"),
        ("s5", f"SELECT term, CASE WHEN (ends_with(w, 'y') OR ends_with(w, 'Y')) AND regexp_matches({last}, '{_VOWEL}') THEN {last} || 'i' ELSE w END AS w FROM s4"),
        ("s6", f"SELECT term, {_replaced('w', fn._STEP2, _M1)} AS w FROM s5"),
        ("s7", f"SELECT term, {_replaced('w', fn._STEP3, _M1)} AS w FROM s6"),
        ("s8", f"SELECT term, {_replaced('w', st4, _M2, {'ion': " AND right({0}, 1) IN ('s', 't')"})} AS w FROM s7"),
        ("s9", f"SELECT term, CASE WHEN ends_with(w, 'e') AND (regexp_matches({last}, '{_M2}') OR (regexp_matches({last}, '{_M1}') AND NOT regexp_matches({last}, '{_CVC}'))) THEN {last} ELSE w END AS w FROM s8"),
        ("stm", f"SELECT term, CASE WHEN len(term) <= 2 THEN term ELSE lower(CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{_M2}') THEN {last} ELSE w END) END AS stem FROM s9"),
    ]
    return ", ".join(f"{name} AS MATERIALIZED ({q})" for name, q in stages)


_STEMS = f"""WITH {SINGLE}, tp AS (SELECT topic FROM one GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 20), tk AS (SELECT newid, unnest(string_split({clean('body')}, ' ')) AS term FROM one SEMI JOIN tp USING (topic)),
 occ AS (SELECT newid, term FROM tk WHERE term <> '' AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP})), {_stem_sql('occ')},
 ct AS (SELECT newid, stem AS term, count(*) AS n FROM occ JOIN stm USING (term) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM ct GROUP BY 1),
 vo AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df FROM df WHERE df >= 5)"""


def _weight_sql(form: str) -> str:
    return f"""WITH {_CT}, w AS (SELECT newid AS doc_id, term_id AS dim, {form} AS w FROM ct JOIN vo USING (term))
 SELECT doc_id, dim, round(w / sum(w * w) OVER (PARTITION BY doc_id), 9) AS val FROM w"""


SQL = {
    "scan_sparse_triplets": f"WITH {TR} SELECT * FROM tr",
    "scan_class_labels": f"""WITH {CL}, f AS (SELECT label, CAST(row_number() OVER (ORDER BY min(doc_id), label) - 1 AS INTEGER) AS class_id FROM cl GROUP BY label)
 SELECT doc_id, label, class_id FROM cl JOIN f USING (label)""",
    "filter_single_topic": f"""WITH {SINGLE}, t AS (SELECT topic FROM one GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 20)
 SELECT newid, topic FROM one SEMI JOIN t USING (topic)""",
    "topic_counts": f"WITH {SINGLE} SELECT topic, count(*) AS n FROM one GROUP BY topic",
    "top_topics": f"WITH {SINGLE} SELECT topic, count(*) AS n FROM one GROUP BY topic ORDER BY n DESC, topic LIMIT 20",
    "clean_text": f"WITH {ART} SELECT newid, {clean('body')} AS text FROM art WHERE body IS NOT NULL",
    "tokenize": f"""WITH {ART}, l AS (SELECT newid, string_split({clean('body')}, ' ') AS l FROM art WHERE body IS NOT NULL)
 SELECT newid, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token FROM l""",
    "filter_tokens": f"WITH {_CT} SELECT newid, term FROM occ",
    "term_counts": f"WITH {_CT} SELECT newid, term, n FROM ct",
    "term_doc_freq": f"WITH {_CT} SELECT term, df FROM df",
    "vocab_min_df": f"WITH {_CT} SELECT term, df FROM df WHERE df >= 5",
    "vocabulary_index": f"WITH {_CT} SELECT term_id, term, df FROM vo",
    "stem_vocabulary": f"WITH {_CT}, {_stem_sql('occ')} SELECT term, stem FROM stm",
    "stem_counts": f"{_STEMS} SELECT newid, term, CAST(n AS BIGINT) AS n FROM ct",
    "stem_vocabulary_index": f"{_STEMS} SELECT term_id, term, df FROM vo",
    "stemmed_vectors": f"""{_STEMS}, w AS (SELECT newid AS doc_id, term_id AS dim, 1 + log2(n) AS w FROM ct JOIN vo USING (term))
 SELECT doc_id, dim, round(w / sum(w * w) OVER (PARTITION BY doc_id), 9) AS val FROM w""",
    "term_weights_freq": _weight_sql("CAST(n AS DOUBLE)"),
    "term_weights_sqrt": _weight_sql("1 + sqrt(n)"),
    "term_weights_log2": _weight_sql("1 + log2(n)"),
}
