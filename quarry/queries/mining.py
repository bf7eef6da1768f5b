"""Baskets, frequent itemsets and rules. The support threshold is 0.2 % of the transactions."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import itemsets as ops
from quarry.plans.lineage import materialize, shared_root
from quarry.queries.views import TX
from quarry.sources import files, tables

SHARE, CONF = 0.002, 0.3


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return materialize(tables.transactions(s.read.parquet(f"{d}/baskets.parquet")), "pairs")


def _supp(pairs: DataFrame) -> int:
    return max(2, math.ceil(SHARE * ops.n_transactions(pairs)))


def _sets(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    # many uses of the itemsets, such as both sides of the rules' join, read one table
    return materialize(ops.frequent_itemsets(p, _supp(p)), "itemsets")


def _key(c: str) -> F.Column:
    return F.concat_ws("|", F.transform(c, lambda x: x.cast("string"))).alias(c)


def scan_transactions(s: SparkSession, d: str) -> DataFrame:
    return tables.baskets(_pairs(s, d)).select("tid", F.size("items").cast("bigint").alias("n_items"), _key("items"))


def filter_frequent_items(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    return ops.frequent_pairs(p, _supp(p))


def frequent_itemsets(s: SparkSession, d: str) -> DataFrame:
    return _sets(s, d).select(_key("items"), "freq")


def assoc_rules(s: SparkSession, d: str) -> DataFrame:
    got = ops.association_rules(_sets(s, d), CONF)
    return got.select(_key("lhs"), _key("rhs"), "support", F.round("confidence", 9).alias("confidence"))


def itemsets_as_empty_rules(s: SparkSession, d: str) -> DataFrame:
    return ops.support_listing(_sets(s, d)).select(_key("lhs"), _key("rhs"), "support", "confidence")


def rule_lhs(s: SparkSession, d: str) -> DataFrame:
    return ops.rule_splits(_sets(s, d)).select(_key("items"), _key("rhs"), _key("lhs"))


def format_rules(s: SparkSession, d: str) -> DataFrame:
    return ops.association_rules(_sets(s, d), CONF).select(files.rule_line().alias("line"))


def itemset_counts_by_size(s: SparkSession, d: str) -> DataFrame:
    return _sets(s, d).groupBy(F.size("items").cast("bigint").alias("size")).agg(F.count("*").alias("n"))


def apriori_candidates(s: SparkSession, d: str) -> DataFrame:
    return ops.join_candidates(_sets(s, d)).select(_key("items"))


def rule_counts(s: SparkSession, d: str) -> DataFrame:
    """Itemsets, candidate splits and rules."""
    sets = _sets(s, d)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(sets, "n_itemsets").crossJoin(n(ops.rule_splits(sets), "n_candidates"))  # one row each
    return counts.crossJoin(n(ops.association_rules(sets, CONF), "n_rules"))


def encoded_baskets(s: SparkSession, d: str) -> DataFrame:
    """Transactions in the codes of the item dictionary."""
    p = _pairs(s, d)
    return ops.encoded(p, ops.item_dictionary(p)).groupBy("tid").agg(F.sort_array(F.collect_list("code")).alias("codes")).select("tid", _key("codes"))


def decoded_itemsets(s: SparkSession, d: str) -> DataFrame:
    """Itemsets mined on codes, as items again."""
    p = _pairs(s, d)
    words = materialize(ops.item_dictionary(p), "dictionary")
    coded = materialize(ops.encoded(p, words).select("tid", F.col("code").alias("item")), "coded")
    sets = materialize(ops.frequent_itemsets(coded, _supp(p)), "itemsets")
    return ops.decoded(sets, words).select(_key("items"), "freq")


def read_back_transactions(s: SparkSession, d: str) -> DataFrame:
    """Transactions as text lines, parsed again."""
    path = f"{shared_root(s)}/transactions-{uuid.uuid4().hex}"
    files.write_lines(_pairs(s, d), F.concat_ws(" ", "tid", "item"), path)
    return files.read_transactions(s, path)


QUERIES = {
    "scan_transactions": scan_transactions,
    "baskets_sorted": lambda s, d: tables.baskets(_pairs(s, d)).select("tid", _key("items")),
    "item_counts": lambda s, d: ops.item_counts(_pairs(s, d)),
    "item_dictionary": lambda s, d: ops.item_dictionary(_pairs(s, d)),
    "filter_frequent_items": filter_frequent_items,
    "frequent_itemsets": frequent_itemsets,
    "itemset_counts_by_size": itemset_counts_by_size,
    "assoc_rules": assoc_rules,
    "itemsets_as_empty_rules": itemsets_as_empty_rules,
    "rule_lhs": rule_lhs,
    "format_rules": format_rules,
    "apriori_candidates": apriori_candidates,
    "read_back_transactions": read_back_transactions,
    "rule_counts": rule_counts,
    "encoded_baskets": encoded_baskets,
    "decoded_itemsets": decoded_itemsets,
}

_F = f"""{TX}, lim AS (SELECT greatest(2, CAST(ceil({SHARE} * count(DISTINCT tid)) AS BIGINT)) AS m FROM tx),
 hot AS (SELECT item FROM tx, lim GROUP BY item, m HAVING count(*) >= m), fx AS (SELECT tid, item FROM tx SEMI JOIN hot USING (item))"""


def _levels(top: int) -> str:
    parts = ["s1 AS MATERIALIZED (SELECT tid, [item] AS items FROM fx)", "l1 AS (SELECT items, count(*) AS freq FROM s1 GROUP BY 1)"]
    for k in range(2, top + 1):
        parts += [
            f"c{k} AS MATERIALIZED (SELECT s.tid, list_append(s.items, fx.item) AS items FROM s{k - 1} s JOIN fx ON s.tid = fx.tid AND fx.item > s.items[-1])",
            f"l{k} AS MATERIALIZED (SELECT items, count(*) AS freq FROM c{k}, lim GROUP BY items, m HAVING count(*) >= m)",
            f"s{k} AS MATERIALIZED (SELECT tid, items FROM c{k} SEMI JOIN l{k} USING (items))",
        ]
    return ", ".join(parts) + ", fi AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT items, freq FROM l{k}" for k in range(1, top + 1)) + ")"


_FI = f"WITH {_F}, {_levels(10)}"
_SPLIT = """, sp AS (SELECT items, freq, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS rhs, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS lhs
 FROM (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM fi WHERE len(items) > 1)),
 fk AS MATERIALIZED (SELECT array_to_string(items, '|') AS k, freq FROM fi), sk AS MATERIALIZED (SELECT lhs, rhs, freq, array_to_string(lhs, '|') AS k FROM sp),
 rl AS (SELECT sk.lhs, sk.rhs, sk.freq AS support, sk.freq / fk.freq AS confidence FROM sk JOIN fk USING (k))"""
_S = "array_to_string({0}, '|') AS {0}"

SQL = {
    "scan_transactions": f"WITH {TX} SELECT tid, count(*) AS n_items, array_to_string(list_sort(list(item)), '|') AS items FROM tx GROUP BY tid",
    "baskets_sorted": f"WITH {TX} SELECT tid, array_to_string(list_sort(list(item)), '|') AS items FROM tx GROUP BY tid",
    "item_counts": f"WITH {TX} SELECT item, count(*) AS n FROM tx GROUP BY item",
    "item_dictionary": f"WITH {TX} SELECT item, n, CAST(row_number() OVER (ORDER BY n DESC, item) AS INTEGER) AS code FROM (SELECT item, count(*) AS n FROM tx GROUP BY item)",
    "filter_frequent_items": f"WITH {_F} SELECT tid, item FROM fx",
    "frequent_itemsets": f"{_FI} SELECT {_S.format('items')}, freq FROM fi",
    "itemset_counts_by_size": f"{_FI} SELECT len(items) AS size, count(*) AS n FROM fi GROUP BY 1",
    "assoc_rules": f"{_FI}{_SPLIT} SELECT {_S.format('lhs')}, {_S.format('rhs')}, support, round(confidence, 9) AS confidence FROM rl WHERE confidence > {CONF}",
    "itemsets_as_empty_rules": f"{_FI} SELECT array_to_string(items, '|') AS lhs, '' AS rhs, freq AS support, CAST(-1 AS DOUBLE) AS confidence FROM fi",
    "rule_lhs": f"{_FI}{_SPLIT} SELECT {_S.format('items')}, {_S.format('rhs')}, {_S.format('lhs')} FROM sp",
    "format_rules": f"""{_FI}{_SPLIT} SELECT array_to_string(lhs, ' ') || ' | ' || array_to_string(rhs, ' ') || ' | ' || support || ' | ' || printf('%.4f', round(confidence, 4)) AS line
 FROM rl WHERE confidence > {CONF}""",
    "apriori_candidates": f"""{_FI}, hd AS MATERIALIZED (SELECT len(items) || ':' || array_to_string(items[:-2], '|') AS head, items, items[-1] AS tail FROM fi)
 SELECT array_to_string(list_append(a.items, b.tail), '|') AS items FROM hd a JOIN hd b ON a.head = b.head WHERE a.tail < b.tail""",
    "read_back_transactions": f"WITH {TX} SELECT tid, item FROM tx",
    "rule_counts": f"""{_FI}{_SPLIT} SELECT (SELECT count(*) FROM fi) AS n_itemsets, (SELECT count(*) FROM sp) AS n_candidates, (SELECT count(*) FROM rl WHERE confidence > {CONF}) AS n_rules""",
    "encoded_baskets": f"""WITH {TX}, dc AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS code FROM (SELECT item, count(*) AS n FROM tx GROUP BY item))
 SELECT tid, array_to_string(list_sort(list(code)), '|') AS codes FROM tx JOIN dc USING (item) GROUP BY tid""",
    "decoded_itemsets": f"{_FI} SELECT {_S.format('items')}, freq FROM fi",
}
