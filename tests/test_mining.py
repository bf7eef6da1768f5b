import random
from collections import Counter
from itertools import combinations

import pytest

from quarry.operators import itemsets as ops
from quarry.sources import files, tables

F1 = [(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [1, 2]), (4, [3, 4]), (5, [1, 3])]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(t, i) for t, xs in F1 for i in xs], "tid INT, item INT")


def test_itemsets(pairs):
    got = {tuple(r["items"]): r["freq"] for r in ops.frequent_itemsets(pairs, 2).collect()}
    assert got == {(1,): 4, (2,): 3, (3,): 4, (1, 2): 3, (1, 3): 3, (2, 3): 2, (1, 2, 3): 2}


def test_rules(pairs):
    sets = ops.frequent_itemsets(pairs, 2)
    got = {(tuple(r["lhs"]), tuple(r["rhs"])): (r["support"], round(r["confidence"], 4)) for r in ops.association_rules(sets, 0.6).collect()}
    assert got == {
        ((2,), (1,)): (3, 1.0), ((1,), (2,)): (3, 0.75), ((3,), (1,)): (3, 0.75), ((1,), (3,)): (3, 0.75), ((2,), (3,)): (2, 0.6667),
        ((2, 3), (1,)): (2, 1.0), ((1, 3), (2,)): (2, 0.6667), ((1, 2), (3,)): (2, 0.6667), ((2,), (1, 3)): (2, 0.6667),
    }


def test_confidence_is_strict(pairs):
    assert ops.association_rules(ops.frequent_itemsets(pairs, 2), 0.75).count() == 2


def test_gate(pairs):
    sets = ops.frequent_itemsets(pairs, 2)
    plain = ops.rules_or_listing(sets, 20, 0.6).collect()
    assert len(plain) == 7 and all(r["rhs"] == [] and r["confidence"] == -1 for r in plain)
    assert ops.rules_or_listing(sets, 21, 0.6).count() == 9


def test_support_falls_with_size(pairs):
    got = {frozenset(r["items"]): r["freq"] for r in ops.frequent_itemsets(pairs, 1).collect()}
    assert all(got[a] >= got[b] for a in got for b in got if a < b)


def test_empty(spark):
    none = spark.createDataFrame([], "tid INT, item INT")
    sets = ops.frequent_itemsets(none, 2)
    assert sets.count() == 0 and ops.association_rules(sets, 0.5).count() == 0


def test_dirty_transactions(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (None, 5, "x"), (1, None, "x"), (1, 0, "x"), (2, 7, None)], "tid INT, item INT, items STRING")
    assert {tuple(r) for r in tables.transactions(df).collect()} == {(1, 5), (2, 7)}


def test_rule_lines(spark, pairs, tmp_path):
    rules = ops.association_rules(ops.frequent_itemsets(pairs, 2), 0.9).unionByName(ops.support_listing(ops.frequent_itemsets(pairs, 4)))
    files.write_lines(rules, files.rule_line(), str(tmp_path / "r"))
    got = {r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()}
    assert got == {"2 | 1 | 3 | 1.0000", "2 3 | 1 | 2 | 1.0000", "1 | {} | 4 | -1", "3 | {} | 4 | -1"}


def test_readers(spark, tmp_path):
    (tmp_path / "t").write_text("1 3\n1 4\n2 3\n")
    (tmp_path / "m").write_text("0, 2, 0.5\n0, 3, 1\n")
    (tmp_path / "c").write_text("0, grain\n1,  oil \n")
    (tmp_path / "d").write_text("3, 0.5, 1\n4,2, 3\n")
    (tmp_path / "s").write_text("a b\nthe  a\n")
    for n in ("x.sgm", "y.SGM", "z.txt"):
        (tmp_path / "dir").mkdir(exist_ok=True)
        (tmp_path / "dir" / n).write_text("<a>\n</a>")
    assert [tuple(r) for r in files.read_transactions(spark, str(tmp_path / "t")).collect()] == [(1, 3), (1, 4), (2, 3)]
    assert [tuple(r) for r in files.read_triplets(spark, str(tmp_path / "m")).collect()] == [(0, 2, 0.5), (0, 3, 1.0)]
    assert [tuple(r) for r in files.read_class_labels(spark, str(tmp_path / "c")).collect()] == [(0, "grain"), (1, "oil")]
    assert [tuple(r) for r in files.read_dense(spark, str(tmp_path / "d")).collect()] == [(3, [0.5, 1.0]), (4, [2.0, 3.0])]
    assert {r["word"] for r in files.read_words(spark, str(tmp_path / "s")).collect()} == {"a", "b", "the"}
    assert files.read_markup(spark, str(tmp_path / "dir")).count() == 2


def test_bad_numbers_fail(spark, tmp_path):
    (tmp_path / "t").write_text("1 x\n")
    with pytest.raises(Exception):
        files.read_transactions(spark, str(tmp_path / "t")).collect()


def test_short_image_file(spark):
    with pytest.raises(ValueError):
        files.first_images(spark.range(3), 4)


def test_other_sinks(spark, tmp_path):
    w = spark.createDataFrame([(1, 1, -0.25), (1, 0, 0.5), (0, 0, 1.0), (0, 1, 2.0)], "label INT, dim INT, w DOUBLE")
    files.write_weights(w, str(tmp_path / "w"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "w")).collect()] == [" 1.0000, 2.0000", " 0.5000,-0.2500"]
    files.write_predictions(spark.createDataFrame([(2, 7), (1, 3)], "id BIGINT, pred INT"), str(tmp_path / "p"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["3", "7"]
    files.write_vocabulary(spark.createDataFrame([("b", 1), ("a", 0)], "term STRING, term_id INT"), str(tmp_path / "v"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["a", "b"]
    t = spark.createDataFrame([(1, 2, 0.5, "freq"), (1, 2, 0.7, "sqrt")], "doc_id BIGINT, dim INT, val DOUBLE, weighting STRING")
    files.write_weightings(t, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("weighting = 'sqrt'").first()["val"] == 0.7
    files.write_csv(t.select("doc_id", "dim", "val"), str(tmp_path / "c"))
    assert files.read_triplets(spark, str(tmp_path / "c")).count() == 2


def test_large_itemsets_have_their_rules(spark):
    """Twenty-one items: every split comes out, in digits of a mask; more than 62 items raise."""
    sets = spark.createDataFrame([(list(range(1, 22)), 3)], "items ARRAY<INT>, freq BIGINT")
    got = ops.rule_splits(sets)
    assert got.count() == 2**21 - 2
    assert got.where("size(lhs) + size(rhs) <> 21 OR size(lhs) = 0 OR size(rhs) = 0").count() == 0
    with pytest.raises(Exception, match="62"):
        ops.rule_splits(spark.createDataFrame([(list(range(63)), 3)], "items ARRAY<INT>, freq BIGINT")).limit(1).collect()


@pytest.mark.parametrize(("rows", "baskets", "candidates"), [(4_000_000, 64, 2_000_000), (2000, 8, 2_000_000), (2000, 8, 3), (100, 64, 2_000_000)])
def test_itemsets_in_blocks(spark, monkeypatch, rows, baskets, candidates):
    """One block, several, too many candidates, and baskets too many for a block: the same sets."""
    monkeypatch.setattr(ops, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ops, "BASKETS", baskets)
    monkeypatch.setattr(ops, "MAX_CANDIDATES", candidates)
    rng = random.Random(3)
    sets = {t: set(rng.choices(range(1, 25), weights=range(25, 1, -1), k=rng.randint(1, 9))) for t in range(2000)}
    want = Counter()
    for x in sets.values():
        for k in range(1, len(x) + 1):
            want.update(combinations(sorted(x), k))
    df = spark.createDataFrame([(t, i) for t, x in sets.items() for i in x], "tid INT, item INT")
    got = {tuple(r["items"]): r["freq"] for r in ops.frequent_itemsets(df, 60).collect()}
    assert got == {k: v for k, v in want.items() if v >= 60} and len(got) > 50
