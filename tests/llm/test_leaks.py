import re

import numpy as np
import pytest

from quarry.llm import leaks

W = re.compile(r"[^\W_]+")


def brute(docs, items, n):
    out = set()
    for i, t in items:
        w = W.findall((t or "").lower())
        k = min(n, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, x in docs:
            y = W.findall((x or "").lower())
            if d is not None and i is not None and any(tuple(y[j : j + k]) in grams for j in range(len(y) - k + 1) if k):
                out.add((d, i))
    return out


def tables(spark, docs, items):
    a = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id BIGINT, text STRING, source STRING, item_id INT")
    return a, spark.createDataFrame([(*i, "v") for i in items], "item_id BIGINT, item_text STRING, eval_set STRING")


@pytest.mark.parametrize("shard", [40, 1_000_000])
@pytest.mark.parametrize("group", [15, 2_000_000])
def test_against_brute_force(spark, monkeypatch, shard, group):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    monkeypatch.setattr(leaks, "GROUP_WORDS", group)
    rng = np.random.default_rng(0)
    say = lambda n: " ".join(rng.choice(list("abcdé"), n))
    docs = [(i, say(int(rng.integers(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (None, say(30)), (102, "?!"), (103, say(3000))]
    items = [(i, say(int(rng.integers(0, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (None, say(5)), (53, docs[3][1] or "a"), (54, "A, b")]
    got = {tuple(r) for r in leaks.leaked_documents(*tables(spark, docs, items), length=5).collect()}
    assert got == brute(docs, items, 5) and got


@pytest.mark.parametrize("at_once", [1, 2])
def test_several_passes(spark, monkeypatch, at_once):
    monkeypatch.setattr(leaks, "GROUP_WORDS", 6)
    monkeypatch.setattr(leaks, "AT_ONCE", at_once)
    docs = [(i, f"w{i} a b c d e f") for i in range(12)]
    items = [(i, f"w{i} a b") for i in range(12)] + [(90, "c d e"), (91, "e d c")]
    got = {tuple(r) for r in leaks.leaked_documents(*tables(spark, docs, items), length=3).collect()}
    assert got == brute(docs, items, 3) and len(got) == 24


@pytest.mark.parametrize("depth", [1, 2, 5, 10])
def test_suffix_array_is_sorted(depth):
    rng = np.random.default_rng(depth)
    codes = np.concatenate([rng.integers(0, 3, 400), rng.integers(0, 2**62, 100), np.full(30, 7), [-1]])
    order = leaks.suffix_array(codes, depth)
    cut = [tuple(codes[i : i + depth].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(codes))) and cut == sorted(cut)


def test_passages_are_longest(spark):
    a = "zero one two three four five six seven"
    t = tables(spark, [(1, "x y ONE two, three; four five q one two three"), (2, "one two")], [(9, a)])
    got = {tuple(r) for r in leaks.passages(*t, length=3).collect()}
    assert got == {(1, 9, 2, 5), (1, 9, 8, 3)}


def test_passage_never_crosses_documents(spark):
    t = tables(spark, [(1, "a b c"), (2, "d e f")], [(1, "b c d e"), (2, "c d")])
    assert leaks.leaked_documents(*t, length=4).count() == 0


def test_removal_keeps_columns(spark):
    docs, items = tables(spark, [(1, "a b c"), (2, "q"), (3, None)], [(1, "a b c")])
    left = leaks.remove_leaks(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3}


def test_empty(spark):
    docs, items = tables(spark, [(1, "a b c")], [(1, "a b c")])
    assert leaks.leaked_documents(docs.limit(0), items).count() == 0
    assert leaks.leaked_documents(docs, items.limit(0)).count() == 0
