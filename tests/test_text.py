import pytest
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators import corpus

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "matting": "mat", "mating": "mate", "meeting": "meet",
    "milling": "mill", "messing": "mess", "meetings": "meet", "agreed": "agre", "disabled": "disabl", "relational": "relat", "sky": "sky",
    "happy": "happi", "adoption": "adopt", "controll": "control", "analogy": "analog", "be": "be", "x": "x",
}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert fn.stem(word) == STEMS[word]


def test_clean(spark):
    df = spark.createDataFrame([("The café's 1987 U.S. oil-price_index ROSE 3pct",), (None,), ("",)], "t STRING")
    got = [r[0] for r in df.select(fn.clean(F.col("t"))).collect()]
    assert got == ["the caf s 1987 u s  oil price index rose 3pct", None, ""]
    words = [r[0] for r in df.select(fn.tokens(F.col("t"))).collect()]
    assert words == [["the", "caf", "s", "u", "s", "oil", "price", "index", "rose", "3pct"], None, []]


def test_weightings(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 2)], "newid BIGINT, term STRING, n BIGINT")
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "term_id INT, term STRING")
    want = {"freq": [0.214286, 0.071429, 0.142857], "sqrt": [0.15799, 0.115657, 0.13961], "log2": [0.221277, 0.085602, 0.171203]}
    for form, vals in want.items():
        got = [r["val"] for r in corpus.weighted(counts, vocab, form).orderBy("dim").collect()]
        assert got == pytest.approx(vals, abs=1e-6)
    unit = corpus.weighted(counts, vocab, "freq", "l2").agg(F.sum(F.col("val") ** 2)).first()[0]
    assert unit == pytest.approx(1)
    with pytest.raises(ValueError):
        corpus.weighted(counts, vocab, "cubed")


def test_stop_list_table(spark):
    docs = spark.createDataFrame([(1, "oil and corn")], "newid BIGINT, body STRING")
    stop = spark.createDataFrame([("corn",)], "word STRING")
    assert {r["term"] for r in corpus.occurrences(docs, stop).collect()} == {"oil", "and"}
    assert {r["term"] for r in corpus.occurrences(docs).collect()} == {"oil", "corn"}


def test_document_without_words_keeps_labels(spark):
    docs = spark.createDataFrame([(1, ["x"], "12 34"), (2, ["y"], "oil"), (3, ["x", "y"], "oil"), (4, [], "oil"), (5, ["x"], None)], "newid BIGINT, topics ARRAY<STRING>, body STRING")
    single = corpus.single_topic(docs)
    assert {(r["newid"], r["topic"]) for r in single.collect()} == {(1, "x"), (2, "y")}
    assert [r["newid"] for r in corpus.term_counts(corpus.occurrences(single)).collect()] == [2]
