import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import terms as t

DOCS = [
    (1, "The oil price, the OIL café 1987 x9", "a"), (2, "oil and corn; corn-crop", "a"), (3, "12 34 !!", "b"), (4, None, "b"), (5, "", "c"),
    (2, "oil and corn; corn-crop", "z"), (None, "lost words", "a"), (6, "rare " + "corn " * 5000, "a"), (7, "oil \u0000é中 oil", None),
]
WORDS = {1: ["the", "oil", "price", "the", "oil", "caf", "x9"], 2: ["oil", "and", "corn", "corn", "crop"], 6: ["rare"] + ["corn"] * 5000, 7: ["oil", "oil"]}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "newid BIGINT, body STRING, term STRING")


def test_frequencies(docs):
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in t.term_frequencies(docs, rare_below=2, common_share=0.5).collect()}
    occ, df = Counter(w for ws in WORDS.values() for w in ws), Counter(w for ws in WORDS.values() for w in set(ws))
    mark = lambda n: "rare" if n < 2 else "common" if n > 2 else None
    assert got == {w: (occ[w], df[w], mark(df[w])) for w in occ}


def test_dictionary_is_dense_and_ordered(docs):
    got = sorted((r["term_id"], r["term"]) for r in t.term_frequencies(docs).collect())
    assert [i for i, _ in got] == list(range(len(got))) and [w for _, w in got] == sorted(w for _, w in got)


def test_ranges(docs, monkeypatch):
    monkeypatch.setattr(t, "RANGE", 2)
    monkeypatch.setattr(t, "FLUSH", 3)
    got = {r["term"]: r["n_occurrences"] for r in t.term_frequencies(docs).collect()}
    assert got == Counter(w for ws in WORDS.values() for w in ws)


def test_scores(docs):
    got = {(r["rec"], r["term"]): r for r in t.distinctive_terms(docs, mu=10.0).collect()}
    df = Counter(w for ws in WORDS.values() for w in set(ws))
    size, cf = sum(map(len, WORDS.values())), Counter(w for ws in WORDS.values() for w in ws)
    assert set(got) == {(d, w) for d, ws in WORDS.items() for w in ws if df[w] >= 2}
    for (d, w), r in got.items():
        tf, pc = WORDS[d].count(w), cf[w] / size
        pd = (tf + 10 * pc) / (len(WORDS[d]) + 10)
        assert r["tf_idf"] == pytest.approx(tf * math.log(len(WORDS) / df[w]))
        assert r["divergence"] == pytest.approx(pd * math.log(pd / pc))


def test_top_by_divergence_loses_none(spark):
    """Records of one kind of word, of few words, of very many, of common words only."""
    rng = np.random.default_rng(4)
    say = lambda n, m: " ".join(f"w{i}" for i in rng.zipf(1.3, n) % m)
    rows = [(i, say(int(rng.integers(1, 80)), 300)) for i in range(150)] + [(200 + i, "w1 " * (i + 1) + "w2 w3") for i in range(20)] + [(300, say(9000, 40)), (301, "w1"), (302, "w250 " * 50 + "w1 w2 w3 " * 800), (303, None)]
    df = t.distinctive_terms(spark.createDataFrame(rows, "newid BIGINT, body STRING")).cache()
    top = lambda got: {(r["rec"], r["term"], r["rank"]) for r in got.collect()}
    assert top(t.top_by_divergence(df, 3)) == top(t.top_terms(df, "tf_idf", 3))
    assert t.top_by_divergence(df.limit(0), 3).count() == 0


def test_least_divergence_is_a_bound():
    """No term of any make-up falls below the divergence its weight calls for."""
    rng = np.random.default_rng(6)
    size, n, mu = 2e5, 3000.0, 2000.0
    df = rng.integers(2, 2999, 20_000)
    cf = np.minimum(df * rng.uniform(1, 9, len(df)), size / 2)
    spread = float((cf / df).max())
    length = rng.integers(1, 6000, len(df)).astype(float)
    tf = np.minimum(np.ceil(rng.exponential(6, len(df))), length)
    pc = cf / size
    pd = (tf + mu * pc) / (length + mu)
    weight = tf * np.log(n / df)
    least = t.least_divergence(length, weight, size, n, spread, mu)
    assert (pd * np.log(pd / pc) >= least - 1e-12).all() and np.isfinite(least).mean() > 0.9


def test_top_terms_break_ties_by_term(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0000000001), (1, "c", 2.0), (1, "d", 0.5)], "rec BIGINT, term STRING, s DOUBLE")
    assert [r["term"] for r in t.top_terms(rows, "s", 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_empty(spark):
    none = spark.createDataFrame([], "newid BIGINT, body STRING")
    assert t.term_frequencies(none).count() == 0 and t.distinctive_terms(none).count() == 0
