import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


def made(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id BIGINT, text STRING, source STRING, copy_no STRING, n_tokens INT")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source STRING, target_share DOUBLE, max_repeats INT")


DOCS = [(i, "word " * (5 + i % 7), " Big" if i % 3 else "small ") for i in range(300)] + [
    (900, None, "big"), (901, "", "big"), (902, "a b", None), (903, "a b", "other"), (None, "a b", "big"), (1, "word " * 6, " Big"),
]


@pytest.mark.parametrize("bucket", [20_000, 10])
def test_shares(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    draw, report = mixing.mix_sources(made(spark, DOCS), targets(spark, [("big", 0.5, 1), ("SMALL", 0.5, 4)]), total_tokens=2000)
    rows = draw.collect()
    got = {r["source"]: r for r in report.collect()}
    assert abs(got["big"]["actual_share"] - 0.5) < 0.01 and got["small"]["most_used"] == 2
    assert sum(r["n_tokens"] for r in rows) == max(r["tokens_so_far"] for r in rows) <= 2000
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    ordered = sorted(rows, key=lambda r: (r["finish_time"], r["source"], r["doc_id"], r["copy_no"]))
    assert [r["tokens_so_far"] for r in ordered] == sorted(r["tokens_so_far"] for r in rows)
    # what is drawn of a source is used evenly: no second pass before the first is over
    used = [r for r in rows if r["source"] == "small"]
    assert len({r["doc_id"] for r in used if r["copy_no"] == 1}) == 100


def test_caps_and_absent_sources(spark):
    t = targets(spark, [("big", 0.2, 1), ("small", 0.4, 2), ("absent", 0.3, 9), (None, 0.1, 1), ("none", None, 1), ("zero", 0.0, 1), ("never", 0.1, 0)])
    draw, report = mixing.mix_sources(made(spark, DOCS), t, total_tokens=10**6)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "small", "absent", "never"}
    assert got["small"]["used_up"] and got["small"]["most_used"] == 2 and got["big"]["docs_drawn"] == 200
    assert got["absent"]["tokens_drawn"] == 0
    assert draw.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_default_budget_is_the_corpus(spark):
    draw, report = mixing.mix_sources(made(spark, DOCS), targets(spark, [("big", 0.5, 1), ("small", 0.5, 3)]))
    whole = sum(r["tokens_available"] for r in report.collect())
    assert whole - 20 <= draw.agg(F.sum("n_tokens")).first()[0] <= whole


def test_shortfall_is_reported(spark):
    """One source holds nearly all tokens: the others end at their caps and the report says by how
    much; with a smaller total the targets hold."""
    t = targets(spark, [("big", 0.5, 1), ("small", 0.35, 2), ("absent", 0.15, 1)])
    docs = made(spark, DOCS + [(1000 + i, "word " * 9, "big") for i in range(2000)])
    got = {r["source"]: r for r in mixing.mix_sources(docs, t)[1].collect()}
    drawn = sum(r["tokens_drawn"] for r in got.values())
    assert got["small"]["used_up"] and got["big"]["tokens_short"] == 0
    for n in ("small", "absent"):
        assert abs(got[n]["tokens_short"] - (got[n]["target_share"] * drawn - got[n]["tokens_drawn"])) <= 1
    got = {r["source"]: r for r in mixing.mix_sources(docs, t, total_tokens=2000)[1].collect()}
    assert abs(got["big"]["actual_share"] / got["small"]["actual_share"] - 0.5 / 0.35) < 0.05


def test_empty(spark):
    docs = made(spark, DOCS)
    draw, report = mixing.mix_sources(docs.limit(0), targets(spark, [("big", 1.0, 1)]))
    assert draw.count() == 0 and report.first()["tokens_drawn"] == 0
    assert mixing.mix_sources(docs, targets(spark, []))[0].count() == 0


def test_running_total(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(1000)).alias("k"), (F.col("id") % 3).alias("v"))
    got = {r["k"]: r["s"] for r in mixing.running_total(df, ["k"], "v", "s").collect()}
    total, value = 0, {r["k"]: r["v"] for r in df.collect()}
    for k in range(1000):
        total += value[k]
        assert got[k] == total


def test_tokens(spark):
    got = mixing.token_counts(spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "d INT, text STRING"), "text").collect()
    assert [r["n_tokens"] for r in got][:3] == [2, 0, 0] and got[3]["n_tokens"] > 1


def test_long_texts(monkeypatch):
    import base64
    import random

    import tiktoken

    with open(mixing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert mixing.count_tokens(enc, " " * 1_000_000 + "end" + "\n" * 300_000) > 0
    monkeypatch.setattr(mixing, "LONG", 40)
    monkeypatch.setattr(mixing, "_BLANKS", mixing.re.compile(r"\s{41,}"))
    rnd = random.Random(0)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "word", "é", " ", " ", "\n", "  ", "7", "!?", " " * rnd.randint(30, 90), "'s", "\t", "it's "]) for _ in range(rnd.randint(0, 120)))
        assert mixing.count_tokens(enc, t) == len(enc.encode_ordinary(t)), repr(t)
