import random

import pytest
from pyspark.sql import functions as F

from quarry.plans import lineage
from quarry.plans.numbering import numbered, one_row_per_key
from quarry.plans.skew import skew_join


def test_numbered(spark):
    values = random.Random(0).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v INT").repartition(7)
    got = {r["v"]: r["n"] for r in numbered(df, [F.desc("v")], "n", 1).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values, reverse=True))}
    assert numbered(df.limit(0), ["v"], "n").count() == 0


@pytest.mark.parametrize("again", [[], [(1, "a"), (3, None)]])
def test_one_row_per_key(spark, again):
    df = spark.createDataFrame([(1, "b"), (2, "x"), (3, "z"), (4, None), (None, "y"), *again], "k INT, v STRING")
    assert {tuple(r) for r in one_row_per_key(df, "k", "v").collect()} == {(1, "a" if again else "b"), (2, "x"), (3, "z"), (4, None)}


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(10).select("id", (F.col("id") % 2 == 0).alias("even"))
    got = lineage.materialize(df)
    assert got.schema.simpleString() == df.schema.simpleString() and got.count() == 10


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class Stub:
    """A session as far as ``shared_root`` looks at one."""

    def __init__(self, value, master, own=None):
        self.conf, self.sparkContext, self._jsc, self.own = Conf(value), self, self, own
        self.applicationId, self.master = f"{value}{master}{own}", master

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.own is not None

    get = lambda self: self.own


def test_setting_names_the_folder(monkeypatch):
    monkeypatch.setattr(lineage, "_roots", {})
    assert lineage.shared_root(Stub("hdfs://x/y/", "yarn")).startswith("hdfs://x/y/quarry-")
    assert lineage.shared_root(Stub(None, "yarn", "s3a://b/c")).startswith("s3a://b/c/quarry-")
    assert lineage.shared_root(Stub(None, "local[2]")).startswith("file:///")
    with pytest.raises(ValueError):
        lineage.shared_root(Stub(None, "spark://host:7077"))


def test_release_deletes_the_table(spark):
    got = lineage.materialize(spark.range(5))
    lineage.release(got, spark.range(3))
    with pytest.raises(Exception):
        got.count()


def test_shuffles_go_with_the_write(spark):
    """No shuffle file of a written table is left, and the setting is as before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x for x in disk.getAllFiles().mkString("|").split("|") if x.endswith(".data")}
    before = names()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    lineage.materialize(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert not names() - before and spark.conf.get(setting, None) == was


def test_broadcast_is_bounded_by_bytes(spark):
    assert lineage.broadcast_if_small(df := spark.range(1000), 1000, max_bytes=20_000) is df
    text = lineage.materialize(spark.range(50).select(F.expr("repeat(uuid(), 1000)").alias("t")))
    assert lineage.broadcast_if_small(text, 50, max_bytes=1000) is text
    assert lineage.broadcast_if_small(text, 50) is not text


def test_broadcast_only_small(spark):
    df = spark.range(3)
    assert lineage.broadcast_if_small(df, 10, 5) is df and lineage.broadcast_if_small(df, 3, 5) is not df


@pytest.mark.parametrize("hot", [5, 10**6])
def test_skew_join(spark, hot):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)] + [(None, 7)], "k INT, v INT")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (99, "d")], "k INT, w STRING")
    got = sorted(tuple(r) for r in skew_join(left, right, "k", hot).collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").collect()) and len(got) > 60
