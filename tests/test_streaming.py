import datetime as dt

from quarry.streaming.counts import windowed_item_counts

SCHEMA = "tid INT, item INT, read_at TIMESTAMP"


def rows():
    t0 = dt.datetime(2024, 1, 1)
    return [(i % 7, i % 5, t0 + dt.timedelta(hours=i)) for i in range(100)] + [(None, 3, t0), (1, 0, t0), (1, 3, None), (1, 1, t0), (1, 1, t0)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    far = spark.createDataFrame([(1, 1, dt.datetime(2024, 3, 1))], SCHEMA)  # closes all windows
    q = windowed_item_counts(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("item_counts").outputMode("append").start()
    q.processAllAvailable()
    far.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in windowed_item_counts(df).collect()}
    assert {tuple(r) for r in spark.table("item_counts").collect()} == want and want
