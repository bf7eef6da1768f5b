"""Text readers and writers of the classic mining formats. Schemas are always explicit and bad
numbers fail the read (ANSI casts) instead of turning into zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``tid item`` a line, separated by a blank; items from 1."""
    return spark.read.schema("tid INT, item INT").option("sep", " ").option("mode", "FAILFAST").csv(path)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, val`` a line."""
    opts = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "FAILFAST"}
    return spark.read.schema("doc_id BIGINT, dim INT, val DOUBLE").options(**opts).csv(path)


def read_class_labels(spark: SparkSession, path: str) -> DataFrame:
    """``id, label`` a line; the id is the key, not the line."""
    raw = spark.read.schema("doc_id BIGINT, label STRING").option("mode", "FAILFAST").csv(path)
    return raw.select("doc_id", F.trim("label").alias("label"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(label, features): a label and d numbers a line, separated by commas."""
    parts = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.trim(F.col("p")[0]).cast("int").alias("label"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: F.trim(x).cast("double")).alias("features"))


def read_markup(spark: SparkSession, folder: str, pattern: str = "*.[sS][gG][mM]") -> DataFrame:
    """(file_name, payload): whole files of a folder whose names match."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("file_name"), F.col("value").alias("payload"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a white-space separated list, such as a stop-list."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''").distinct()


def first_images(df: DataFrame, n: int, by: str = "id") -> DataFrame:
    """The first ``n`` rows by key; fewer than ``n`` is an error, as a short image file is."""
    got = df.orderBy(by).limit(n)
    if got.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return got


def write_lines(df: DataFrame, line: F.Column | str, path: str, order: list[str] | None = None) -> None:
    """One text line a row, globally sorted by ``order`` where given."""
    rows = df.withColumn("_line", F.col(line) if isinstance(line, str) else line)
    (rows.orderBy(*order) if order else rows).select(F.col("_line").alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path)


def write_weightings(df: DataFrame, path: str) -> None:
    """All weightings of a corpus as one Parquet table, partitioned by weighting."""
    df.write.partitionBy("weighting").parquet(path)


def rule_line() -> F.Column:
    """``lhs | rhs | support | confidence`` with an empty rhs as {} and a missing confidence as -1."""
    rhs = F.when(F.size("rhs") == 0, "{}").otherwise(F.concat_ws(" ", F.transform("rhs", lambda x: x.cast("string"))))
    # a tie in the fifth decimal is rounded up
    conf = F.when(F.col("confidence") < 0, "-1").otherwise(F.format_string("%.4f", F.round("confidence", 4)))
    return F.concat_ws(" | ", F.concat_ws(" ", F.transform("lhs", lambda x: x.cast("string"))), rhs, F.col("support").cast("string"), conf)


def weight_line(digits: int = 4) -> F.Column:
    """One text line of a class's weights (label, ws ARRAY<DOUBLE>), separated by commas."""
    return F.concat_ws(",", F.transform("ws", lambda w: F.format_string(f"%{digits + 3}.{digits}f", w)))


def write_weights(weights: DataFrame, path: str, digits: int = 4) -> None:
    """(label, dim, w) as one line a label in label order, one number a dim."""
    rows = weights.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "w"))), lambda e: e["w"]).alias("ws"))
    write_lines(rows, weight_line(digits), path, ["label"])


def write_predictions(pred: DataFrame, path: str) -> None:
    """One predicted label a line, in the order of the ids."""
    write_lines(pred, F.col("pred").cast("string"), path, ["id"])


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One term a line, in the order of the term numbers."""
    write_lines(vocab, "term", path, ["term_id"])
