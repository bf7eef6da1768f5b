"""Mixing sources to target weights by weighted fair queueing.

Each document of a shuffled source gets a virtual finish time: the source's cumulative tokens
up to and with the document, divided by the source's target weight; a repeated pass goes on
from the source's total. Drawing by finish time serves sources in proportion to their weights
at every moment. When a source has used its passes, the others go on in their proportions.
The draw ends with the last document that fits the total budget.

No source is ever gathered into one task: a source's documents fall into hash buckets of about
``BUCKET`` documents, bucket totals give each bucket its start, and only the inside of a bucket
is summed in order. The global order is a range sort with one total per partition.

Defined results: sources are compared lower-cased and trimmed; documents of other or null
sources, with null ids or without tokens take no part; a doc_id given more than once is one
document (its smallest row); a target that is absent, null, or not above 0 draws nothing and
is reported; a null ``max_repeats`` counts as 1; no documents give an empty draw.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.lineage import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the published splitting pattern of the vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET = 20_000
LONG = 50_000  # characters the splitting pattern is given at once
_CUT = re.compile(r"(?<=\w)(?=[ \n])")
_BLANKS = re.compile(r"\s{%d,}" % LONG)
MAX_TARGETS = 100_000


def _count_plain(encoding, text: str, at: int, end: int) -> int:
    total = 0
    while end - at > LONG:
        cut = _CUT.search(text, at + LONG, end)
        stop = cut.start() if cut else end
        total += len(encoding.encode_ordinary(text[at:stop]))
        at = stop
    return total + len(encoding.encode_ordinary(text[at:end]))


def count_tokens(encoding, text: str) -> int:
    """Tokens of a text of any length: long texts would overflow the pattern's stack.

    The pattern never joins a word character and the white space after it, so long texts are cut
    there; of a run of white space it keeps all but the last character together (all of them at
    the end of the text), so a very long run is counted as that one piece."""
    if len(text) <= LONG:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    for run in _BLANKS.finditer(text):
        last = run.end() - (run.end() < len(text))
        total += _count_plain(encoding, text, at, run.start()) + len(encoding._encode_single_piece(text[run.start() : last]))
        at = last
    return total + _count_plain(encoding, text, at, len(text))


def token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by ``n_tokens``. The vocabulary file (under 1 MB) is read on
    the driver and broadcast, so executors need not have it."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [count_tokens(encoding, t) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], [*rest, "n_tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, ", ".join([*fields, "n_tokens BIGINT"]))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows up to and with this one in the
    global order: a range partitioning, one total per partition on the driver, and a sum inside
    each partition."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    start, at = [], 0
    for r in sorted(parts.groupBy("_part").agg(F.sum(value).alias("v")).collect(), key=lambda r: r["_part"]):
        start.append((r["_part"], at))
        at += r["v"]
    base = F.broadcast(df.sparkSession.createDataFrame(start, "_part INT, _base BIGINT"))  # one row a partition
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn(name, F.sum(value).over(w)).join(base, "_part").withColumn(name, (F.col("_base") + F.col(name)).cast("bigint")).drop("_part", "_base")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = (
        targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
        .where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share)")
        .groupBy("source")
        .agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("reps"))
        .limit(MAX_TARGETS + 1)
        .collect()
    )
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    whole = sum(r["share"] for r in rows) or 1.0
    return {r["source"]: (r["share"] / whole, max(0, r["reps"])) for r in rows}


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(draw, report).

    ``draw`` has (doc_id, source, copy_no, n_tokens, finish_time, tokens_so_far), one row for each
    use of a document; ``report`` one row per target source with target and actual share, tokens
    available and drawn, the tokens it falls short of its target share of the draw, documents and
    highest repeat, and whether the source was used up. ``total_tokens`` is the budget; None takes
    the tokens of all documents of target sources. Sources that end at their cap, or are absent, fall
    short by what the report says, and the others go on in their proportions.
    """
    spark = docs.sparkSession
    want = _targets(targets)
    weights = _table(spark, [(s, w, m) for s, (w, m) in want.items()], "source STRING, weight DOUBLE, reps INT")
    mine = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).cast("string").alias("text"))
    mine = mine.where("doc_id IS NOT NULL AND length(text) > 0").join(F.broadcast(weights.select("source")), "source", "left_semi")
    sized = token_counts(mine.select("doc_id", "source", "text"), "text", vocabulary)
    sized = sized.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("s")).select("doc_id", "s.*").where("n_tokens > 0")
    sized = materialize(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "sized")
    have = {
        r["source"]: (r["n"], r["t"], r["m"])
        for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m")).collect()
    }
    live = {s: (w, m * have[s][1], have[s]) for s, (w, m) in want.items() if s in have and m > 0}
    budget = total_tokens
    if budget is None:
        budget = sum(t for _, t, _ in have.values())
    # virtual time at which the fluid draw reaches the budget; the real draw is at most one
    # document per source later
    cut, served = 0.0, 0.0
    ends = sorted((cap / w, w) for w, cap, _ in live.values())
    rate = sum(w for _, w in ends)
    for end, w in ends:
        if served + rate * (end - cut) >= budget:
            break
        served += rate * (end - cut)
        cut, rate = end, rate - w
    if rate > 1e-12 and served < budget:
        cut += (budget - served) / rate
    cut += max((h[2] / w for w, _, h in live.values()), default=0.0)
    facts = [(s, w, want[s][1], h[1], max(1, -(-h[0] // BUCKET))) for s, (w, _, h) in live.items()]
    facts_df = F.broadcast(_table(spark, facts, "source STRING, weight DOUBLE, reps INT, total BIGINT, buckets INT"))
    rows = sized.join(facts_df, "source")
    share = (F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")
    rows = rows.withColumn("bucket", F.least(F.floor(share).cast("int"), F.col("buckets") - 1))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("b"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["source", "bucket"]).withColumn("cum", F.col("start") + F.sum("n_tokens").over(inside))
    passes = F.least(F.col("reps"), (F.floor((F.lit(cut) * F.col("weight") - F.col("cum")) / F.col("total")) + 1).cast("int"))
    used = rows.withColumn("passes", passes).where("passes > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    used = used.withColumn("finish_time", (F.col("cum") + (F.col("copy_no") - 1) * F.col("total")) / F.col("weight"))
    used = used.select("doc_id", "source", "copy_no", "n_tokens", "finish_time")
    drawn = running_total(used, ["finish_time", "source", "doc_id", "copy_no"], "n_tokens", "tokens_so_far").where(F.col("tokens_so_far") <= budget)
    drawn = materialize(drawn, "drawn")
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"), F.max("copy_no").alias("most_used"), F.count("*").alias("uses"))
    base = [(s, w, m, *(have.get(s, (0, 0, 0))[:2])) for s, (w, m) in want.items()]
    report = _table(spark, base, "source STRING, target_share DOUBLE, max_repeats INT, docs_available BIGINT, tokens_available BIGINT").join(F.broadcast(got), "source", "left")
    whole = Window.partitionBy(F.lit(0))  # one row per target source
    tokens = F.coalesce("tokens", F.lit(0))
    report = report.select(
        "source", "target_share", "max_repeats", "docs_available", "tokens_available",
        F.coalesce("docs", F.lit(0)).alias("docs_drawn"), F.coalesce("most_used", F.lit(0)).alias("most_used"), tokens.alias("tokens_drawn"),
        F.coalesce(tokens / F.nullif(F.sum(tokens).over(whole), F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.greatest(F.round(F.col("target_share") * F.coalesce(F.sum(tokens).over(whole), F.lit(0))).cast("bigint") - tokens, F.lit(0)).alias("tokens_short"),
        (F.coalesce("uses", F.lit(0)) >= F.col("docs_available") * F.col("max_repeats")).alias("used_up"),
    )
    return drawn, report
